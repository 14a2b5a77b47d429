"""Exact top-k search by inner product with an M-tree: metric nodes with covering radii, stored parent distances, best first.

Inner products become distances by one more coordinate: with ``M`` the largest norm, ``x' = (x, sqrt(M^2 - |x|^2))`` and
``q' = (q, 0)`` give ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``, so the nearest is the one of the highest score. Distances only decide
what can be skipped, with a margin for rounding; scores are integers and are compared as such, so the result is exact.

* The top level: routing objects are fitted on a bounded sample (``sample_rows``); every row is then indexed under its nearest one, and a
  region's covering radius is that of all its rows.
* A region's rows lie in cells of at most about ``CELL_BYTES``, split into leaf pages of at most ``page_rows`` vectors. A page keeps its pivot, its
  covering radius, the distance of its pivot to the routing object, and its members' distances to the pivot, in ascending order.
* A query first searches one cell of its nearest region. The k-th score found there is the reach with which it goes on, to those regions alone that come
  as near as that.
* In a cell a query's pages are visited in the order of their least possible distance, a page for many queries at once, until the next one can't beat the
  k-th score found; parent distances exclude pages before their pivots' distances are computed, and members before their scores are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import materialize, ship, sized_join

SCALE = 256
CELL_BYTES = 4 << 20
RESULT = "q long, query_id long, vec_id long, score long"
#: No score: below any other.
NONE = np.iinfo(np.int64).min
#: A cell's number is its vectors' length, its region and its salt, of so many bits each but the first.
BITS = 20


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the array of floor(scale * x) as long; rows null, or holding null or non-finite components, are left out.

    A null id is left out too: it could be neither a query nor an answer. Rows that repeat an id stay, each is a candidate.
    """
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    scaled = lambda e: F.floor(F.greatest(F.least(F.lit(float(scale)) * e.cast("double"), F.lit(2.0**62)), F.lit(-(2.0**62))))  # noqa: E731 - beyond that scores aren't long
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: scaled(e).cast("long")).alias("v"))


def _lift(v: np.ndarray, m2: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(m2 - (v * v).sum(1), 0))[:, None]], 1)


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _slack(m2: float) -> float:
    return 1e-6 * (1 + 2 * float(np.sqrt(m2)))


def build_pages(ids: np.ndarray, v: np.ndarray, m2: float, page_rows: int, hub: np.ndarray) -> list[dict]:
    """Leaf pages of one cell: split at far-apart pivots until each holds at most page_rows."""
    x = _lift(v.astype(np.float64), m2)
    todo, pages = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) > page_rows:
            far = at[np.argmax(_dist(x[at], x[at[:1]])[:, 0])]
            other = at[np.argmax(_dist(x[at], x[far][None])[:, 0])]
            side = _dist(x[at], x[[far, other]])
            left = side[:, 0] <= side[:, 1]
            if 0 < left.sum() < len(at):
                todo += [at[left], at[~left]]
            else:  # all alike
                todo += [at[: len(at) // 2], at[len(at) // 2 :]]
            continue
        pivot = x[at].mean(0)
        d = _dist(x[at], pivot[None])[:, 0]
        at, d = at[np.argsort(d, kind="stable")], np.sort(d)
        pages.append({"pivot": pivot, "radius": d[-1], "parent": float(_dist(pivot[None], hub[None])[0, 0]), "ids": ids[at], "v": v[at], "d": d})
    return pages


def search_pages(pages: list[dict], qids: np.ndarray, q: np.ndarray, m2: float, k: int, hub: np.ndarray, reach: np.ndarray | None = None, count: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, vec_id, score), the k best of these pages for each query, less what lies beyond its reach; best first, exact.

    q and the pages' vectors are int64. Products are taken in floating point where that is exact.
    """
    count = {} if count is None else count
    exact, slack = m2 < 2**52, _slack(m2)
    qf = q.astype(np.float64)
    q2 = (qf * qf).sum(1)
    x = np.concatenate([qf, np.zeros((len(q), 1))], 1)
    reach = np.full(len(q), np.inf) if reach is None else reach.astype(np.float64).copy()
    parent, radius = np.array([p["parent"] for p in pages]), np.array([p["radius"] for p in pages])
    bound = np.maximum(np.abs(_dist(x, hub[None]) - parent[None]) - radius[None], 0)  # from stored parent distances alone
    bound[bound > reach[:, None] + slack] = np.inf
    to = np.full(bound.shape, np.nan)
    for j, p in enumerate(pages):
        own = np.flatnonzero(bound[:, j] < np.inf)
        count["pivots"] = count.get("pivots", 0) + len(own)
        if len(own):
            to[own, j] = _dist(x[own], p["pivot"][None])[:, 0]
            bound[own, j] = np.maximum(bound[own, j], to[own, j] - radius[j])
    order = np.argsort(bound, 1, kind="stable")
    best, ids = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
    vectors = [p["v"].astype(np.float64) if exact else p["v"] for p in pages]
    mine = qf if exact else q
    for r in range(len(pages)):
        at = order[:, r]
        act = np.flatnonzero(bound[np.arange(len(q)), at] <= np.minimum(reach + slack, np.finfo(np.float64).max))
        if not len(act):
            break
        act = act[np.argsort(at[act], kind="stable")]
        for rows in np.split(act, np.flatnonzero(np.diff(at[act])) + 1):
            p, far = pages[at[rows[0]]], to[rows, at[rows[0]]]
            lo = np.searchsorted(p["d"], (far - reach[rows]).min() - slack, "left")
            hi = np.searchsorted(p["d"], (far + reach[rows]).max() + slack, "right")
            if lo >= hi:
                continue
            count["scored"] = count.get("scored", 0) + int(hi - lo) * len(rows)
            s = mine[rows] @ vectors[at[rows[0]]][lo:hi].T
            s = s.astype(np.int64) if exact else s
            own = p["ids"][lo:hi]
            s[own[None] == qids[rows][:, None]] = NONE
            floor = best[rows, -1]
            if hi - lo > k:
                floor = np.maximum(floor, np.partition(s, hi - lo - k, axis=1)[:, hi - lo - k])
            i, c = np.nonzero((s >= floor[:, None]) & (s > NONE))
            if not len(i):
                continue
            of, score, vec = np.concatenate([i, np.repeat(np.arange(len(rows)), k)]), np.concatenate([s[i, c], best[rows].ravel()]), np.concatenate([own[c], ids[rows].ravel()])
            o = np.lexsort((vec, ~score, of))
            place = np.arange(len(o)) - np.searchsorted(of[o], of[o], "left")
            o = o[place < k]  # each row has k at least, its old ones
            best[rows], ids[rows] = score[o].reshape(-1, k), vec[o].reshape(-1, k)
            last = best[rows, -1]
            found = np.sqrt(np.maximum(q2[rows] + m2 - 2 * last.astype(np.float64), 0))
            reach[rows] = np.where(last > NONE, np.minimum(reach[rows], found), reach[rows])
    i, c = np.nonzero(best > NONE)
    return i, ids[i, c], best[i, c]


class Regions:
    """The top level: routing objects by length of vector, and the covering radii of their regions.

    Lengths that the sample lacks have one region around the origin, whose radius isn't known, so that it is always searched.
    """

    def __init__(self, hubs: dict[int, np.ndarray], m2: float) -> None:
        self.hubs, self.m2 = hubs, m2
        self.radii: dict[int, np.ndarray] = {}

    @classmethod
    def fit(cls, sample: list[list[int]], m2: float, want: int, seed: int) -> Regions:
        rng = np.random.default_rng(seed)
        by: dict[int, list] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v)
        hubs = {}
        for dim, own in by.items():
            x = _lift(np.array(own, np.float64).reshape(len(own), dim), m2)
            hubs[dim] = x[rng.choice(len(x), min(len(x), max(1, round(want * len(own) / len(sample)))), replace=False)]
        return cls(hubs, m2)

    def of(self, dim: int) -> np.ndarray:
        return self.hubs.get(dim, np.zeros((1, dim + 1)))

    def hub(self, region: int) -> np.ndarray:
        return self.of(region >> BITS)[region & (1 << BITS) - 1]

    def assign(self, v: pd.Series, lifted: bool) -> tuple[np.ndarray, np.ndarray]:
        """The nearest region of each vector (of a query, where not lifted) and the distance to its routing object."""
        region, far = np.zeros(len(v), np.int64), np.zeros(len(v))
        for dim, at, x in _by_length(v):
            d = _dist(_lift(x, self.m2) if lifted else np.concatenate([x, np.zeros((len(x), 1))], 1), self.of(dim))
            near = d.argmin(1)
            region[at], far[at] = (dim << BITS) + near, d[np.arange(len(d)), near]
        return region, far

    def within(self, v: pd.Series, reach: np.ndarray) -> list[list[int]]:
        """The regions that come as near to each query as its reach: distance to the routing object less the covering radius."""
        out: list[list[int]] = [[] for _ in range(len(v))]
        for dim, at, x in _by_length(v):
            radii = self.radii.get(dim, np.array([np.inf]))
            near = _dist(np.concatenate([x, np.zeros((len(x), 1))], 1), self.of(dim)) - radii[None] <= reach[at][:, None] + _slack(self.m2)
            for i, row in zip(at, near, strict=True):
                out[i] = ((dim << BITS) + np.flatnonzero(row)).tolist()
        return out


def _by_length(v: pd.Series):
    """(length, positions, matrix) of the vectors of a column."""
    sizes = v.map(len).to_numpy()
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, np.stack(v.to_numpy()[at]).astype(np.float64).reshape(len(at), int(dim))


def _visit(tree: DataFrame, asks: DataFrame, regions: Regions, k: int, query_block: int) -> DataFrame:
    """The k best of each cell for the queries that ask it; a cell that many ask is met by blocks of them."""
    load = asks.groupBy("cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
    load = materialize(load, "load")
    asked = sized_join(asks, load, "cell", "inner").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks")
    met = sized_join(tree, load, "cell", "inner").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(key, pages, own):
        if not len(pages) or not len(own):
            return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        region = int(key[0]) >> BITS
        dim = region >> BITS
        g = lambda b: np.frombuffer(b, np.float64)
        made = [{"pivot": g(p.pivot), "radius": p.radius, "parent": p.parent, "ids": np.frombuffer(p.ids, np.int64), "v": np.frombuffer(p.v, np.int64).reshape(-1, dim), "d": g(p.d)} for p in pages.itertuples()]
        q = np.stack(own["v"].to_numpy()).astype(np.int64).reshape(len(own), dim)
        ids = own["vec_id"].to_numpy(np.int64)
        i, vec, score = search_pages(made, ids, q, regions.m2, k, regions.hub(region), own["reach"].to_numpy(np.float64))
        return pd.DataFrame({"q": own["q"].to_numpy(np.int64)[i], "query_id": ids[i], "vec_id": vec, "score": score})

    return met.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInPandas(search, RESULT)


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", regions: int | None = None, sample_rows: int = 4096, page_rows: int = 256, query_block: int = 4096, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by query_every its k best other rows.

    Every row of another id is a candidate. Fewer than k are returned if there are no more; ties go to the smaller id. Vectors of
    different lengths aren't compared. An empty table, or one without a query, gives an empty result. Rows that repeat
    an id and a vector are one query but as many candidates. Vectors whose products may not fit a long are refused (ValueError).
    A hot region is no task of its own: its rows are spread over cells by a salt, and the queries of a cell over blocks.
    """
    spark = vectors.sparkSession
    ship(spark)
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    base = materialize(quantize(vectors, id_col, vector_col).withColumn("norm", norm), "vectors")
    m2, n, width = base.agg(F.max("norm"), F.count("*"), F.avg(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if m2 >= 2.0**62.9:
        raise ValueError("the products of these vectors may exceed a long")
    rows = base.select("vec_id", "v")
    size = max(256, int(CELL_BYTES // (8 * max(1.0, width))))
    want = regions or max(1, min(sample_rows // 8, -(-n // size)))
    sample = [list(r[0]) for r in rows.select("v").sample(min(1.0, 1.5 * sample_rows / n), seed).limit(sample_rows).collect()]
    top = Regions.fit(sample, m2, want, seed)
    pair = "region long, far double"

    @F.pandas_udf(pair)
    def place(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("region", "far"), top.assign(v, True), strict=True)))

    @F.pandas_udf(LongType())
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(top.assign(v, False)[0])

    placed = materialize(rows.withColumn("x", place("v")).select("vec_id", "v", "x.region", "x.far"), "placed")
    known = placed.groupBy("region").agg(F.max("far").alias("far"), F.ceil(F.count("*") / size).cast("int").alias("salts"))
    known = materialize(known, "regions")
    for r in known.where(F.shiftright("region", BITS).isin(sorted(top.hubs))).collect():  # no more than routing objects
        dim, i = r.region >> BITS, r.region & (1 << BITS) - 1
        top.radii.setdefault(dim, np.full(len(top.hubs[dim]), -np.inf))[i] = r.far  # a region without rows is never near
    cell = lambda salt: F.shiftleft("region", BITS) + salt
    salted = sized_join(placed.drop("far"), known.select("region", "salts"), "region", "inner")
    cells = salted.select("vec_id", "v", cell(F.pmod(F.xxhash64("vec_id", "v"), F.col("salts"))).alias("cell"))

    def pages_of(key, pdf):
        region = int(key[0]) >> BITS
        v = np.stack(pdf["v"].to_numpy()).astype(np.int64).reshape(len(pdf), region >> BITS)
        made = build_pages(pdf["vec_id"].to_numpy(np.int64), v, m2, page_rows, top.hub(region))
        f = lambda a: np.asarray(a, np.float64).tobytes()
        return pd.DataFrame([{"cell": key[0], "pivot": f(p["pivot"]), "radius": p["radius"], "parent": p["parent"], "ids": p["ids"].tobytes(), "v": p["v"].tobytes(), "d": f(p["d"])} for p in made])

    tree = materialize(cells.groupBy("cell").applyInPandas(pages_of, "cell long, pivot binary, radius double, parent double, ids binary, v binary, d binary"), "pages")
    own = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0).dropDuplicates()
    own = materialize(sized_join(own.withColumn("region", home("v")), known.select("region", "salts"), "region"), "own")
    # the nearest region may be empty: then the first search finds nothing and the second goes everywhere
    own = own.withColumn("home", cell(F.pmod(F.xxhash64("vec_id"), F.coalesce("salts", F.lit(1)))))
    own = materialize(own.select("vec_id", "v", "home", F.monotonically_increasing_id().alias("q")), "queries")
    first = materialize(_visit(tree, own.select("q", "vec_id", "v", F.lit(float("inf")).alias("reach"), F.col("home").alias("cell")), top, k, query_block), "first")
    reached = first.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    own = own.join(reached, "q", "left")

    @F.pandas_udf(ArrayType(LongType()))
    def near(v: pd.Series, reach: pd.Series) -> pd.Series:
        return pd.Series(top.within(v, reach.to_numpy(np.float64)))

    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    reach: Column = F.coalesce(F.sqrt(F.greatest(square + F.lit(float(m2)) - 2 * F.col("least").cast("double"), F.lit(0.0))), F.lit(float("inf")))
    on = own.withColumn("reach", reach).withColumn("region", F.explode(near("v", "reach")))
    on = sized_join(on, known.select("region", "salts"), "region", "inner")
    on = on.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.shiftleft("region", BITS) + s))).where("cell <> home")
    on = materialize(on.select("q", "vec_id", "v", "reach", "cell"), "asks")
    found = first.unionByName(_visit(tree, on, top, k, query_block))
    # row_number() <= k is applied before the shuffle too (a window group limit), so k rows a query and task are moved
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
