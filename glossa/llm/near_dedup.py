"""SimHash near-duplicates by a binary trie self-join.

Texts become 64-bit fingerprints; distinct fingerprints are the leaves of a binary trie. The join walks pairs of trie nodes down
together, adds up the bits in which their prefixes differ and drops a pair as soon as it exceeds its error budget.

Two bits of budget at the top are what keeps the number of live pairs near linear: of two fingerprints with at most ``d`` differing bits
either the first half holds at most ``d // 2`` of them, or the second half does. So the trie is walked twice, once as it is and once
with the halves exchanged, each time with the budget ``d // 2`` in the first 32 levels and ``d`` below. The second walk
only reports pairs that the first can't have seen.

The upper levels are walked in Spark, level by level, over tables of nodes with counts, until a pair of nodes has few leaves; such a pair is one
group of a grouped map and is finished there in NumPy. A group emits, for each leaf, how many documents it links and one forest edge,
never the pairs. Components come from the forest by alternating star contractions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, class_join, fresh, materialize, released, ship

BITS, HALF = 64, 32
#: A pair of nodes with at most this many leaves is finished in one group.
LEAVES = 4096
#: Levels that one expansion in Spark descends.
STEP = 4


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles (XXH64, seed 42): a bit is 1 if set in over half of the hashes; 0 without a word."""
    from itertools import repeat

    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = list(map(b" ".join, zip(words, words[1:], words[2:]))) if len(words) >= 3 else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row, one pass of Arrow batches."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(released(run), "doc_id long, fp long")


# ---- the walk inside a group


def walk(a: np.ndarray, b: np.ndarray, depth: int, distance: int = 3, skip: int = -1, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of sorted uint64 arrays a and b that differ in at most `distance` bits, at most distance // 2 of them in the first half.

    Each array is the leaves of one trie node at `depth`. Nodes are ranges of the array; all live pairs of a level are advanced together. With
    same, a is b and pairs come once (i < j). skip: leave out pairs whose second half differs in at most so many bits.
    """
    top = distance // 2
    high = np.uint64(HALF)
    err0 = 0 if not len(a) or not len(b) or not depth else int((a[0] ^ b[0]) >> np.uint64(BITS - depth)).bit_count()
    live = np.array([[0, len(a), 0, len(b), err0]], np.int64)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def finish(p: np.ndarray) -> None:
        """Small ranges: compare their leaves."""
        for k in range(0, len(p), 1 << 14):
            alo, ahi, blo, bhi, _ = p[k : k + (1 << 14)].T
            w = bhi - blo
            n = (ahi - alo) * w
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = alo[of] + at // w[of], blo[of] + at % w[of]
            if same:
                i, j = i[i < j], j[i < j]
            x = a[i] ^ b[j]
            ok = (np.bitwise_count(x) <= distance) & (np.bitwise_count(x >> high) <= top)
            if skip >= 0:
                ok &= np.bitwise_count(x & np.uint64(2**HALF - 1)) > skip
            left.append(i[ok])
            right.append(j[ok])

    for level in range(depth, BITS + 1):
        if not len(live):
            break
        live = live[(live[:, 0] < live[:, 1]) & (live[:, 2] < live[:, 3]) & (live[:, 4] <= (top if level <= HALF else distance))]
        small = (live[:, 1] - live[:, 0]) * (live[:, 3] - live[:, 2]) <= 16
        if level == BITS:
            small[:] = True
        finish(live[small])
        live = live[~small]
        if level == BITS or not len(live):
            break
        bit = np.uint64(1) << np.uint64(BITS - 1 - level)
        rest = bit - np.uint64(1)

        def middle(v: np.ndarray, lo: np.ndarray, bit=bit, rest=rest) -> np.ndarray:
            """Where the second child of each range begins."""
            ranges, back = np.unique(lo, return_inverse=True)
            return np.searchsorted(v, (v[ranges] & ~(bit | rest)) | bit)[back]

        alo, ahi, blo, bhi, err = live.T
        am, bm = np.minimum(np.maximum(middle(a, alo), alo), ahi), np.minimum(np.maximum(middle(b, blo), blo), bhi)
        kids = [np.stack([alo, am, blo, bm, err], 1), np.stack([am, ahi, bm, bhi, err], 1), np.stack([alo, am, bm, bhi, err + 1], 1)]
        cross = np.stack([am, ahi, blo, bm, err + 1], 1)
        kids.append(cross[alo != blo] if same else cross)
        live = np.concatenate(kids)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges (i, j)."""
    root = np.arange(n)
    while len(i):
        ri, rj = root[i], root[j]
        go = ri != rj
        if not go.any():
            break
        i, j, ri, rj = i[go], j[go], ri[go], rj[go]
        np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def _finish_group(distance: int, skip: int):
    def run(key, pdf):
        """Links and forest edges of one pair of nodes; columns side (0: first node, 1: second, 2: both), f, n."""
        depth, same = int(key[0]), bool(key[1] == key[2])
        f, n, side = pdf["f"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64), pdf["side"].to_numpy()
        o = np.argsort(f)
        f, n, side = f[o], n[o], side[o]
        if same:
            a = b = f
            na = nb = n
        else:
            a, b, na, nb = f[side == 0], f[side == 1], n[side == 0], n[side == 1]
        i, j = walk(a, b, depth, distance, skip, same)
        if not len(i):
            return pd.DataFrame({"f": np.empty(0, np.int64), "near": np.empty(0, np.int64), "to": np.empty(0, np.int64)})
        every = a if same else np.concatenate([a, b])
        shift = 0 if same else len(a)
        near = np.zeros(len(every), np.int64)
        near += np.bincount(i, nb[j], len(every)).astype(np.int64)
        near += np.bincount(j + shift, na[i], len(every)).astype(np.int64)
        root = forest(len(every), i, j + shift)
        hit = near > 0
        return pd.DataFrame({"f": every[hit].view(np.int64), "near": near[hit], "to": every[root[hit]].view(np.int64)})

    return run


# ---- the walk in Spark


def _prefix(f: Column, depth: int) -> Column:
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(f, BITS - depth)


def _seeds(leaves: DataFrame, total: int, distance: int, limit: int) -> list[tuple[int, DataFrame]]:
    """(depth, table of a <= b) for the pairs of trie nodes that groups are to finish."""
    top = distance // 2
    depth = min(HALF, max(0, (max(1, total) // limit).bit_length()))
    out = []

    def nodes(d: int) -> DataFrame:
        return leaves.groupBy(_prefix(F.col("f"), d).alias("p")).agg(F.count("*").alias("c"))

    def near(p: Column, bits: int, budget: int) -> Column:
        """p and what differs from it in at most `budget` of its last `bits` bits, with the number of those."""
        masks = [(m, m.bit_count()) for m in _masks(bits, budget)]
        return F.explode(F.array(*[F.struct(p.bitwiseXOR(F.lit(m)).cast("long").alias("b"), F.lit(e).alias("e")) for m, e in masks]))

    at = nodes(depth)
    pairs = at.select(F.col("p").alias("a"), F.col("c").alias("ca"), near(F.col("p"), depth, min(top, depth)).alias("x")).select("a", "ca", F.col("x.b").alias("b"), F.col("x.e").alias("e"))
    while True:
        other = at.select(F.col("p").alias("b"), F.col("c").alias("cb"))
        # each pair once; compared without sign, which keeps the order of the nodes above
        pairs = materialize(pairs.where("(a ^ shiftleft(1L, 63)) <= (b ^ shiftleft(1L, 63))").join(other, "b"), "nodes")
        big = F.col("ca") + F.col("cb") > 4 * limit
        if depth >= BITS or not pairs.where(big).limit(1).count():
            out.append((depth, pairs.select("a", "b")))
            return out
        out.append((depth, pairs.where(~big).select("a", "b")))
        more = pairs.where(big)
        deeper = min(BITS, depth + STEP)
        at = nodes(deeper)
        kids = at.select(F.shiftrightunsigned("p", deeper - depth).alias("a"), F.col("p").alias("ka"), F.col("c").alias("kc"))
        step = more.select("a", "b", "e").join(kids, "a")
        low = F.col("ka").bitwiseAND(F.lit((1 << (deeper - depth)) - 1))
        grown = step.select("ka", "kc", "e", near(F.shiftleft("b", deeper - depth).bitwiseOR(low), deeper - depth, distance).alias("x"))
        grown = grown.select(F.col("ka").alias("a"), F.col("kc").alias("ca"), F.col("x.b").alias("b"), (F.col("e") + F.col("x.e")).alias("e"))
        pairs = grown.where(F.col("e") <= (top if deeper <= HALF else distance)).distinct()
        depth = deeper


def _masks(bits: int, budget: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << i for i in c) for k in range(min(budget, bits) + 1) for c in combinations(range(bits), k)]


def links(leaves: DataFrame, distance: int = 3, limit: int = LEAVES) -> DataFrame:
    """fp, near, to: of each distinct fingerprint the documents at other ones it links (in parts that add up) and forest edges.

    leaves: fp and n, the number of its documents.
    """
    spark = leaves.sparkSession
    total = leaves.count()
    out = None
    for swapped in (False, True):
        own = leaves.select((F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF)) if swapped else F.col("fp")).alias("f"), "n")
        skip = distance // 2 if swapped else -1
        # in the exchanged trie the low half is the original's first one: what differs there in at most `skip` bits has been found
        for depth, pairs in _seeds(own, total, distance, limit):
            sides = pairs.select(F.lit(depth).alias("d"), "a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
            sides = sides.withColumn("p", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
            rows = own.withColumn("p", _prefix(F.col("f"), depth)).join(sides, "p").select("d", "a", "b", "side", "f", "n")
            got = rows.groupBy("d", "a", "b").applyInPandas(_finish_group(distance, skip), "f long, near long, to long")
            back = (lambda c: F.shiftleft(c, HALF).bitwiseOR(F.shiftrightunsigned(c, HALF))) if swapped else F.col
            got = got.select(back("f").alias("fp"), "near", back("to").alias("to"))
            out = got if out is None else out.unionByName(got)
    return materialize(out, "links") if out is not None else spark.createDataFrame([], "fp long, near long, to long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable, as signed numbers) of the graph whose edges are (u, v).

    Large-star and small-star contractions in turn until nothing changes: logarithmic in practice. Least neighbours are aggregated before they are
    shuffled and joined back, those of hot nodes by broadcast, so no task holds all the neighbours of a node.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n, last = e.count(), None

    def least(d: DataFrame) -> DataFrame:
        """d with m, the least v of each u."""
        return class_join(d, d.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", "n", 2 * n)

    while True:
        # large star: each node's larger neighbours go to its smallest neighbour (or itself)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        if 2 * n > HOT_ROWS:
            large = materialize(large, "large")
        # small star: a node's smaller neighbours, and itself, go to the smallest of them
        small = least(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = materialize(small, "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state


def near_duplicates(docs: DataFrame, distance: int = 3, limit: int = LEAVES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_near, component_id for every row.

    n_near counts the other rows at the same fingerprint or one that differs in at most `distance` bits; component_id is the smallest
    doc_id that can be reached over such links. A null or empty text has the fingerprint 0 and is linked like any other. Rows that
    repeat an id count each; a null id stays null and is passed over as the smallest. An empty table gives an empty result. Copies of one
    fingerprint are one leaf whatever their number, so a group of copies that holds a third of all rows costs as much as one row.
    """
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _spread(*_classes(docs, distance, limit, id_col, text_col)).select("doc_id", text.alias("fingerprint"), "n_near", "component_id")


def _classes(docs: DataFrame, distance: int, limit: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id and fp of every row; fp, n (its rows), n_near, component_id and root of every fingerprint. Components may share a component_id, not a root."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    leaves = materialize(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "leaves")
    found = links(leaves.select("fp", "n"), distance, limit)
    near = found.groupBy("fp").agg(F.sum("near").alias("near"))
    comp = components(found.select(F.col("fp").alias("u"), F.col("to").alias("v")))
    named = leaves.join(near, "fp", "left").join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named.select("fp", "n", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).cast("long").alias("n_near"), "root", "first"), "named")
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_fps"))
    return fps, materialize(class_join(named, roots, "root", "_fps", named.count()).select("fp", "n", "n_near", "component_id", "root"), "classes")


def _spread(fps: DataFrame, per: DataFrame) -> DataFrame:
    """Join what holds for a fingerprint to its rows."""
    return class_join(fps, per, "fp", "n", fps.count())


def keep_one(docs: DataFrame, distance: int = 3, limit: int = LEAVES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one of the smallest id stays, with all its columns.

    Where rows of a component repeat that id, the one whose text has the smallest hash stays; rows of one id in several components are decided on in each. Rows
    without an id are kept. What is joined is the ids that go, fewer than those that stay; only if they exceed the broadcast limit of the session are the
    rows shuffled, once, by id. Rows whose id repeats are fingerprinted again and reduced, before they are shuffled, to one a fingerprint. Columns may have any name.
    """
    fps, per = _classes(docs, distance, limit, id_col, text_col)
    rows = _spread(fps, per)
    own, fp_, key, root, pick = fresh(docs.columns, "_id", "_fp", "_key", "_root", "_pick")
    repeated = materialize(fps.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own)).count().where("count > 1").select(own), "repeated")
    several = repeated.limit(1).count() > 0
    gone = rows.where("doc_id <> component_id").select(F.col("doc_id").alias(own))
    gone = materialize((gone.unionByName(repeated) if several else gone).distinct(), "gone")
    here = F.col(id_col) == F.col(own)
    d = docs.join(gone, here, "left_anti")
    if not several:
        return d
    heads = rows.where("doc_id = component_id").join(repeated, F.col("doc_id") == F.col(own), "left_semi")
    heads = materialize(heads.select(F.col("doc_id").alias(own), F.col("fp").alias(fp_), F.col("root").alias(root)).distinct(), "heads")

    @F.arrow_udf("long")
    def fp(t: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x) for x in t.to_pylist()], np.uint64).view(np.int64))

    # of rows alike in text the one whose other columns (but maps, which have no order) hash lowest
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    again = docs.join(repeated, here, "left_semi").select(F.col(id_col).cast("long").alias(own), fp(F.col(text_col)).alias(fp_), F.struct(F.xxhash64(text_col), F.xxhash64(*others)).alias(key), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(pick))
    again = again.groupBy(own, fp_).agg(F.min_by(pick, key).alias(pick), F.min(key).alias(key)).join(heads, [own, fp_])
    return d.unionByName(again.groupBy(own, root).agg(F.min_by(pick, key).alias(pick)).select(f"{pick}.*"))
