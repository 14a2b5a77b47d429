"""Word n-gram language model by deleted interpolation.

Maximum-likelihood estimates of the orders 1 .. n are mixed from the lowest upward. The weight of an order depends on how often its context
was seen (a bucket for each power of two) and is learned by expectation-maximisation on the counts of a held-out part of the training texts; then
the counts of both parts make the final estimates.

Nothing corpus-wide is broadcast or collected. Texts become chunks of token numbers; each chunk sends the hashes and counts of its own distinct
n-grams, sorted and packed, to the parts of the hash space, gets the corpus's counts of just those back, and is scored with them. Token numbers
lie in the shared folder, one file a task, and are read from there; what is shuffled is a few bytes for each distinct n-gram of a chunk. The statistics that the driver sees (totals, and histograms of at most
32 x 1025 cells for the weights) don't grow with the corpus.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, parts_for, shared_dir, ship

#: Tokens of a chunk: what a Python worker holds at once.
CHUNK_TOKENS = 1_000_000
BUCKETS = 32
#: Cells of the ratio histograms: sixteenths of a power of two, from 2^-32 to 2^32, and one for zero.
FINE, SPAN = 16, 32
CELLS = 2 * FINE * SPAN + 1


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 7)


END, START = 0x9C3F0A51E2B7D846, 0x17E4D2C8A6B05F93


def pack(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; byte strings, whose white space is the ASCII one."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out_of(doc_id) -> tuple[bool, bool]:
    """Whether a document is held out of training, and else whether its counts are the ones that weights are learned on."""
    c = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return c % 10 == 0, c % 10 != 0 and c // 10 % 10 == 0


def grams(tokens: np.ndarray, hashes: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 .. order the hash of the k-gram that ends at each token; before a document's first one stands START."""
    h = hashes[tokens]
    out = [h]
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    with np.errstate(over="ignore"):
        for k in range(1, order):
            back = np.full(len(h), START, np.uint64)
            ok = place >= k
            back[ok] = h[np.flatnonzero(ok) - k]
            x = out[-1] * np.uint64(0x9E3779B97F4A7C15) + back
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(x ^ (x >> np.uint64(32)))
    return out


def cell(ratio: np.ndarray) -> np.ndarray:
    """Histogram cell of a ratio; 0 is the one for zero."""
    with np.errstate(divide="ignore"):
        c = np.floor(np.log2(ratio) * FINE) + FINE * SPAN
    return np.where(ratio > 0, 1 + np.clip(c, 0, 2 * FINE * SPAN - 1), 0).astype(np.int64)


_RATIO = np.concatenate([[0.0], 2.0 ** ((np.arange(2 * FINE * SPAN) + 0.5) / FINE - SPAN)])


def learn(histogram: np.ndarray, rounds: int = 200) -> float:
    """The weight of the upper estimate, by EM over how often it was so many times the lower one."""
    n = histogram.sum()
    if not n:
        return 0.0
    lam = 0.5
    for _ in range(rounds):
        new = float((histogram * (lam * _RATIO / (lam * _RATIO + (1 - lam)))).sum() / n)
        new = min(max(new, 1e-6), 1 - 1e-6)
        if abs(new - lam) < 1e-9:
            break
        lam = new
    return lam


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(context, 0).astype(np.float64))[1], BUCKETS - 1)


def probabilities(counts: list[np.ndarray], contexts: list[np.ndarray], vocabulary: int, weights: list[np.ndarray], upto: int) -> np.ndarray:
    """Interpolated probabilities of the orders 0 .. upto at each token; unseen contexts pass everything to the order below."""
    p = np.full(len(counts[0]), 1.0 / (vocabulary + 1))
    for k in range(upto):
        lam = np.where(contexts[k] > 0, weights[k][bucket(contexts[k])], 0.0)
        p = lam * counts[k] / np.maximum(contexts[k], 1) + (1 - lam) * p
    return p


# ---- chunks

#: What a chunk sends: for k >= 1 the sorted distinct k-grams of one part of the hash space with their counts in training, for k = 0 where its tokens lie.
#: The last bit of a chunk's number says that its documents are those that weights are learned on.
_ASK = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("docs", pa.int64())])
_ASK_DDL = "chunk long, part int, k int, keys binary, counts binary, path string, at long, size long, docs long"
_BODY = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())), ("tokens", pa.binary()), ("hashes", pa.binary())])


class _Chunk:
    def __init__(self) -> None:
        self.number = defaultdict(itertools.count(1).__next__)  # 0 is the end
        self.ids, self.sizes, self.held, self.tokens, self.total = [], [], [], [], 0

    def add(self, doc_id, text: str | None, held: bool) -> None:
        t = np.array([*map(self.number.__getitem__, tokens_of(text)), 0], np.uint32)
        self.ids.append(doc_id)
        self.sizes.append(len(t))
        self.held.append(held)
        self.tokens.append(t)
        self.total += len(t)

    def packed(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The chunk as an Arrow stream, its tokens and the hashes they stand for."""
        tokens = np.concatenate(self.tokens)
        hashes = np.array([END, *map(_hash, self.number)], np.uint64)
        body = pa.RecordBatch.from_pylist([{"ids": self.ids, "sizes": self.sizes, "held": self.held, "tokens": pack(tokens), "hashes": pack(hashes)}], schema=_BODY)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _BODY) as w:
            w.write_batch(body)
        return sink.getvalue().to_pybytes(), tokens, hashes

    def asks(self, chunk: int, tokens: np.ndarray, hashes: np.ndarray, order: int, parts: int) -> list[dict]:
        sizes = np.array(self.sizes)
        counted = np.repeat(~np.array(self.held), sizes)
        shift = np.uint64(64 - (parts - 1).bit_length()) if parts > 1 else None
        out = []
        for k, g in enumerate(grams(tokens, hashes, np.cumsum(sizes) - sizes, order), 1):
            keys, at = np.unique(g, return_inverse=True)
            n = np.bincount(at, counted, len(keys)).astype(np.uint32)
            cuts = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64)) if shift is not None else np.array([0, len(keys)])
            for p in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[p], cuts[p + 1])
                out.append({"chunk": chunk, "part": int(p), "k": k, "keys": pack(np.diff(keys[s], prepend=np.uint64(0))), "counts": pack(n[s])})
        return out


def _chunks(docs: DataFrame, order: int, parts: int, chunk_tokens: int, folder: str, id_col: str, text_col: str) -> DataFrame:
    """What all chunks ask; their tokens are written on the way. A retried task writes another file, and its rows name that."""

    def run(batches):
        from pyspark import TaskContext

        serial = itertools.count(TaskContext.get().partitionId() << 24)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        file, at = None, 0
        open_: dict[bool, _Chunk] = {}

        def close(dev: bool):
            nonlocal file, at
            c, number = open_.pop(dev), next(serial) << 1 | dev
            body, tokens, hashes = c.packed()
            file = file or fs.open_output_stream(f"{root}/{name}")
            file.write(body)
            rows = c.asks(number, tokens, hashes, order, parts)
            rows.append({"chunk": number, "part": number % parts, "k": 0, "path": f"{folder}/{name}", "at": at, "size": len(body), "docs": len(c.held) - sum(c.held)})
            at += len(body)
            return pa.RecordBatch.from_pylist(rows, schema=_ASK)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held, dev = held_out_of(i)
                c = open_.setdefault(dev, _Chunk())
                c.add(i, t, held)
                if c.total >= chunk_tokens:
                    yield close(dev)
        last = [close(dev) for dev in list(open_)]
        if file:
            file.close()  # before the last rows name it
        yield from last

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _ASK_DDL)


# ---- the parts of the hash space

_REPLY = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("fit", pa.binary()), ("every", pa.binary()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("docs", pa.int64()), ("sums", pa.list_(pa.int64())), ("dev_cells", pa.list_(pa.int64())), ("dev_counts", pa.list_(pa.int64()))])
_REPLY_DDL = "chunk long, part int, k int, fit binary, every binary, path string, at long, size long, docs long, sums array<long>, dev_cells array<long>, dev_counts array<long>"


def _count_part(key, table: pa.Table) -> pa.Table:
    """Add up the counts of all chunks at the keys of one part and answer each chunk; order 1 also gives the part's totals."""
    part, k = key[0].as_py(), key[1].as_py()
    if k == 0:  # where chunks lie, passed on
        return pa.Table.from_pylist(table.select(["chunk", "part", "k", "path", "at", "size", "docs"]).to_pylist(), schema=_REPLY)
    cols = {c: table.column(c).to_pylist() for c in ("chunk", "keys", "counts")}
    keys = [np.cumsum(unpack(b, np.uint64), dtype=np.uint64) for b in cols["keys"]]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.concatenate([unpack(b, np.uint32) for b in cols["counts"]])
    is_dev = np.repeat([c & 1 == 1 for c in cols["chunk"]], [len(x) for x in keys])
    sums = {"fit": np.bincount(at, n * ~is_dev, len(every)).astype(np.uint64), "dev": np.bincount(at, n * is_dev, len(every)).astype(np.uint64)}
    total = sums["fit"] + sums["dev"]
    out, pos = [], 0
    for c, x in zip(cols["chunk"], keys, strict=True):
        i = at[pos : pos + len(x)]
        pos += len(x)
        out.append({"chunk": c, "part": part, "k": k, "fit": pack(sums["fit"][i]), "every": pack(total[i])})
    if k == 1:
        # of the tokens counted for the weights, how many have a word of which count (in histogram cells of the count itself)
        cells = np.bincount(cell(sums["fit"].astype(np.float64)), sums["dev"].astype(np.float64), CELLS).astype(np.int64)
        used = np.flatnonzero(cells)
        out.append({"part": part, "k": 1, "sums": [int(total.sum()), int((total > 0).sum()), int(sums["fit"].sum()), int((sums["fit"] > 0).sum())], "dev_cells": used.tolist(), "dev_counts": cells[used].tolist()})
    return pa.Table.from_pylist(out, schema=_REPLY)


class _Counts:
    """Counts and context counts at each token of a chunk."""

    def __init__(self, replies: pa.Table, order: int) -> None:
        place = next(x for x in replies.select(["k", "path", "at", "size"]).to_pylist() if x["k"] == 0)
        fs, path = filesystem(place["path"])
        with fs.open_input_file(path) as f:
            row = pa.ipc.open_stream(f.read_at(place["size"], place["at"])).read_all().to_pylist()[0]
        self.ids, self.held, self.sizes = row["ids"], row["held"], np.array(row["sizes"])
        self.tokens = unpack(row["tokens"], np.uint32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        r = sorted(x for x in zip(*(replies.column(c).to_pylist() for c in ("k", "part", "fit", "every")), strict=True) if x[0])
        self.at, self.reply = [], {"fit": [], "every": []}
        for k, g in enumerate(grams(self.tokens, unpack(row["hashes"], np.uint64), self.starts, order), 1):
            self.at.append(np.unique(g, return_inverse=True)[1])
            for i, name in ((2, "fit"), (3, "every")):
                self.reply[name].append(np.concatenate([unpack(x[i], np.uint64) for x in r if x[0] == k]))

    def of(self, name: str, total: int, documents: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        counts = [c[a].astype(np.float64) for c, a in zip(self.reply[name], self.at, strict=True)]
        contexts = [np.full(len(self.tokens), float(total))]
        for c in counts[:-1]:
            before = np.roll(c, 1)
            before[self.starts] = documents
            contexts.append(before)
        return counts, contexts


def score(docs: DataFrame, order: int = 2, parts: int | None = None, chunk_tokens: int = CHUNK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Documents whose crc32(doc_id as text) mod 10 is 0 are held out; all others are learned from. A token is a word or a document's end.
    n_known counts tokens seen in training; base_score is the add-0.1 unigram log10 probability; score the model's. A null text has the
    end alone; a null id is hashed as the empty string (held out); rows that repeat an id count and are scored each. An empty table gives an empty result.
    parts: of the hash space, rounded up to a power of two; by default as many as the session shuffles into, or the input has. Counts are exact but for collisions of 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = parts or parts_for(docs)
    parts = 1 << (max(1, parts) - 1).bit_length()
    asked = _chunks(docs, order, parts, chunk_tokens, shared_dir(spark, "chunks"), id_col, text_col)
    path = shared_dir(spark, "counts")
    asked.groupBy("part", "k").applyInArrow(lambda key, table: _count_part(key, table), _REPLY_DDL).write.option("compression", "none").parquet(path)
    replies = spark.read.schema(_REPLY_DDL).parquet(path)

    # totals and the weight of order 1
    stats = replies.where("sums IS NOT NULL")
    n_all, v_all, n_fit, v_fit = (x or 0 for x in stats.agg(*(F.sum(F.col("sums")[i]) for i in range(4))).first())
    cells = stats.select(F.explode(F.arrays_zip("dev_cells", "dev_counts")).alias("x")).groupBy("x.dev_cells").agg(F.sum("x.dev_counts")).collect()  # at most CELLS rows
    dev = (F.col("chunk").bitwiseAND(F.lit(1))) == 1
    d_fit, d_all = (x or 0 for x in replies.where("k = 0").agg(F.sum(F.when(~dev, F.col("docs"))), F.sum("docs")).first())
    first = np.zeros(CELLS)
    for c, n in cells:
        ratio = _RATIO[c] * (v_fit + 1) / max(n_fit, 1)
        first[cell(np.array([ratio]))[0]] += n
    weights = [np.full(BUCKETS, learn(first))]

    answers = replies.where("chunk IS NOT NULL").select("chunk", "part", "k", "fit", "every", "path", "at", "size")
    for k in range(2, order + 1):
        known = list(weights)

        def ratios(own, k=k, known=known):
            counts, contexts = _Counts(own, order).of("fit", n_fit, d_fit)
            lower = probabilities(counts, contexts, v_fit, known, k - 1)
            seen = contexts[k - 1] > 0
            code = bucket(contexts[k - 1][seen]) * CELLS + cell(counts[k - 1][seen] / contexts[k - 1][seen] / lower[seen])
            code, n = np.unique(code, return_counts=True)
            return pa.table({"b": pa.array(code // CELLS, pa.int32()), "c": pa.array(code % CELLS, pa.int32()), "n": pa.array(n, pa.int64())})

        found = answers.where(dev).groupBy("chunk").applyInArrow(_alone(ratios), "b int, c int, n long")
        table = np.zeros((BUCKETS, CELLS))
        for b, c, n in found.groupBy("b", "c").agg(F.sum("n")).collect():  # at most BUCKETS * CELLS rows
            table[b, c] = n
        weights.append(np.array([learn(row) if row.sum() else 0.5 for row in table]))

    def scores(own):
        c = _Counts(own, order)
        counts, contexts = c.of("every", n_all, d_all)
        p = probabilities(counts, contexts, v_all, weights, order)
        add = lambda x: np.add.reduceat(x, c.starts) if len(c.starts) else np.zeros(0)
        base = np.log10((counts[0] + 0.1) / (n_all + 0.1 * (v_all + 1)))
        return pa.table([pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(c.sizes, pa.int64()), pa.array(add((counts[0] > 0).astype(np.int64))), pa.array(np.full(len(c.ids), n_all), pa.int64()), pa.array(add(base)), pa.array(add(np.log10(p)))], schema=_SCORES)

    return answers.groupBy("chunk").applyInArrow(_alone(scores), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _alone(f):
    """A function of exactly one table, as grouped maps want it."""
    return lambda table: f(table)
