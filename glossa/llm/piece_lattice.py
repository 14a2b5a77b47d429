"""SentencePiece encoding and decoding by a relational lattice.

Substrings of bounded length are exploded from each distinct word, equi-joined to the piece table, grouped by word into the edges of its
lattice, and folded with Spark's higher-order ``aggregate``:

* ``unigram`` piece tables: Viterbi, the path of the highest sum of scores;
* ``bpe`` piece tables: the edges are applied in the order of their scores, leftmost first, each joining two neighbours. A BPE model's
  scores are ranks, so a highest sum isn't what its library returns; this fold is, id by id.

Words are pieces of text that no piece can span: they end wherever two neighbours occur side by side in no piece, so before a space mark too. Texts
aren't shuffled: each partition of the documents sends its distinct words, gets a dictionary file back and assembles its texts with it. What a
dictionary doesn't hold (words too long to explode, or rows that another attempt placed elsewhere) is folded on the spot with the same result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import filesystem, materialize, released, shared_dir, ship

MARK = "▁"
#: Words up to this many code points are exploded; longer ones are folded where they are met.
LONGEST = 48
#: Words folded on the spot that a worker remembers before it starts afresh, words that it collects before it sends them, and rows that it handles at once.
REMEMBERED, COLLECTED, SLICE = 100_000, 100_000, 500
#: Characters that are cut at once.
BULK = 1 << 20
#: Distinct words of a task that folds lattices: their edges fit its memory.
PART_WORDS = 25_000
#: Characters below this number are found in an array.
TABLED = 0x250


class Pieces:
    """A piece table: what the lattice and the folds need of a model."""

    def __init__(self, rows: list[tuple[str, int, float]], unk: int, byte_ids: list[int] | None, kind: str, prefix: bool = True, specials: dict[int, str] | None = None) -> None:
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind of piece table: {kind}")
        self.rows, self.unk, self.byte_ids, self.kind, self.prefix = rows, unk, byte_ids, kind, prefix
        self.ids = {p: i for p, i, _ in rows}
        self.scores = {p: s for p, _, s in rows}
        self.longest = max(map(len, self.ids), default=1)
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.unk_score = min(self.scores.values(), default=0.0) - 10
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, i, _ in rows} | {i: s.encode() for i, s in (specials or {}).items()}
        self.byte_of = {i: b for b, i in enumerate(byte_ids or [])}
        self.bytes_of |= {i: bytes([b]) for i, b in self.byte_of.items()}
        self._beside: np.ndarray | None = None
        self.apart = not any(p[1] == MARK != p[0] for p in self.pairs)  # whether a mark after another character begins a word
        self.spelled = np.empty(max(self.bytes_of, default=0) + 1, object)
        for i, b in self.bytes_of.items():
            self.spelled[i] = b

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Pieces:
        """From a .model file; control, unknown and byte pieces are no edges."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        rows = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        own = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        byte_ids = [own[f"<0x{b:02X}>"] for b in range(256)] if len(own) == 256 else None
        return cls(rows, sp.unk_id(), byte_ids, kind, specials={sp.unk_id(): " ⁇ "} | {i: "" for i in range(n) if sp.is_control(i)})

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, score: as many rows as the vocabulary has, whatever the corpus."""
        return spark.createDataFrame(self.rows, "piece string, id int, score double")

    # ---- words

    def cut(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[int]]]:
        """The words of some texts, a bounded number of characters at a time: which text each run of them belongs to, the words of all runs, and where each run ends."""
        run, of, size = [], [], 0
        for at, t in enumerate(texts):
            if not t:
                continue
            t = (MARK if self.prefix else "") + t.replace(" ", MARK)
            for part in self._bounded(t) if len(t) > BULK else (t,):
                if size and size + len(part) > BULK:
                    yield of, *self._words(run)
                    run, of, size = [], [], 0
                run.append(part)
                of.append(at)
                size += len(part)
        if run:
            yield of, *self._words(run)

    def _bounded(self, marked: str) -> Iterator[str]:
        """A long text in parts that end where no piece can span: before a mark after another character, if there is one."""
        lo = 0
        while self.apart and len(marked) - lo > BULK:
            hi = marked.rfind(MARK, lo + 1, lo + BULK)
            while hi > lo + 1 and marked[hi - 1] == MARK:
                hi -= 1
            if hi <= lo + 1 and not (m := _START.search(marked, lo + 1)):
                break
            hi = hi if hi > lo + 1 else m.start() + 1
            yield marked[lo:hi]
            lo = hi
        yield marked[lo:]

    def _words(self, runs: list[str]) -> tuple[list[str], list[int]]:
        """Neighbours below 1022, and marks, are looked up in a square table, others in a sorted list."""
        if self._beside is None:
            self._beside = np.zeros(1 << 20, bool)
            odd = set()
            for x in self.pairs:
                a, b = (1023 if c == MARK else ord(c) for c in x)
                if max(a, b) < 1024 and 1022 not in (a, b) and not (1023 in (a, b) and "\u03ff" in x):
                    self._beside[a << 10 | b] = True
                else:
                    odd.add(ord(x[0]) << 32 | ord(x[1]))
            self._odd = np.array(sorted(odd), np.int64)
        text = "".join(runs)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        mark = c == ord(MARK)
        k = np.where(mark, 1023, np.minimum(c, 1022)).astype(np.int32)
        joined = self._beside[k[:-1] << 10 | k[1:]]
        big = np.flatnonzero(k == 1022)
        if len(big):
            at = np.unique(np.concatenate([big - 1, big]))
            at = at[(at >= 0) & (at < len(c) - 1)]
            code = c[at].astype(np.int64) << 32 | c[at + 1].astype(np.int64)
            found = np.searchsorted(self._odd, code)
            joined[at] = (found < len(self._odd)) & (self._odd[np.minimum(found, len(self._odd) - 1)] == code) if len(self._odd) else False
        ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
        joined[ends[:-1] - 1] = False
        stops = np.flatnonzero(~joined) + 1
        if "\0" in text:
            s = stops.tolist()
            words = [text[a:b] for a, b in zip([0, *s], [*s, len(text)], strict=True)]
        else:  # split by the interpreter, much faster than slices
            words = np.insert(c, stops, 0).tobytes().decode("utf-32-le", "surrogatepass").split("\0")
        return words, (np.searchsorted(stops, ends, "left") + 1).tolist()

    # ---- the folds in Python, for what isn't in a dictionary

    def of_char(self, c: str) -> list[int]:
        i = self.ids.get(c)
        if i is not None:
            return [i]
        return [self.unk] if self.byte_ids is None else [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]

    def fold(self, word: str) -> list[int]:
        return self._merge(word) if self.kind == "bpe" else self._viterbi(word)

    def _merge(self, word: str) -> list[int]:
        n = len(word)
        parts, after, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        ids, scores, heap = self.ids, self.scores, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (p := parts[i] + parts[j]) in ids:
                heapq.heappush(heap, (-scores[p], i, j, len(p)))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for p in parts if p for x in ([ids[p]] if p in ids else self.of_char(p))]

    def _viterbi(self, word: str) -> list[int]:
        n = len(word)
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                x = self.scores.get(word[s:e], self.unk_score if e == s + 1 else None)
                if x is not None and best[s] + x > best[e]:  # of equal sums the longest last piece
                    best[e], back[e] = best[s] + x, s
        out, e = [], n
        while e:
            out.append(word[back[e] : e])
            e = back[e]
        return [x for p in reversed(out) for x in ([self.ids[p]] if p in self.ids else self.of_char(p))]

    def decode(self, ids) -> str:
        """The text of some ids: bytes joined and read as UTF-8, space marks as spaces, the first one taken off."""
        s = b"".join(self.spelled[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")
        return s[1:] if self.prefix and s.startswith(" ") else s


_START = re.compile(f"[^{MARK}]{MARK}")


# ---- the lattice in Spark


def lattice(words: DataFrame, pieces: DataFrame, longest: int, tabled: int = 0) -> DataFrame:
    """word and edges, an array of (rank, start, ends, inner, id, text): all pieces in it, and each character that is none (id null).

    rank is the score with its sign turned, so that the best come first; ends has the bits of the two boundaries and inner those between them.
    Characters below ``tabled`` but a word's last aren't exploded alone: the fold finds them in an array by their number.
    words: distinct, in a column ``word``, partitioned by it, which the explosions and the broadcast join keep; so the grouping moves nothing.
    """
    n = F.char_length("word")
    subs = words.where("word <> ''").select("word", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    low = (F.expr("ascii(substring(word, s, 1))") < tabled).cast("int")
    most = F.least(F.lit(longest), n - F.col("s") + 1)
    # the last character always stays, so that every word has a row
    subs = subs.select("word", "s", F.explode(F.sequence(F.least(low + 1, F.greatest(most, F.lit(1))), F.greatest(most, F.lit(1)))).alias("l"))
    subs = subs.withColumn("piece", F.substring(F.col("word"), F.col("s"), F.col("l")))
    edges = subs.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR l = 1")
    ends = F.expr("shiftleft(1L, s - 1) | shiftleft(1L, s - 1 + l)")
    inner = F.expr("shiftleft(1L, s - 1 + l) - shiftleft(1L, s)")
    text = F.when(F.col("id").isNull(), F.col("piece"))
    return edges.groupBy("word").agg(F.collect_list(F.struct((-F.col("score")).alias("rank"), (F.col("s") - 1).alias("start"), ends.alias("ends"), inner.alias("inner"), "id", text.alias("text"))).alias("edges"))


def _ids(path: Column, unk: int, byte_ids: list[int] | None) -> Column:
    """The ids of a path of edges; a character that is no piece becomes its bytes, or the unknown piece."""
    plain = F.transform(path, lambda e: F.coalesce(e["id"], F.lit(unk)))
    if byte_ids is None:
        return plain
    table = F.lit(byte_ids)

    def spelled(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.element_at(table, F.conv(F.substring(F.hex(c), 2 * i - 1, F.lit(2)), 16, 10).cast("int") + 1))

    odd = F.flatten(F.transform(path, lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(spelled(e["text"]))))
    return F.when(F.exists(path, lambda e: e["id"].isNull()), odd).otherwise(plain)


def fold_bpe(lat: DataFrame, unk: int, byte_ids: list[int] | None, table: list[int | None] | None = None) -> DataFrame:
    """word, ids. The state is the set of boundaries as bits; each step takes the best edge over exactly one inner boundary and drops that."""
    d = lat.withColumn("ranked", F.sort_array(F.filter("edges", lambda x: x["inner"] != 0)))
    n = F.char_length("word")

    def step(m: Column, _: Column) -> Column:
        able = F.filter("ranked", lambda x: (F.bit_count(m.bitwiseAND(x["inner"])) == 1) & (m.bitwiseAND(x["ends"]) == x["ends"]))
        return F.coalesce(m.bitwiseAND(F.bitwise_not(F.get(able, F.lit(0))["inner"])), m)

    every = F.expr("shiftleft(1L, char_length(word) + 1) - 1")
    steps = F.when(F.size("ranked") > 0, F.sequence(F.lit(1), F.least(n - 1, F.size("ranked")))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("m", F.aggregate(steps, every, step))
    left = F.filter("edges", lambda x: (F.col("m").bitwiseAND(x["inner"]) == 0) & (F.col("m").bitwiseAND(x["ends"]) == x["ends"]))
    path = F.transform(left, lambda x: F.struct(x["start"].alias("start"), x["id"].alias("id"), x["text"].alias("text")))
    if table:
        ids = F.array(*[F.lit(i).cast("int") for i in table])
        char = lambda i: F.substring(F.col("word"), i + 1, F.lit(1))
        alone = lambda i: F.call_function("shiftrightunsigned", F.col("m"), i).bitwiseAND(F.lit(3)) == 3
        single = F.filter(F.sequence(F.lit(0), n - 2), lambda i: alone(i) & (F.ascii(char(i)) < len(table)))
        path = F.when(n > 1, F.concat(path, F.transform(single, lambda i: F.struct(i.alias("start"), F.element_at(ids, F.ascii(char(i)) + 1).alias("id"), char(i).alias("text"))))).otherwise(path)
    return d.select("word", _ids(F.sort_array(path), unk, byte_ids).alias("ids"))


def fold_viterbi(lat: DataFrame, unk: int, byte_ids: list[int] | None, unk_score: float) -> DataFrame:
    """word, ids. The state is one (sum, start, edge) a position; ties go to the longest last piece, as in Pieces.fold."""
    n = F.char_length("word")
    edge = "struct<rank:double,start:int,ends:bigint,inner:bigint,id:int,text:string>"
    cell = f"struct<a:double,s:int,x:{edge}>"
    first = F.array(F.struct(F.lit(0.0).alias("a"), F.lit(0).alias("s"), F.lit(None).cast(edge).alias("x")).cast(cell))

    def step(st: Column, i: Column) -> Column:
        ending = F.filter("edges", lambda x: F.call_function("shiftrightunsigned", x["ends"], i) == 1)
        scored = F.transform(ending, lambda x: F.struct((F.get(st, x["start"])["a"] - F.coalesce(x["rank"], F.lit(-unk_score))).alias("a"), (-x["start"]).alias("s"), x.alias("x")).cast(cell))
        return F.concat(st, F.array(F.array_max(scored)))

    d = lat.withColumn("best", F.aggregate(F.sequence(F.lit(1), n), first, step))

    def back(st: Column, _: Column) -> Column:
        here = F.get(F.col("best"), st["at"])
        return F.when(st["at"] == 0, st).otherwise(F.struct((-here["s"]).alias("at"), F.concat(F.array(here["x"]), st["path"]).alias("path")))

    path = F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), F.array().cast(f"array<{edge}>").alias("path")), back)["path"]
    return d.select("word", _ids(path, unk, byte_ids).alias("ids"))


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, ids for the distinct words (of at most LONGEST code points) in ``words``."""
    parts = max(1, -(-words.count() // PART_WORDS))
    own, table = words.select("word").repartition(parts, "word"), pieces.table(words.sparkSession)
    if pieces.kind == "bpe":
        return fold_bpe(lattice(own, table, pieces.longest, TABLED), pieces.unk, pieces.byte_ids, [pieces.ids.get(chr(c)) for c in range(TABLED)])
    lat = lattice(own, table, pieces.longest)
    return fold_viterbi(lat, pieces.unk, pieces.byte_ids, pieces.unk_score)


# ---- dictionaries


class Speller(dict):
    """Packed ids of words: those of a dictionary, and what the folds give for others, a bounded number of which is remembered."""

    def __init__(self, pieces: Pieces, known: dict[str, bytes] | None = None) -> None:
        super().__init__(known or {})
        self.pieces, self.other = pieces, {}

    def __missing__(self, w: str) -> bytes:
        got = self.other.get(w)
        if got is None:
            got = np.array(self.pieces.fold(w), "<i4").tobytes()
            if len(w) <= LONGEST:
                if len(self.other) >= REMEMBERED:
                    self.other.clear()
                self.other[w] = got
        return got

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        for of, words, ends in self.pieces.cut(texts):
            start = 0
            for at, end in zip(of, ends, strict=True):
                out[at].append(b"".join(map(self.__getitem__, words[start:end])))
                start = end
        return [np.frombuffer(x[0] if len(x) == 1 else b"".join(x), "<i4") for x in out]


def _load_dictionary(folder: str, chunk: int) -> dict[str, bytes]:
    import pyarrow.parquet as pq

    fs, root = filesystem(f"{folder}/chunk={chunk}")
    from pyarrow.fs import FileSelector, FileType

    known: dict[str, bytes] = {}
    for f in fs.get_file_info(FileSelector(root, allow_not_found=True)):
        if f.type == FileType.File and f.path.endswith(".parquet"):
            for b in pq.ParquetFile(fs.open_input_file(f.path)).iter_batches(columns=["words", "sizes", "ids"]):
                for words, sizes, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    at = 0
                    for w, n in zip(words.split("\0"), sizes, strict=True):
                        known[w] = ids[at : at + 4 * n]
                        at += 4 * n
    return known


def _dictionaries(docs: DataFrame, pieces: Pieces, text_col: str) -> str:
    """Write the encoded words of each partition of ``docs`` to a file of its own; the folder of them."""
    spark = docs.sparkSession

    def distinct(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        new: set[str] = set()
        for b in batches:
            for _, words, _ in pieces.cut(b.column(0).to_pylist()):
                new.update(words)
                if len(new) > COLLECTED:
                    yield send(chunk, new)
                    new = set()
        if new:
            yield send(chunk, new)

    def send(chunk: int, new: set[str]):
        own = [a for a in new if 1 < len(a) <= LONGEST and "\0" not in a]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk, np.int32)), pa.array(own, pa.string())], names=["chunk", "word"])

    pairs = docs.select(F.col(text_col)).mapInArrow(released(distinct), "chunk int, word string")
    # a word's list has at most one entry a partition of the documents
    vocabulary = materialize(pairs.groupBy("word").agg(F.collect_set("chunk").alias("chunks")), "vocabulary")
    encoded = encode_words(vocabulary, pieces)

    def by_chunk(batches):
        """Words and ids of each chunk in this partition, packed."""
        held: dict[int, list] = defaultdict(lambda: [[], [], []])
        size = 0

        def flush():
            rows = [{"chunk": c, "words": "\0".join(w), "sizes": n, "ids": b"".join(i)} for c, (w, n, i) in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("chunk", pa.int32()), ("words", pa.string()), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary())]))

        for b in batches:
            ids = b.column(2)
            sizes = np.diff(ids.offsets.to_numpy())
            raw = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            ends = 4 * np.cumsum(sizes)
            for w, chunks, n, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
                x = raw[e - 4 * n : e]
                for c in chunks:
                    h = held[c]
                    h[0].append(w)
                    h[1].append(n)
                    h[2].append(x)
                size += len(chunks)
            if size > 1_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    folder = shared_dir(spark, "spelling")
    packed = vocabulary.join(encoded, "word").select("word", "chunks", "ids").mapInArrow(released(by_chunk), "chunk int, words string, sizes array<int>, ids binary")
    n = max(1, docs.rdd.getNumPartitions())  # a task writes the dictionary of one partition
    packed.repartitionById(n, F.pmod("chunk", F.lit(n)).cast("int")).write.option("compression", "zstd").partitionBy("chunk").parquet(folder)
    return folder


_models: dict[tuple[str, str], Pieces] = {}


def _pieces(path: str, kind: str) -> Pieces:
    """One table a worker and file."""
    if (path, kind) not in _models:
        _models[path, kind] = Pieces.load(path, kind)
    return _models[path, kind]


def encode(docs: DataFrame, model: str, kind: str = "bpe", text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with all its columns and ``out``, the piece ids of the text as array<int>.

    A null or empty text has none. Rows that repeat are encoded each; an empty table gives an empty result. ``out`` must not be among the
    columns of ``docs`` (ValueError). ``docs`` is read twice and should be a table: what another partitioning of the second reading misses in
    the dictionaries is folded on the spot.
    """
    if out in docs.columns:
        raise ValueError(f"docs has a column {out} already")
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(out, ArrayType(IntegerType()), True)])
    return _assemble(docs, model, kind, text_col, schema, lambda own, b, ids: pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, out]), at)


def _assemble(docs: DataFrame, model: str, kind: str, text_col: str, schema, finish, at: int) -> DataFrame:
    """Encode the texts of ``docs`` and give what ``finish`` makes of each batch and its ids."""
    ship(docs.sparkSession)
    folder = _dictionaries(docs, _pieces(model, kind), text_col)

    def run(batches):
        from pyspark import TaskContext

        own = _pieces(model, kind)
        speller = None
        for whole in batches:
            speller = speller or Speller(own, _load_dictionary(folder, TaskContext.get().partitionId()))
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                ids = speller.texts(b.column(at).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield finish(own, b, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32())))

    return docs.mapInArrow(released(run), schema)


def decode(encoded: DataFrame, model: str, kind: str = "bpe", ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``, the text that its ids stand for; null ids give null."""
    ship(encoded.sparkSession)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        own = _pieces(model, kind)
        return pa.array([None if x is None else own.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn(out, text(F.col(ids_col)))


def digest(docs: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), decoded_crc32 (of the decoded text), ids for every row."""
    type_of = docs.schema[id_col].dataType.simpleString()

    def finish(own: Pieces, b: pa.RecordBatch, ids: pa.ListArray) -> pa.RecordBatch:
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4")
        crc, back = [], []
        for s, e in zip(offsets[:-1], offsets[1:], strict=True):
            crc.append(zlib.crc32(values[s:e]))
            back.append(zlib.crc32(own.decode(values[s:e]).encode("utf-8", "surrogatepass")))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(back, pa.int64()), ids], names=["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "ids"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _assemble(own, model, kind, "text", f"doc_id {type_of}, n_tokens long, ids_crc32 long, decoded_crc32 long, ids array<int>", finish, 1)
