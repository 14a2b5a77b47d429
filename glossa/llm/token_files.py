"""Token ids in binary files whose document boundaries are Elias-Fano coded.

A shard is two files. ``<shard>.ids`` is the concatenated id array, little-endian, 2 bytes an id where the vocabulary allows it, else 4.
``<shard>.ef`` holds the cumulative ends of the documents: with n documents and u ids the low
``floor(log2(u / n))`` bits of each end are packed, the high ones are a unary bit vector with the bit position of every 64th one stored
beside it (in 4 bytes, where they are enough), about ``2.5 + log2(u / n)`` bits a document altogether. ``select`` finds any boundary from those without decoding the
rest. The document ids, which ascend, are a second such sequence of their distances from the first.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, parts_for, shared_dir, ship

MAGIC = b"GLEF2\0\0\0"
EVERY = 64


class EliasFano:
    """A non-decreasing sequence of non-negative numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, u = len(v), int(v[-1]) + 1 if len(v) else 1
        low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
        bits = np.zeros(n * low_bits, np.uint8)
        for b in range(low_bits):
            bits[b::low_bits] = (v >> np.uint64(b)) & np.uint64(1)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        marks = ones[::EVERY].astype(np.uint32 if len(high) < 1 << 32 else np.uint64)
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), np.packbits(high, bitorder="little"), marks)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest mark, over at most 64 ones, plus its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.marks[i // EVERY]), i % EVERY
        while left:  # skip whole bytes, then bits
            byte = int(self.high[(at + 1) >> 3]) >> ((at + 1) & 7)
            c = byte.bit_count()
            if c < left:
                left -= c
                at = (at + 1 | 7)
                continue
            while left:
                at += 1
                left -= byte & 1
                byte >>= 1
        low = 0
        for b in range(self.low_bits):
            p = i * self.low_bits + b
            low |= (int(self.low[p >> 3]) >> (p & 7) & 1) << b
        return (at - i) << self.low_bits | low

    def decode(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        v = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")
        for b in range(self.low_bits):
            v |= bits[b : self.n * self.low_bits : self.low_bits].astype(np.uint64) << np.uint64(b)
        return v.astype(np.int64)

    @property
    def size(self) -> int:
        """Bytes that to_bytes gives."""
        return 48 + self.nbytes

    def to_bytes(self) -> bytes:
        head = struct.pack("<6Q", self.n, self.low_bits, len(self.low), len(self.high), len(self.marks), self.marks.itemsize)
        return head + self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> EliasFano:
        n, low_bits, x, y, z, w = struct.unpack_from("<6Q", b)
        low, high = np.frombuffer(b, np.uint8, x, 48), np.frombuffer(b, np.uint8, y, 48 + x)
        return cls(n, low_bits, low, high, np.frombuffer(b, f"<u{w}", z, 48 + x + y))

    @property
    def nbytes(self) -> int:
        return len(self.low) + len(self.high) + self.marks.nbytes


def pack_index(doc_ids: list[int | None], ends: np.ndarray, width: int) -> bytes:
    """Contents of an .ef file. The ids ascend, absent ones first."""
    absent = sum(x is None for x in doc_ids)
    ids = np.array(doc_ids[absent:], np.int64)
    first = int(ids[0]) if len(ids) else 0
    with np.errstate(over="ignore"):
        away = EliasFano.build(ids.view(np.uint64) - np.uint64(first % 2**64))  # modulo 2^64, so that any two ids may meet
    return MAGIC + struct.pack("<QQq", width, absent, first) + away.to_bytes() + EliasFano.build(ends).to_bytes()


def unpack_index(b: bytes) -> tuple[int, list[int | None], EliasFano]:
    """Bytes an id, document ids and ends of an .ef file."""
    if b[:8] != MAGIC:
        raise ValueError("not a boundary file")
    width, absent, first = struct.unpack_from("<QQq", b, 8)
    away = EliasFano.from_bytes(b[32:])
    with np.errstate(over="ignore"):
        ids = (away.decode().view(np.uint64) + np.uint64(first % 2**64)).view(np.int64)
    return width, [None] * absent + ids.tolist(), EliasFano.from_bytes(b[32 + away.size :])


class Reader:
    """Random access to one shard: ``reader[i]`` reads only that document's ids."""

    def __init__(self, stem: str) -> None:
        self.fs, self.path = filesystem(stem)
        with self.fs.open_input_file(f"{self.path}.ef") as f:
            self.width, self.doc_ids, self.ends = unpack_index(f.read())
        self.ids = self.fs.open_input_file(f"{self.path}.ids")

    def __len__(self) -> int:
        return self.ends.n

    def __getitem__(self, i: int) -> np.ndarray:
        start = self.ends.select(i - 1) if i else 0
        return np.frombuffer(self.ids.read_at((self.ends.select(i) - start) * self.width, start * self.width), f"<u{self.width}").astype(np.uint32)


# ---- encoding

_cache: dict[tuple[str, bool], object] = {}
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf" ?[{_LETTERS}]+\Z")
_KNOWN = re.compile(rf" ?[{_LETTERS}0-9{_MARKS}]+(?:\n[{_LETTERS}0-9{_MARKS}]+)*\Z")
_PRE = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n")
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Words a worker remembers before it starts afresh.
CACHE_WORDS = 600_000


def _byte_chars() -> dict[int, int]:
    """The printable stand-ins of byte-level BPE, from Latin-1 code points."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class _Memo(dict):
    """What a function gives for strings, worked out when first met; starts afresh when it holds CACHE_WORDS."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, s: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[s] = self.of(s)
        return got


class Encoder:
    """Encodes as the tokenizers library does, remembering the ids of words.

    The pre-tokenizer's pattern never matches across the place before a single space between two others, so a text may be cut there and
    the pieces encoded each by itself. Where a word has only Latin letters, digits, ASCII punctuation but the apostrophe, and single line feeds, its
    pre-tokens are certain and the library's model gives their ids; anything else goes through the whole library. Added tokens such as ``<|endoftext|>`` are
    ordinary text, or with ``added`` what the library makes of them by default: a text that holds one goes through it whole.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        names = [t.content for t in self.tok.get_added_tokens_decoder().values()] if added else []
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.pack = np.dtype(f"<u{self.width}")
        self.model = self.tok.model
        self.bytes = _byte_chars()
        self.parts = _Memo(self._part)
        self.words = _Memo(lambda w: self.word(" " + w))

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.pack).tobytes()

    def _part(self, s: str) -> bytes:
        """One pre-token."""
        return self.packed([t.id for t in self.model.tokenize(s.translate(self.bytes) if s.isascii() else s.encode().decode("latin1").translate(self.bytes))])

    def word(self, w: str) -> bytes:
        """A word with the space before it, if any."""
        if _PLAIN.match(w):
            return self._part(w)
        if _KNOWN.match(w):
            return b"".join(map(self.parts.__getitem__, _PRE.findall(w)))
        return self.packed(self.tok.encode(w, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids as packed little-endian numbers."""
        if not text:
            return b""
        if self.added and self.added.search(text):
            return self.packed(self.tok.encode(text, add_special_tokens=False).ids)
        if "  " in text or text[0].isspace() or text[-1].isspace() or _SPACE_NEIGHBOUR.search(text):
            return b"".join(map(self.word, _CUT.split(text)))
        first, *rest = text.split(" ")
        return self.word(first) + b"".join(map(self.words.__getitem__, rest))


_SPACE_NEIGHBOUR = re.compile(r"(?: [^\S ])|(?:[^\S ] )")


def encoder(path: str, added: bool = False) -> Encoder:
    """One encoder a worker, file and way with added tokens."""
    if (path, added) not in _cache:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _cache[path, added] = Encoder(path, added)
    return _cache[path, added]


# ---- files


def _bounds(docs: DataFrame, id_col: str, parts: int) -> np.ndarray:
    """Quantiles of the ids, one column of one scan; a repeated one stands for ids that fill several parts."""
    if parts < 2:
        return np.zeros(0, np.int64)
    at = [i / parts for i in range(1, parts)]
    got = docs.select(F.col(id_col).cast("long").alias("i")).agg(F.percentile_approx("i", at, 100 * parts)).first()[0]
    return np.array(got or [], np.int64)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, parts: int | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int, int]]:
    """Encode every text, append end_id, write shards in ascending id order: (part, stem, documents, ids) for each.

    A null text has no ids but the end. Added tokens in a text get their ids, as the library has it by default. Null ids come first; rows that repeat an id stay, in the order of their bytes, and ids that hold more than a
    part's worth of rows are spread over several. Texts are encoded where they are read; what is shuffled, once, is the packed ids.
    A retried task writes files of new names; only those of the attempt that Spark accepted are listed.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_dir(spark, "tokens")
    parts = parts or parts_for(docs)
    bounds = _bounds(docs, id_col, parts)

    def encode(batches):
        import zstandard

        enc, squeeze = encoder(tokenizer, added=True), zstandard.ZstdCompressor(level=1).compress
        tail = enc.packed([end_id]) if end_id is not None else b""
        encode_text = enc.encode
        for b in batches:
            ids = b.column(0).to_pylist()
            packed = [encode_text(t) + tail if t else tail for t in b.column(1).to_pylist()]
            where = []
            for i, p in zip(ids, packed, strict=True):
                lo, hi = (0, 0) if i is None else (int(np.searchsorted(bounds, i, "left")), int(np.searchsorted(bounds, i, "right")))
                # a value that is k bounds fills the parts between them: rows go to one by their bytes, whose order is kept
                where.append(lo if lo == hi else lo + 1 + (zlib.crc32(p) * (hi - lo) >> 32))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), b.column(0), pa.array([zlib.crc32(p) for p in packed], pa.int64()), pa.array(list(map(squeeze, packed)), pa.binary())], names=["part", "id", "crc", "ids"])

    def write(batches):
        import zstandard

        width, expand = encoder(tokenizer, added=True).width, zstandard.ZstdDecompressor().decompress
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, out = None, None

        def close():
            out.close()
            stem = f"{name}.ef"
            with fs.open_output_stream(f"{root}/{stem}") as f:
                f.write(pack_index(ids, np.cumsum(sizes), width))
            return pa.RecordBatch.from_pylist([{"part": part, "stem": f"{folder}/{name}", "docs": len(ids), "ids": sum(sizes)}], schema=_LISTED)

        for b in batches:
            for p, i, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if p != part:
                    if out is not None:
                        yield close()
                    part, ids, sizes, name = p, [], [], f"{p:06d}-{uuid.uuid4().hex[:8]}"
                    out = fs.open_output_stream(f"{root}/{name}.ids")
                raw = expand(z)
                out.write(raw)
                ids.append(i)
                sizes.append(len(raw) // width)
        if out is not None:
            yield close()

    d = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(encode, "part int, id long, crc long, ids binary")
    d = d.repartitionById(parts, "part").sortWithinPartitions("part", "id", "crc", "ids")
    return sorted((r.part, r.stem, r.docs, r.ids) for r in d.mapInArrow(write, "part int, stem string, docs long, ids long").collect())  # one row a file


_LISTED = pa.schema([("part", pa.int32()), ("stem", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def read_tokens(spark, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files: one task a file, documents in slices."""
    ship(spark)
    rows, start = [], 0
    for at, (_, stem, _, n) in enumerate(files):
        rows.append((at, stem, start))
        start += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches):
        for b in batches:
            for stem, first in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                r = Reader(stem)
                ends = r.ends.decode()
                starts = np.concatenate([[0], ends[:-1]])
                for lo in range(0, len(ends), 1024):
                    hi = min(lo + 1024, len(ends))
                    ids = np.frombuffer(r.ids.read_at(int(ends[hi - 1] - starts[lo]) * r.width, int(starts[lo]) * r.width), f"<u{r.width}").astype("<u4")
                    crc = [zlib.crc32(ids[s - starts[lo] : e - starts[lo]]) for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)]
                    cols = [pa.array(r.doc_ids[lo:hi], pa.int64()), pa.array(starts[lo:hi] + first), pa.array(ends[lo:hi] - starts[lo:hi]), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    d = spark.createDataFrame(rows, "at int, stem string, start long").repartitionById(len(rows), "at")
    return d.mapInArrow(read, schema)
