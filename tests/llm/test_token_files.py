import functools
import random
import zlib

import numpy as np
import pytest

from glossa.llm import token_files as T

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))


def test_elias_fano_selects_and_decodes():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (5, 3), (1000, 10), (1000, 10**9), (200, 1)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = T.EliasFano.from_bytes(T.EliasFano.build(v).to_bytes())
        assert e.decode().tolist() == v.tolist() == [e.select(i) for i in range(n)]
        with pytest.raises(IndexError):
            e.select(n)
    v = np.cumsum(rng.integers(1, 4000, 100_000))
    assert T.EliasFano.build(v).nbytes * 8 / len(v) < 2 + np.log2(2000) + 2.5


@functools.cache
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def library(text):
    return plain().encode(text, add_special_tokens=False).ids


def test_cached_encoding_equals_the_library():
    rng = random.Random(4)
    enc = T.encoder(PATH)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "²", "x'", "'s", "'ll ", "1", "23", ".", "!!", "_", "漢", " ", "<|endoftext|>", " ", "ß", "\x1c"]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == library(t), repr(t)


def test_added_tokens_get_their_ids(spark):
    from tokenizers import Tokenizer

    usual = Tokenizer.from_file(PATH)
    ids = lambda t: usual.encode(t, add_special_tokens=False).ids
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b  c", "<|endoftext|", "no such"]
    assert ids(texts[1]) == [usual.token_to_id("<|endoftext|>")]
    enc, rng = T.encoder(PATH, added=True), random.Random(5)
    for _ in range(1000):
        t = "".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "'s", "1", ".", "<|endoftext|>"]) for _ in range(rng.randrange(10)))
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == ids(t), repr(t)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in T.read_tokens(spark, T.write_tokens(df, PATH)).collect()}
    assert got == {i: (len(x := [*ids(t), 0]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in enumerate(texts)}


def test_write_and_read_back(spark):
    rows = [(i, f"doc {i} " + "word " * (i % 7), i) for i in range(60)] + [(7, "again", 1)] * 30 + [(None, "no id", 0), (61, None, 0), (62, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(5)
    files = T.write_tokens(df, PATH, parts=6)
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.read_tokens(spark, files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(-1 if r[0] is None else r[0] for r in rows)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    want = sorted((-1 if i is None else i, len(x := [*library(t or ""), 0]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((a, c, d) for a, _, c, d in got) == want
    r = T.Reader(files[0][1])
    assert sum(len(r[i]) for i in range(len(r))) == files[0][3]
    assert T.read_tokens(spark, T.write_tokens(df.limit(0), PATH)).count() == 0


def test_document_ids_are_coded():
    rng = random.Random(9)
    for ids in ([], [None], [None, None, 5], [-(2**63), -1, 0, 2**63 - 1], sorted(rng.randrange(-1000, 10**6) for _ in range(3000)), [7] * 50):
        ends = np.cumsum([rng.randrange(40) for _ in ids])
        width, back, ef = T.unpack_index(T.pack_index(ids, ends, 2))
        assert width == 2 and back == ids and ef.decode().tolist() == ends.tolist()
    ids = list(range(100_000, 200_000))
    assert len(T.pack_index(ids, np.arange(100_000) * 300, 2)) < 100_000 * 1.8
