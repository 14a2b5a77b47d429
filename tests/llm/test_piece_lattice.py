import random
import zlib

import numpy as np
import pytest

from glossa.llm import piece_lattice as L

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(rng, n):
    bits = ["the", " ", "  ", "hello", "World", "\n", "\t", "é", "漢字", ".com", "'s", "***", "123", "ﬁ", "▁", "x" * 30, "ing", "_id", "😀", "tion", "\0", "ab" * 40]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_python_fold_equals_the_library(library):
    pieces = L.Pieces.load(PATH)
    s = L.Speller(pieces)
    for t in texts(random.Random(1), 1500):
        assert s.texts([None, t, ""])[1].tolist() == library.encode(t), repr(t)
        assert pieces.decode(library.encode(t)) == library.decode(library.encode(t)), repr(t)


def words_of(text, pieces):
    """One neighbour after the other."""
    t = L.MARK + text.replace(" ", L.MARK)
    out = [t[0]]
    for a, b in zip(t, t[1:]):
        if a + b in pieces.pairs:
            out[-1] += b
        else:
            out.append(b)
    return out


@pytest.mark.parametrize("bulk", [1 << 20, 40, 3])
def test_words_are_cut_as_one_by_one(bulk, monkeypatch):
    monkeypatch.setattr(L, "BULK", bulk)
    pieces = L.Pieces.load(PATH)
    assert pieces.apart
    every = [*texts(random.Random(7), 400), "\u03ffa a\u03ff", "\u03fea", "x", "é漢e", "   ", "a   b  ", "漢字仮名", "", None]
    got = [[] for _ in every]
    for of, words, ends in pieces.cut(every):
        start = 0
        for at, end in zip(of, ends, strict=True):
            got[at] += words[start:end]
            start = end
        assert start == len(words)
    assert got == [words_of(t, pieces) if t else [] for t in every]


def test_lattice_fold_equals_the_library(spark, library):
    pieces = L.Pieces.load(PATH)
    words = {a for t in texts(random.Random(2), 300) + ["internationalisation dictionaries unfathomable Überraschung señor"] for a in words_of(t, pieces) if len(a) <= L.LONGEST and "\0" not in a}
    got = {r.word: r.ids for r in L.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    assert got == {w: pieces.fold(w) for w in words}


def tiny(kind):
    rng = random.Random(3)
    own = {"a": -1.0, "b": -1.2, "c": -1.4, "ab": -1.9, "bc": -2.2, "abc": -3.0, "aa": -1.7, "cab": -2.6, "▁": -2.0, "▁a": -2.1}
    return L.Pieces([(p, i + 1, s + rng.random() / 10) for i, (p, s) in enumerate(own.items())], 0, None, kind)


def every_split(word, pieces):
    if not word:
        yield 0.0, []
    for k in range(1, min(len(word), pieces.longest) + 1):
        p = word[:k]
        if p in pieces.ids or k == 1:
            for s, rest in every_split(word[k:], pieces):
                yield pieces.scores.get(p, pieces.unk_score) + s, [pieces.ids.get(p, 0), *rest]


@pytest.mark.parametrize("kind", ["unigram", "bpe"])
def test_folds_equal_brute_force_on_a_small_table(spark, kind):
    pieces, rng = tiny(kind), random.Random(4)
    words = {"".join(rng.choice("aabc▁z") for _ in range(rng.randrange(1, 9))) for _ in range(200)}
    got = {r.word: r.ids for r in L.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    assert got == {w: pieces.fold(w) for w in words}
    if kind == "unigram":
        assert got == {w: max(every_split(w, pieces), key=lambda x: x[0])[1] for w in words}


def test_documents(spark, library):
    rng = random.Random(5)
    rows = [(i, t, "x") for i, t in enumerate(texts(rng, 60))] + [(100, None, None), (101, "", "x"), (None, "the hello", "y"), (3, "the hello", "y"), (3, "the hello", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = L.encode(df, PATH)
    assert got.columns == ["doc_id", "text", "score", "ids"]
    out = got.collect()
    assert len(out) == len(rows) and all(r.ids == library.encode(r.text or "") for r in out)
    back = L.decode(got, PATH).collect()
    assert all(r.decoded == library.decode(r.ids) for r in back)
    d = L.digest(df, PATH).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in d) == sorted((len(x := library.encode(t or "")), zlib.crc32(np.array(x, "<i4").tobytes())) for _, t, _ in rows)
    assert all(r.decoded_crc32 == zlib.crc32(library.decode(r.ids).encode()) for r in d)
    assert L.encode(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        L.encode(got, PATH)
