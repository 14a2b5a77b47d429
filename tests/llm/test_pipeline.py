"""The pipeline against one that keeps its documents in a list."""

import hashlib
import random

import pytest

import corpus_pipeline
from glossa.llm import near_dedup, pii, quality

P = pytest.importorskip("public_tokenizers")


def brute(rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    rows = [r for r in rows if quality.judge(r["text"])["kept"]]
    fps = {r["doc_id"]: near_dedup.fingerprint(r["text"]) for r in rows}
    comp = {}
    for d in sorted(fps):
        if d not in comp:
            todo = [d]
            comp[d] = d
            while todo:
                x = todo.pop()
                for e in fps:
                    if e not in comp and (fps[x] ^ fps[e]).bit_count() <= 3:
                        comp[e] = d
                        todo.append(e)
    rows = [r for r in rows if comp[r["doc_id"]] == r["doc_id"]]
    rows = [r | {"text": (t := pii.redact(r["text"], pii.scan(r["text"])[1])), "n_chars": len(t)} for r in rows]
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + len(quality.words_of(r["text"]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        lam = (total - sum(2 * size[s] for s in full)) / sum(w[s] for s in names if s not in full)
        more = {s for s in names if w[s] * lam >= 2 * size[s]}
        if more <= full:
            break
        full |= more
    out = []
    for r in rows:
        s = r["source"]
        rate = min(w[s] * lam, 2.0 * size[s]) / size[s]
        draw = int(hashlib.md5(f"42:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        out += [(r["doc_id"], r["text"], r["lang"], s, r["n_chars"], tuple(sp.encode(r["text"])))] * (int(rate) + (draw < rate - int(rate)))
    return sorted(out, key=str)


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("al", "Be", "ga", "dé", "ep") for b in ("ta", "ma", "lon", "rst")]
    rows = []
    for i in range(120):
        t = " ".join(rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(rng.choice([20, 60, 80]))) + "."
        if i % 9 == 0:
            t = t.replace(" ", "*** ")
        if i % 4 == 0:
            t += " Write to ann@example.com or bob (at) example (dot) org."
        rows.append({"doc_id": i, "text": t, "lang": "en", "source": rng.choice(["s1", "s2", "s3", "s4", None]), "n_chars": len(t)})
    rows += [r | {"doc_id": 500 + i, "source": "s1"} for i, r in enumerate(rows[:25])]
    rows.append({"doc_id": 900, "text": None, "lang": None, "source": "s1", "n_chars": 0})
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars, tuple(r.ids)) for r in got.collect()), key=str) == brute(rows)


def test_stages_keep_the_columns_of_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, "")
        assert got.columns == empty.columns + ["ids"] * (name == "encode_pieces") and got.count() == 0, name
