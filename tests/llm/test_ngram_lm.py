import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glossa.llm import ngram_lm as L


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]


def part(i):
    c = zlib.crc32(b"" if i is None else str(i).encode())
    return "held" if c % 10 == 0 else "dev" if c // 10 % 10 == 0 else "fit"


def brute(rows, order):
    """The whole model in dictionaries, with exact EM on the ratios' histogram cells."""
    def counted(which):
        n = [Counter() for _ in range(order + 1)]
        for i, t in rows:
            if part(i) in which:
                w = ["\t"] * (order - 1) + toks(t)
                n[0][()] += len(w) - order + 1
                for j in range(order - 1, len(w)):
                    for k in range(1, order + 1):
                        n[k][tuple(w[j - k + 1 : j + 1])] += 1
        docs = sum(part(i) in which for i, _ in rows)
        return n, docs

    def steps(w, j, n, docs):
        """(count, context count) by order at token j."""
        for k in range(1, order + 1):
            h = tuple(w[j - k + 1 : j])
            yield n[k][tuple(w[j - k + 1 : j + 1])], n[0][()] if k == 1 else docs if h == ("\t",) * (k - 1) else n[k - 1][h]

    def prob(w, j, n, docs, v, lam, upto):
        p = 1 / (v + 1)
        for k, (c, h) in enumerate(steps(w, j, n, docs)):
            if k < upto:
                x = lam[k][int(L.bucket(np.array([h]))[0])] if h else 0.0
                p = x * c / max(h, 1) + (1 - x) * p
        return p

    fit, dfit = counted({"fit"})
    lam = []
    for k in range(order):
        hist = np.zeros((L.BUCKETS, L.CELLS))
        for i, t in rows:
            if part(i) == "dev":
                w = ["\t"] * (order - 1) + toks(t)
                for j in range(order - 1, len(w)):
                    c, h = list(steps(w, j, fit, dfit))[k]
                    if k == 0:
                        r = L._RATIO[int(L.cell(np.array([float(c)]))[0])] * (len(fit[1]) + 1) / max(h, 1)
                        hist[:, int(L.cell(np.array([r]))[0])] += 1
                    elif h:
                        r = c / h / prob(w, j, fit, dfit, len(fit[1]), lam, k)
                        hist[int(L.bucket(np.array([h]))[0]), int(L.cell(np.array([r]))[0])] += 1
        lam.append([L.learn(x) if x.sum() else (0.0 if k == 0 else 0.5) for x in hist])
    every, docs = counted({"fit", "dev"})
    n, v = every[0][()], len(every[1])
    out = []
    for i, t in rows:
        w = ["\t"] * (order - 1) + toks(t)
        own = w[order - 1 :]
        out.append((i, part(i) == "held", len(own), sum(every[1][(x,)] > 0 for x in own), n, sum(math.log10((every[1][(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in own),
                    sum(math.log10(prob(w, j, every, docs, v, lam, order)) for j in range(order - 1, len(w)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rng = random.Random(order)
    words = ["the", "The", "cat", "sat", "on", "É", "mat", "a", "dog"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(rng.randrange(30)))) for i in range(150)]
    rows += [(None, "the cat"), (500, None), (501, ""), (7, "the the"), (7, "the the")]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted(((-1 if r[0] is None else r[0], *r[1:]) for r in L.score(df, order, 4, 200).collect()), key=str)
    want = sorted(((-1 if r[0] is None else r[0], *r[1:]) for r in brute(rows, order)), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_empty_table(spark):
    assert L.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weights_raise_the_likelihood_of_held_out_text(spark):
    """Texts with a strong word order: held-out documents are likelier under the model than under the unigrams."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        w = [rng.randrange(20)]
        for _ in range(30):
            w.append((w[-1] * 7 + rng.choice([1, 1, 1, 3])) % 20)
        rows.append((i, " ".join(f"t{x}" for x in w)))
    got = [r for r in L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)
