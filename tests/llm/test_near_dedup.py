import random
import re

import numpy as np
import xxhash

from glossa.llm import near_dedup as N


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    near, comp = {}, {}
    for d, f in fps:
        near[d] = sum(1 for e, g in fps if e != d and (f ^ g).bit_count() <= 3)
    for d, f in sorted(fps):
        if d in comp:
            continue
        todo, comp[d] = [f], d
        while todo:
            x = todo.pop()
            for e, g in fps:
                if e not in comp and (x ^ g).bit_count() <= 3:
                    comp[e] = d
                    todo.append(g)
    return near, comp


def test_fingerprint():
    rng = random.Random(1)
    for t in (None, "", " \n", "One", "one TWO", "É É É a", "a b c a b c a b c", *(" ".join(rng.choice("abcDE é") * rng.randrange(1, 4) for _ in range(rng.randrange(60))) for _ in range(200))):
        assert N.fingerprint(t) == brute_fp(t)


def clustered(rng, n):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64) if rng.random() < 0.3 or not out else rng.choice(list(out)[:50])
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return out


def test_walk_finds_each_pair_once_over_both_tries():
    rng = random.Random(2)
    for n in (0, 1, 2, 50, 400):
        f = np.array(sorted(clustered(rng, n)), np.uint64)
        i, j = N.walk(f, f, 0, 3, -1, True)
        got = [frozenset((int(f[a]), int(f[b]))) for a, b in zip(i, j)]
        s = np.sort((f << np.uint64(32)) | (f >> np.uint64(32)))
        i, j = N.walk(s, s, 0, 3, 1, True)
        back = lambda x: (x << 32 | x >> 32) & (2**64 - 1)
        got += [frozenset((back(int(s[a])), back(int(s[b])))) for a, b in zip(i, j)]
        want = {frozenset((int(x), int(y))) for x in f for y in f if x != y and (int(x) ^ int(y)).bit_count() <= 3}
        assert len(got) == len(want) and set(got) == want


def run(spark, fps, limit):
    df = spark.createDataFrame([(f - (f >> 63 << 64), 1) for f in {f for _, f in fps}], "fp long, n long")
    return N.links(df, 3, limit)


def test_links_through_many_nodes_equal_brute_force(spark):
    rng = random.Random(3)
    f = clustered(rng, 500)
    for limit in (4, 10_000):  # many levels in Spark, or none
        near = {r.fp & (2**64 - 1): r.near for r in run(spark, [(i, x) for i, x in enumerate(f)], limit).groupBy("fp").agg({"near": "sum"}).withColumnRenamed("sum(near)", "near").collect()}
        assert near == {x: n for x in f if (n := sum(1 for y in f if y != x and (x ^ y).bit_count() <= 3))}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Eps", "é"]) + str(rng.randrange(30)) for _ in range(80)) for _ in range(12)]
    rows = []
    for i in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i * 3, " ".join(w), i))
    rows += [(1000, None, 0), (1001, "", 0), (1002, " ", 0)] + [(2000 + i, base[0], 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_near long").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.n_near, r.component_id) for r in N.near_duplicates(df, limit=8).collect()}
    fps = [(d, brute_fp(t)) for d, t, _ in rows]
    near, comp = brute(fps)
    assert got == {d: (f"{f:016x}", near[d], comp[d]) for d, f in fps}
    kept = N.keep_one(df, limit=8)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))
    assert N.near_duplicates(df.limit(0)).count() == 0
    doubled = spark.createDataFrame([(1, "a b c", 0), (1, "a b c", 0), (None, "a b c", 0)], df.schema)
    assert sorted(r.doc_id or 0 for r in N.keep_one(doubled).collect()) == [0, 1]
    assert sorted((r.doc_id or 0, r.n_near, r.component_id) for r in N.near_duplicates(doubled).collect()) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_rows_of_one_id_are_decided_on_in_each_component(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(1, texts[0], 0), (5, texts[0], 1), (5, texts[1], 2), (7, texts[2], 3), (7, texts[3], 4), (7, texts[3], 4), (9, texts[3], 5), (None, texts[0], 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_near long").repartition(3)
    assert sorted(r.n_near for r in N.keep_one(df).collect()) == [0, 2, 3, 4, 6]
    assert N.keep_one(df).columns == df.columns


def test_components_of_a_long_chain(spark):
    rng = random.Random(5)
    ids = rng.sample(range(-5000, 5000), 300)
    e = list(zip(ids, ids[1:])) + [(6000, 7000)]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert all(got.get(x, x) == min(ids) for x in ids) and got[7000] == 6000


def test_columns_may_have_any_name(spark):
    names = ["_id", "_fp", "_key", "_root", "_pick", "_first", "fp", "root", "n"]
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    rows = [(d, t, *[i] * len(names)) for i, (d, t) in enumerate([(1, texts[0]), (5, texts[0]), (5, texts[1]), (5, texts[1]), (None, texts[1])])]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names]).repartition(3)
    got = N.keep_one(df)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "5", "None"]


def test_hot_keys_are_broadcast(spark, monkeypatch):
    from glossa.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 4)
    monkeypatch.setattr(common, "HOT_KEYS", 8)
    monkeypatch.setattr(N, "HOT_ROWS", 4)
    rng = random.Random(7)
    ids = rng.sample(range(-500, 500), 60)
    e = [(ids[0], x) for x in ids[1:40]] + list(zip(ids[40:], ids[41:])) + [(ids[40], ids[3])]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert all(got.get(x, x) == min(ids) for x in ids)
    rows = [(i, "same text here") for i in range(40)] + [(100 + i, f"text {i} " * 30) for i in range(20)]
    per = {r.doc_id: r.n_near for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(per) == 60 and all(per[i] == 39 for i in range(40))


def test_partners_across_the_top_bit_at_the_deepest_level(spark, monkeypatch):
    monkeypatch.setattr(N, "STEP", 16)
    f = {x ^ (b << 63) for x in (3, 77 << 40, 5 << 20) for b in (0, 1)}
    near = {r.fp & (2**64 - 1): r.near for r in run(spark, list(enumerate(f)), 1).groupBy("fp").agg({"near": "sum"}).withColumnRenamed("sum(near)", "near").collect()}
    assert near == {x: n for x in f if (n := sum(1 for y in f if y != x and (x ^ y).bit_count() <= 3))} and len(near) == 6
