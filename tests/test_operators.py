"""Operators on hand-written dictionaries with literal expected rows."""

import random

import pytest

from glossa.operators import batch, lookup, search
from glossa.sources.records import from_lists

EN = "a an ant dice dictation dictator diction dictionary disc missionary ordinary donary".split()
EN2 = "ant anthem diction dictionaries dicionary".split()
JK = "振り 振り乱す 振り仰ぐ 振り返る 알다 알아내다 알아듣다 알아보 알아보- 알아보다 é éa".split()
P = "する う く ぐ す つ ぬ ぶ む る い 하다 다".split()


@pytest.fixture(scope="module")
def e(spark):
    own = [from_lists(spark, ks, [f"{n}:{k}" for k in ks], n) for n, ks in (("en", EN), ("en2", EN2), ("jk", JK))]
    d = own[0].union(own[1]).union(own[2]).union(from_lists(spark, ["ant", "ant"], ["second", "third"], "en"))
    return d.cache()


def keys(d):
    return [r.key for r in d.collect()]


def test_prefix_searches(e):
    assert keys(search.common_prefix_search(e, "anthems", ["en", "en2"])) == ["a", "an", "ant", "anthem"]
    assert [search.longest_prefix_len(e, q, n) for q, n in (("anthems", ["en"]), ("anthems", ["en", "en2"]), ("dictionarx", ["en"]), ("振り返ってみます", ["jk"]), ("ê", ["jk"]), ("zzz", ["en"]), ("", None))] == [3, 6, 9, 10, 1, 0, 0]
    assert search.longest_key_prefix_len(e, "anthems", ["en"]) == 3 and search.longest_key_prefix_len(e, "x") == 0
    assert keys(search.predictive_search(e, "dictio", ["en", "en2"])) == ["diction", "dictionaries", "dictionary"]
    assert keys(search.predictive_search(e, "", ["en2"])) == sorted(EN2)
    assert keys(search.predictive_search(e, "a", ["none"])) == []


def test_longest_prefix_is_the_most_that_any_key_shares(spark):
    rng = random.Random(1)
    ks = sorted({"".join(rng.choice("abé漢") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    d = from_lists(spark, ks, ks, "x").cache()
    for _ in range(15):
        q = "".join(rng.choice("abé漢ê") for _ in range(rng.randrange(7)))
        want = max((next((i for i, (x, y) in enumerate(zip(q.encode() + b"\0", k.encode() + b"\1")) if x != y)) for k in ks), default=0)
        assert search.longest_prefix_len(d, q) == want


def test_edit_distance(e):
    got = lambda k: keys(search.edit_distance_search(e, "dicionary", k, ["en", "en2"]))
    assert got(0) == ["dicionary"] and got(1) == got(2) == ["dicionary", "dictionary"] and got(3) == ["dicionary", "dictionary", "donary"]
    assert got(5) == ["dicionary", "diction", "dictionaries", "dictionary", "donary", "missionary", "ordinary"]
    assert keys(search.edit_distance_search(e, "", 3)) == []


def test_suggest(e):
    got = lambda q, n: [(r.key, round(r.score, 6)) for r in search.suggestions(e, q, n).collect()]
    assert [(k, round(s, 3)) for k, s in got("dicionary", ["en", "en2"])] == [("dicionary", 1.0), ("dictionary", 0.879)]
    assert got("diktion", ["en"]) == [("diction", 0.791837)]
    assert got("ab", ["en"]) == [("a", 0.425), ("an", 0.35)]
    assert got("b", ["en"]) == got("ê", ["jk"]) == got("", None) == []
    assert got("dicioa", ["en"]) == [("diction", 0.638889)]
    assert keys(search.suggest(e, "dicionary", ["en", "en2"])) == ["dicionary", "dictionary"]
    assert keys(search.spellcheck(e, "ab", 1, ["en"])) == ["a"]


def test_regex(e):
    got = lambda p: keys(search.regex_search(e, p, ["en"])[0])
    assert got("dic.*n") == ["dictation", "diction", "dictionary"] and got("i") == got("di.$") == []
    assert got(".*ary$") == ["dictionary", "donary", "missionary", "ordinary"]
    d, error = search.regex_search(e, "a(b", ["en"])
    assert error and keys(d) == []
    assert search.regex_search(e, "a")[1] == ""
    assert keys(search.matching(e, lambda k: k.endswith("hem"))) == ["anthem"]


def test_prefix_distance(e):
    got = lambda q, m, n, p=P: [(r.key, r.distance) for r in search.prefix_distance_search(e, q, m, n, p).collect()]
    assert got("振り返ってみます", 2, ["jk"]) == [("振り返る", 0), ("振り", 1), ("振り仰ぐ", 2), ("振り乱す", 2)]
    assert got("알아보겠습", 2, ["jk"]) == [("알아보다", 0), ("알아보", 0), ("알아보-", 1), ("알아내다", 2), ("알아듣다", 2), ("알다", 2)]
    assert got("알아보겠습", 0, ["jk"]) == [("알아보다", 0), ("알아보", 0)]
    assert got("알아보겠습", 2, ["jk"], []) == [("알아보", 0), ("알아보다", 1), ("알아보-", 1)]
    assert got("dictionarx", 3, ["en", "en2"], []) == [("dictionary", 1), ("diction", 2), ("dictionaries", 3)]
    assert got("", 3, None) == got("x", 3, None) == []


def test_lookups(e):
    assert lookup.contains(e, "ant", ["en2"]) and not lookup.contains(e, "anthem", ["en"]) and not lookup.contains(e, "")
    assert sorted(r.value for r in lookup.exact_match(e, "ant", ["en"]).collect()) == ["en:ant", "second", "third"]
    assert {r["dict"]: len(r["values"]) for r in lookup.exact_match_lists(e, "ant").collect()} == {"en": 3, "en2": 1}
    assert lookup.value_at(e, "disc", "en") == "en:disc"
    with pytest.raises(KeyError):
        lookup.value_at(e, "nope", "en")


def test_key_codes(spark):
    d = from_lists(spark, ["b", "a", "b", "c"], list("1234"), "x").union(from_lists(spark, ["z", "b"], list("56"), "y"))
    got = {(r["dict"], r.key): (r.first_index, r.dup_count, r.code) for r in lookup.key_codes(d).collect()}
    assert got == {("x", "a"): (0, 0, 0), ("x", "b"): (1, 1, (1 << 32) + 1), ("x", "c"): (3, 0, 3), ("y", "b"): (0, 0, 0), ("y", "z"): (1, 0, 1)}


def test_redirects(spark):
    link = lookup.LINK
    d = from_lists(spark, ["a", "a", "b", "b", "c", "x"], ["A1", f"{link} b {link}zzz", "B1", f"{link}c", f"{link}a", f"{link}nowhere"], "n").union(from_lists(spark, ["a"], ["other"], "m"))
    assert lookup.lookup(d, "a") == {"n": ["A1", "B1"], "m": ["other"]}
    assert lookup.lookup(d, "b", ["n"]) == {"n": ["B1", "A1"]} and lookup.lookup(d, "x") == {"n": []} and lookup.lookup(d, "q") == {}
    starts = spark.createDataFrame([("a",), ("c",), ("x",), ("q",)], "start string")
    got = sorted((r["dict"], r.start, r.key, r.value) for r in lookup.resolve(d, starts).collect())
    assert got == [("m", "a", "a", "other"), ("n", "a", "a", "A1"), ("n", "a", "b", "B1"), ("n", "c", "a", "A1"), ("n", "c", "b", "B1")]


def test_batch_forms_equal_the_single_ones(spark, e):
    qs = ["dicionary", "anthems", "ab", "diktion", "b", "", "an", "dict"]
    q = spark.createDataFrame([(w,) for w in qs], "word string")
    names = ["en", "en2"]
    pairs = lambda d: sorted((r.word, r.key) for r in d.collect())
    assert pairs(batch.common_prefix_join(e, q, names)) == sorted((w, k) for w in qs for k in keys(search.common_prefix_search(e, w, names)))
    assert pairs(batch.predictive_join(e, q, names)) == sorted((w, k) for w in qs if w for k in keys(search.predictive_search(e, w, names)))
    for k in (1, 3):
        assert pairs(batch.edit_distance_join(e, q, k, names)) == sorted((w, x) for w in qs for x in keys(search.edit_distance_search(e, w, k, names)))
    got = sorted((r.word, r.key, round(r.score, 9)) for r in batch.suggest_join(e, q, names).collect())
    assert got == sorted((w, r.key, round(r.score, 9)) for w in qs for r in search.suggestions(e, w, names).collect())
    assert sorted(r.word for r in lookup.contains_many(e, q, names).collect()) == ["an", "dicionary"]
    assert sorted(r.word for r in lookup.missing(e, q, names).collect()) == sorted(set(qs) - {"an", "dicionary"})
    assert {(r.word, r["dict"], r.value) for r in lookup.exact_match_many(e, q, names).collect()} == {("an", "en", "en:an"), ("dicionary", "en2", "en2:dicionary")}


def test_edit_distance_join_of_short_and_long_words(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 2, 3, 4, 6, 9, 12, 30, 31, 32, 33, 34, 35, 60, 61)]

    def changed(w):
        w = list(w)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.5:
                w.insert(at, rng.choice("abcé"))
            elif at < len(w):
                del w[at]
        return "".join(w)

    keys = sorted({changed(w) for w in base for _ in range(5)} - {""})
    words = sorted({changed(w) for w in base for _ in range(3)} - {""})

    def indel(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] if x == y else min(row[j], new[-1]) + 1)
            row = new
        return row[-1]

    e = spark.createDataFrame([("d", i, k, "") for i, k in enumerate(keys)], "dict string, entry_no long, key string, value string")
    q = spark.createDataFrame([(w,) for w in words], "word string")
    for limit in (1, 3):
        got = sorted(map(tuple, batch.edit_distance_join(e, q, limit).select("word", "key", "distance").collect()))
        assert got == sorted((w, k, d) for w in words for k in keys if (d := indel(w, k)) <= limit)


def test_joins_by_distance_read_the_entries_once_and_give_the_same_for_few_and_many_words(spark, monkeypatch):
    rng = random.Random(7)
    ks = sorted({"".join(rng.choice("abé") for _ in range(rng.choice((1, 2, 3, 5, 7, 31, 34)))) for _ in range(150)})
    d = from_lists(spark, ks * 2, ks * 2, "x").union(from_lists(spark, ks[::2], ks[::2], "y")).union(from_lists(spark, [""], [""], "y"))
    words = sorted({k[:i] + k[i + 1 :] for i, k in enumerate(rng.sample(ks, 40))} | {"", "ab", ks[0]})
    q = spark.createDataFrame([(w,) for w in words], "word string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    total, e, found = d.count(), d.mapInPandas(counted, d.schema), []
    for few in (0, 1000):
        monkeypatch.setattr(batch, "FEW", few, raising=False)
        for join in (batch.suggest_join, lambda e, q: batch.edit_distance_join(e, q, 2)):
            before = read.value
            found.append(sorted(map(tuple, join(e, q).collect())))
            assert read.value - before == total
    assert found[:2] == found[2:] and all(found)
    best = {w: [(r.key, round(r.score, 9)) for r in search.spellcheck(d.where("key <> ''"), w).collect()] for w in words[::16]}
    assert best == {w: [(k, round(s, 9)) for _, k, s, _ in sorted((x for x in found[0] if x[0] == w), key=lambda x: x[3])] for w in best}
