import random

import pytest
from pyspark.sql import functions as F

from glossa.functions import distance as D
from glossa.functions import patterns as P
from glossa.functions import text as T


def indel(a, b, ins=1, dele=1, rep=2):
    row = list(range(len(a) + 1))
    for c in b:
        new = [row[0] + 1]
        for i, x in enumerate(a):
            new.append(min(new[i] + ins, row[i + 1] + dele, row[i] + (0 if x == c else rep)))
        row = new
    return row[-1]


def words(rng, n, alphabet="abcéü漢😀"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize("costs", [(1, 1, 2), (1, 1, 1), (2, 1, 3), (0, 1, 2)])
def test_weighted_distance(spark, costs):
    rng = random.Random(1)
    own = sorted(set(words(rng, 150)))
    df = spark.createDataFrame([(w,) for w in own], "w string")
    for q in words(rng, 3) + ["", "abc"]:
        got = {r.w: r.d for r in df.select("w", D.weighted_distance(F.col("w"), q, *costs).alias("d")).collect()}
        assert got == {w: indel(q, w, *costs) for w in own}
        near = {r.w for r in df.where(D.within(F.col("w"), q, 3, *costs)).collect()}
        assert near == {w for w in own if indel(q, w, *costs) <= 3}


def test_published_scores():
    for w, s in {"dictionary": 0.544, "dilo": 0.438889, "diol": 0.438889, "radicicola": 0.42, "decoat": 0.4, "disc": 0.303704, "io": 0.185185, "coca": 0.175926}.items():
        assert D.spelling_score("dicioa", w) == pytest.approx(s, abs=1e-6)
    assert D.spelling_score("same", "same") == 1.0 and D.spelling_score("ab", "xy") == 0.0 and D.sound_similarity("", "") == 1.0


def test_text_functions(spark):
    df = spark.createDataFrame([(" \ta b\r\n",), ("x\ny",), ("振り返る",), ("",), (None,)], "s string")
    r = df.select(T.trim_whitespace(F.col("s")), T.lf_to_crlf(F.col("s")), T.byte_count(F.col("s")), T.codepoint_count(F.col("s")), T.ends_with(F.col("s"), "る"), T.common_prefix(F.col("s"), "振りx"), T.common_prefix_bytes(F.col("s"), F.lit("振る")), T.codepoints(F.col("s"))).collect()
    assert [tuple(x) for x in r] == [("a b", " \ta b\r\r\n", 7, 7, False, 0, 0, list(" \ta b\r\n")), ("x\ny", "x\r\ny", 3, 3, False, 0, 0, list("x\ny")), ("振り返る", "振り返る", 12, 4, True, 2, 5, list("振り返る")), ("", "", 0, 0, False, 0, 0, []), (None,) * 8]
    assert df.select(T.common_prefix(F.col("s"), "振り" + "x" * 80).alias("c")).collect()[2].c == 2
    s = ["する", "う", "る", "返る", "る"]
    r = df.select(T.suffix_rank(F.col("s"), s).alias("r"), T.suffix_length(F.col("s"), s).alias("n")).collect()[2]
    assert (r.r, r.n) == (3, 2)
    assert len(df.select(T.current_day().alias("d")).first().d) == 10


def test_patterns(spark):
    assert P.literal_prefix("dict.*y") == "dict" and P.literal_prefix("dicts?") == "dict" and P.literal_prefix("a|b") == "" and P.literal_prefix("abc") == "abc" and P.literal_prefix("(?i)ab") == ""
    df = spark.createDataFrame([("ab1",), ("Ab",), ("ß!",), ("a\nb",), ("[x",)], "k string")
    for p, want in {"[[:alpha:]]+": {"ab1", "Ab", "ß!", "a\nb"}, r"\w": {"ab1", "Ab", "ß!", "a\nb"}, "b": set(), "a.b": set(), "(?P<x>A)b$": {"Ab"}, r"\[": {"[x"}, "[[]": {"[x"}, r"\Q[\Ex": {"[x"}, "[[:^alpha:]]": {"[x"}, "x*": {"ab1", "Ab", "ß!", "a\nb", "[x"}}.items():
        assert {r.k for r in df.where(P.matches_at_start(F.col("k"), p, P.compile_pattern(spark, p))).collect()} == want, p
    for p in ("a(b", "a)b", "[", r"a\Kb", "(?R)", "(*ACCEPT)", "(?(1)a)", "[[:nope:]]"):
        with pytest.raises(P.PatternError):
            P.compile_pattern(spark, p)
