"""Searches for a whole table of queries(word) at once, as equi-joins wherever the predicate has one."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.distance import score_pairs
from ..plans.durable import materialize, ship
from .lookup import chosen


def common_prefix_join(entries: DataFrame, queries: DataFrame, names: list[str] | None = None) -> DataFrame:
    """word, key: the keys that each word starts with, by exploding its prefixes."""
    q = queries.select("word").distinct().where("word <> ''")
    p = q.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("key"))
    return p.join(chosen(entries, names).select("key").distinct(), "key").select("word", "key")


def predictive_join(entries: DataFrame, queries: DataFrame, names: list[str] | None = None, longest: int | None = None) -> DataFrame:
    """word, key: the keys that start with each word, by exploding the prefixes of the keys up to the longest word."""
    q = queries.select("word").distinct().where("word <> ''")
    longest = longest or q.agg(F.max(F.char_length("word"))).first()[0] or 0
    k = chosen(entries, names).select("key").distinct().where("key <> ''")
    p = k.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.char_length("key"), F.lit(max(longest, 1)))), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("word"))
    return p.join(q, "word").select("word", "key")


#: Words longer than this are sought by their pieces; what deletions leave of shorter ones is listed.
LONG = 32

#: Up to so many words are measured against each key of a length near theirs: cheaper than listing what deletions leave of all those keys.
FEW = 32


def _cuts(d: DataFrame, c: str, limit: int) -> DataFrame:
    """c, v, n: what is left of each word after n deletions, their places ascending so that each set of places comes once."""
    level = d.select(c, F.col(c).alias("v"), F.lit(0).alias("n"), F.lit(1).alias("at"))
    out = level
    for n in range(1, limit + 1):
        level = level.where(F.col("at") <= F.char_length("v")).select(c, "v", F.explode(F.sequence("at", F.char_length("v"))).alias("at"))
        rest = F.concat(F.substring("v", F.lit(1), F.col("at") - 1), F.substring("v", F.col("at") + 1, F.char_length("v")))
        level = level.select(c, rest.alias("v"), F.lit(n).alias("n"), "at")
        out = out.unionByName(level)
    return out.drop("at")


def _short_pairs(words: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """Pairs of which some string is left after i and j deletions, i + j <= limit: met by the string and j, so that no pair is made that doesn't count."""
    w = _cuts(words, "word", limit).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(limit) - F.col("n")))).withColumnRenamed("n", "n_word")
    k = _cuts(keys, "key", limit).withColumnRenamed("n", "m")
    return w.join(k, ["v", "m"]).groupBy("word", "key").agg(F.min(F.col("n_word") + F.col("m")).alias("distance"))


@F.pandas_udf(IntegerType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    """The indel distance: lengths less twice the longest common subsequence, a row of bits a letter."""

    def one(x: str, y: str) -> int:
        places: dict[str, int] = {}
        for i, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for c in y:
            u = row & places.get(c, 0)
            row = (row + u | row - u) & full
        return len(x) + len(y) - 2 * (len(x) - row.bit_count())

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def _long_pairs(words: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """Of limit + 1 pieces of a word one is whole in any key that close, at most limit letters from its place."""
    n = F.char_length("word")
    piece = F.expr(f"transform(sequence(0, {limit}), j -> struct(j AS j, CAST(floor(j * n / {limit + 1}) AS INT) AS a, CAST(floor((j + 1) * n / {limit + 1}) AS INT) AS b))")
    w = words.select("word", n.alias("n")).select("word", "n", F.explode(piece).alias("x")).select("word", "n", F.col("x.j").alias("j"), F.expr("substring(word, x.a + 1, x.b - x.a)").alias("v"))
    k = keys.select("key", F.explode(F.sequence(F.char_length("key") - limit, F.char_length("key") + limit)).alias("n")).where(F.col("n") > LONG)
    k = k.join(words.select(n.alias("n")).distinct(), "n", "left_semi")
    k = k.select("key", "n", F.explode(piece).alias("x")).select("key", "n", "x", F.explode(F.sequence(F.lit(-limit), F.lit(limit))).alias("s"))
    k = k.where("x.a + s >= 0").select("key", "n", F.col("x.j").alias("j"), F.expr("substring(key, x.a + s + 1, x.b - x.a)").alias("v"))
    near = w.join(k, ["n", "j", "v"]).select("word", "key").distinct().where(F.levenshtein("word", "key", limit) >= 0)
    return near.withColumn("distance", _indel("word", "key")).where(F.col("distance") <= limit)


def _few_pairs(words: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """Each key is measured against the words of a length near its own; natively first, which leaves little for ``_indel``."""
    n = F.char_length("word")
    w = words.select("word", F.explode(F.sequence(n - limit, n + limit)).alias("_n"))
    near = keys.join(F.broadcast(w), F.char_length("key") == F.col("_n")).drop("_n").where(F.levenshtein("word", "key", limit) >= 0).distinct()
    return near.withColumn("distance", _indel("word", "key")).where(F.col("distance") <= limit)


def _close(keys: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """word and distance beside the columns of keys (key, dict), distinct. The keys are computed once, only those of a length that some word comes near."""
    ship(keys.sparkSession)
    n, m = F.char_length("word"), F.char_length("key")
    words = materialize(queries.select("word").distinct().where("word <> ''"), "words")
    sizes = [r[0] for r in words.select(F.least(n, F.lit(LONG + 1)).alias("n")).distinct().collect()]  # at most LONG + 1
    near = sorted({i for size in sizes if size <= LONG for i in range(max(size - limit, 1), size + limit + 1)})
    short, long = m.isin(near), m > LONG - limit if LONG + 1 in sizes else F.lit(False)
    keys = keys.where("key <> ''").where(short | long).distinct()
    if words.limit(FEW + 1).count() <= FEW:
        return _few_pairs(words, keys, limit)
    keys = materialize(keys, "keys")
    alone = keys.select("key").distinct()
    parts = [_short_pairs(words.where(n <= LONG), alone.where(short), limit)] if near else []
    if LONG + 1 in sizes:
        parts.append(_long_pairs(words.where(n > LONG), alone.where(long), limit))
    pairs = reduce(DataFrame.unionByName, parts)
    return pairs.join(keys, "key") if len(keys.columns) > 1 else pairs


def edit_distance_join(entries: DataFrame, queries: DataFrame, limit: int = 1, names: list[str] | None = None) -> DataFrame:
    """word, key, distance: all pairs at an indel distance of at most ``limit``.

    Two words are that close if and only if some string is left of both after deleting i letters of one and j of the other with
    i + j <= limit, and the distance is the least such sum. So both sides explode what deletions leave and meet in a hash join; words of more than LONG letters,
    of which too much is left, meet by a piece instead and are then measured. Keys whose length no word comes near aren't exploded. A few words are measured against the keys as they are.
    """
    return _close(chosen(entries, names).select("key"), queries, limit).select("word", "key", "distance")


def suggest_join(entries: DataFrame, queries: DataFrame, names: list[str] | None = None, limit: int = 10) -> DataFrame:
    """word, key, score, rank: the ``limit`` best corrections of each word, tiers taken dictionary by dictionary."""
    n = F.char_length("word")
    d = _close(chosen(entries, names).select("dict", "key"), queries, 3).withColumn("tier", F.greatest("distance", F.when(n <= 1, 1).otherwise(2))).where(F.col("tier") <= F.least(n, F.lit(3)))
    d = d.withColumn("first", F.min("tier").over(Window.partitionBy("word", "dict"))).where("tier = first").select("word", "key").distinct()
    d = d.withColumn("score", score_pairs("word", "key"))
    rank: Column = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "key"))
    return d.withColumn("rank", rank).where(F.col("rank") <= limit)
