"""Searches over the distinct keys of some dictionaries. Results are distinct and in byte order unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import score_against, scores_against, weighted_distance, within
from ..functions.patterns import PatternError, compile_pattern, matches_at_start
from ..functions.text import byte_count, codepoint_count, common_prefix, suffix_length, suffix_rank
from ..plans.durable import ship
from .lookup import chosen


def _keys(d: DataFrame, hit: Column) -> DataFrame:
    return d.where(hit).select("key").distinct().orderBy("key")


def common_prefix_search(entries: DataFrame, query: str, names: list[str] | None = None) -> DataFrame:
    """key: those that the query starts with. Its prefixes are listed, which Parquet filters take as an IN."""
    return _keys(chosen(entries, names), F.col("key").isin([query[:i] for i in range(1, len(query) + 1)]))


def _neighbours(entries: DataFrame, query: str, names: list[str] | None) -> list[str]:
    """The keys just before and after the query in byte order: one of them shares the longest prefix with it."""
    d, k = chosen(entries, names), F.col("key")
    r = d.agg(F.max(F.when(k <= query, k)), F.min(F.when(k >= query, k))).first()
    return [x for x in r if x is not None]


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def longest_prefix_len(entries: DataFrame, query: str, names: list[str] | None = None) -> int:
    """Bytes of the longest prefix that the query shares with any key; it may end inside of both."""
    return max((_shared(query.encode(), k.encode()) for k in _neighbours(entries, query, names)), default=0)


def longest_key_prefix_len(entries: DataFrame, query: str, names: list[str] | None = None) -> int:
    """Bytes of the longest key that the query starts with."""
    return common_prefix_search(entries, query, names).agg(F.coalesce(F.max(F.octet_length("key")), F.lit(0))).first()[0]


def predictive_search(entries: DataFrame, prefix: str, names: list[str] | None = None) -> DataFrame:
    """key: those that start with the prefix; all for an empty one. Pushed to the scan."""
    return _keys(chosen(entries, names), F.startswith("key", F.lit(prefix)) if prefix else F.lit(True))


def edit_distance_search(entries: DataFrame, query: str, limit: int = 1, names: list[str] | None = None, insert_cost: int = 1, delete_cost: int = 1, replace_cost: int = 2) -> DataFrame:
    """key: those at a weighted distance of at most ``limit``; none for an empty query."""
    return _keys(chosen(entries, names), within(F.col("key"), query, limit, insert_cost, delete_cost, replace_cost) if query else F.lit(False))


def prefix_distance_search(entries: DataFrame, query: str, limit: int = 1, names: list[str] | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """key, distance, suffix_rank, in the order of distance, rank of the suffix (none last), bytes descending, key.

    With c code points of a key shared with the query, p after those, and L the most that any key shares, the distance is L - c + p, less the
    length of the key's prior suffix if p is not 0. Keys that share nothing are left out.
    """
    d, suffixes = chosen(entries, names), suffixes or []
    most = max((len(query.encode()[: _shared(query.encode(), k.encode())].decode("utf-8", "ignore")) for k in _neighbours(entries, query, names)), default=0)
    k = F.col("key")
    d = d.where(F.startswith(k, F.lit(query[:1])) if most else F.lit(False)).select("key").distinct()
    c = common_prefix(k, query)
    rest = codepoint_count(k) - c
    real = F.lit(most) - c + rest
    d = d.withColumn("distance", F.when(rest == 0, real).otherwise(F.greatest(F.lit(0), real - suffix_length(k, suffixes))))
    d = d.where(F.col("distance") <= limit).withColumn("suffix_rank", suffix_rank(k, suffixes))
    return d.orderBy("distance", F.col("suffix_rank").asc_nulls_last(), byte_count(k).desc(), "key")


def suggestions(entries: DataFrame, query: str, names: list[str] | None = None) -> DataFrame:
    """key, score of the corrections, the best first, then by key.

    In each dictionary those at the smallest distance tier that has any: 1 for one letter, 2 for two, 2 then 3 for more.
    """
    ship(entries.sparkSession)
    n = len(query)
    low, high = (1 if n <= 1 else 2), min(n, 3)
    d = chosen(entries, names).where(within(F.col("key"), query, high) if n else F.lit(False)).select("dict", "key").distinct()
    d = d.withColumn("tier", F.greatest(weighted_distance(F.col("key"), query), F.lit(low)))
    # the least tier of each dictionary is aggregated and joined back, so no dictionary has to fit a task
    d = d.join(d.groupBy("dict").agg(F.min("tier").alias("tier")), ["dict", "tier"]).select("key").distinct()
    return d.withColumn("score", score_against(query)("key")).orderBy(F.desc("score"), "key")


def scores(entries: DataFrame, query: str, names: list[str] | None = None) -> DataFrame:
    """key, jaro, jaro_winkler, sound, score of every key against the query."""
    ship(entries.sparkSession)
    return chosen(entries, names).select("key").distinct().withColumn("s", scores_against(query)("key")).select("key", "s.*")


def suggest(entries: DataFrame, query: str, names: list[str] | None = None) -> DataFrame:
    """key: the corrections in order."""
    return suggestions(entries, query, names).select("key")


def spellcheck(entries: DataFrame, query: str, limit: int = 10, names: list[str] | None = None) -> DataFrame:
    """key, score of the ``limit`` best corrections."""
    return suggestions(entries, query, names).limit(limit)


def regex_search(entries: DataFrame, pattern: str, names: list[str] | None = None) -> tuple[DataFrame, str]:
    """key: those that the pattern matches from their start, not necessarily to their end; and an error text, empty if all is well."""
    d = chosen(entries, names)
    try:
        compiled = compile_pattern(entries.sparkSession, pattern)
    except PatternError as e:
        return _keys(d, F.lit(False)), str(e)
    return _keys(d, matches_at_start(F.col("key"), pattern, compiled)), ""


def matching(entries: DataFrame, predicate, names: list[str] | None = None) -> DataFrame:
    """key: those for which a function of the key column holds."""
    return _keys(chosen(entries, names), predicate(F.col("key")))
