"""Plain string functions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_whitespace(s: Column) -> Column:
    """Without leading and trailing spaces, tabs, line feeds and carriage returns."""
    return F.btrim(s, F.lit(" \t\n\r"))


def ends_with(s: Column, suffix: str) -> Column:
    return F.endswith(s, F.lit(suffix))


def lf_to_crlf(s: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.lit("\r\n"))


def current_day() -> Column:
    """Today as YYYY-MM-DD."""
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def codepoints(s: Column) -> Column:
    """Characters of a string as an array."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def codepoint_count(s: Column) -> Column:
    return F.char_length(s)


def byte_count(s: Column) -> Column:
    return F.octet_length(s)


def common_prefix(s: Column, query: str) -> Column:
    """How many leading code points a column shares with a fixed string; prefixes nest, so counting those it starts with is enough."""
    if not query:
        return F.lit(0)
    if len(query) > 64:
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(query))), F.lit(0), lambda n, i: n + F.startswith(s, F.substring(F.lit(query), F.lit(1), i)).cast("int"))
    return reduce(lambda a, b: a + b, (F.startswith(s, F.lit(query[:i])).cast("int") for i in range(1, len(query) + 1)))


def common_prefix_bytes(a: Column, b: Column) -> Column:
    """How many leading bytes two strings share."""
    x, y = F.hex(F.encode(a, "utf-8")), F.hex(F.encode(b, "utf-8"))
    n = F.when(a.isNotNull() & b.isNotNull(), F.least(F.octet_length(a), F.octet_length(b)))
    step = lambda m, i: F.when((m == i - 1) & (F.substring(x, 2 * i - 1, F.lit(2)) == F.substring(y, 2 * i - 1, F.lit(2))), i).otherwise(m)
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step))


def _by_length(suffixes: list[str]) -> list[tuple[int, str]]:
    """(rank, suffix) of distinct suffixes, those of more bytes first."""
    distinct = list(dict.fromkeys(s for s in suffixes if s))
    return sorted(enumerate(distinct), key=lambda x: (-len(x[1].encode()), x[0]))


def suffix_rank(s: Column, suffixes: list[str]) -> Column:
    """Rank of the longest (in bytes) suffix that the column ends with; null without one."""
    out = F.lit(None).cast("int")
    for rank, suffix in reversed(_by_length(suffixes)):
        out = F.when(F.endswith(s, F.lit(suffix)), F.lit(rank)).otherwise(out)
    return out


def suffix_length(s: Column, suffixes: list[str]) -> Column:
    """Code points of that suffix; 0 without one."""
    out = F.lit(0)
    for _, suffix in reversed(_by_length(suffixes)):
        out = F.when(F.endswith(s, F.lit(suffix)), F.lit(len(suffix))).otherwise(out)
    return out
