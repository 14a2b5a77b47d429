"""Distances between words: the indel distance as a native expression, the spelling scores as Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def weighted_distance(s: Column, query: str, insert: int = 1, delete: int = 1, replace: int = 2) -> Column:
    """Edit distance of a column to a fixed word over code points; one row of the table a character, folded by ``aggregate``.

    The first row and column count 1 a step, whatever the costs.
    """
    n = len(query)
    letters = F.split(F.lit(query), "") if query else F.array().cast("array<string>")

    def row(state: Column, c: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            left = F.element_at(new, j) + insert
            up = F.element_at(state, j + 1) + delete
            across = F.element_at(state, j) + F.when(F.element_at(letters, j) == c, 0).otherwise(replace)
            return F.concat(new, F.array(F.least(left, up, across)))

        start = F.array(F.element_at(state, F.lit(1)) + 1)
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, cell) if n else start

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.element_at(F.aggregate(chars, F.lit(list(range(n + 1))), row), F.lit(n + 1))


def within(s: Column, query: str, limit: int, insert: int = 1, delete: int = 1, replace: int = 2) -> Column:
    """Whether the weighted distance is at most ``limit``. Cheap native bounds come first where they hold.

    With costs of at least 1 the distance is no less than the difference in length and than the ordinary Levenshtein distance, which has a
    banded implementation that gives up early.
    """
    exact = weighted_distance(s, query, insert, delete, replace) <= limit
    if min(insert, delete, replace) < 1:
        return exact
    band = F.char_length(s).between(len(query) - limit, len(query) + limit)
    return F.when(band & (F.levenshtein(s, F.lit(query), limit) >= 0), exact).otherwise(F.lit(False))


_ALIKE = {frozenset(p) for p in (b"ao", b"ae", b"iy", b"ou")}
_DIGRAPHS = {(a, b) for x, y in ((b"ir", b"er"), (b"ur", b"er"), (b"ir", b"ur"), (b"er", b"ar")) for a, b in ((x, y), (y, x))}


def sound_similarity(query: str, word: str) -> float:
    """1 less a normalised edit cost over bytes in which doubled letters cost half and letters or digraphs that sound alike little or nothing."""
    a, b = query.encode(), word.encode()
    if not a and not b:
        return 1.0
    na, nb = len(a), len(b)
    row = [float(j) for j in range(nb + 1)]
    grow = [0.5 if j + 1 < nb and b[j] == b[j + 1] else 1.0 for j in range(nb)]
    for i in range(na):
        shrink = 0.5 if i + 1 < na and a[i] == a[i + 1] else 1.0
        new = [i + 1.0]
        for j in range(nb):
            if a[i] == b[j]:
                swap = 0.0
            elif frozenset((a[i], b[j])) in _ALIKE:
                swap = 0.25
            elif i + 1 < na and j + 1 < nb and (a[i] == b[j + 1] and b[j] == a[i + 1] or (a[i : i + 2], b[j : j + 2]) in _DIGRAPHS):
                swap = 0.0
            else:
                swap = 1.0
            new.append(min(row[j + 1] + grow[j], new[j] + shrink, row[j] + swap))
        row = new
    return 1.0 - row[nb] / max(na, nb)


def jaro(query: str, word: str) -> float:
    """A Jaro similarity over bytes in which a matched byte may match again."""
    a, b = query.encode(), word.encode()
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    shared = lambda x, y: [c for i, c in enumerate(x) if c in y[max(0, i - reach) : i + reach + 1]]
    p, q = shared(a, b), shared(b, a)
    if not p or not q:
        return 0.0
    t = sum(x != y for x, y in zip(p, q)) / 2  # noqa: B905 - up to the shorter
    m = float(len(p))
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler(query: str, word: str) -> float:
    """With a bonus of a tenth of what is missing for each byte of the common prefix, without a limit; it may exceed 1."""
    d = jaro(query, word)
    if not d:
        return 0.0
    n = 0
    for x, y in zip(query.encode(), word.encode()):  # noqa: B905
        if x != y:
            break
        n += 1
    return d + n * 0.1 * (1.0 - d)


def spelling_score(query: str, word: str) -> float:
    """How good a correction a word is: 1 for itself."""
    return 1.0 if query == word else jaro_winkler(query, word) * sound_similarity(query, word)


def score_against(query: str):
    """Arrow function of a word column: its spelling score against one query."""

    @F.pandas_udf("double")
    def score(words: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else spelling_score(query, w) for w in words], dtype="float64")

    return score


def scores_against(query: str):
    """Arrow function of a word column: what its spelling score against one query is made of."""

    @F.pandas_udf("jaro double, jaro_winkler double, sound double, score double")
    def scores(words: pd.Series) -> pd.DataFrame:
        w = ["" if x is None else x for x in words]
        return pd.DataFrame({"jaro": [jaro(query, x) for x in w], "jaro_winkler": [jaro_winkler(query, x) for x in w], "sound": [sound_similarity(query, x) for x in w], "score": [spelling_score(query, x) for x in w]})

    return scores


@F.pandas_udf(DoubleType())
def score_pairs(queries: pd.Series, words: pd.Series) -> pd.Series:
    """Spelling score of a word column against a query column."""
    return pd.Series([None if q is None or w is None else spelling_score(q, w) for q, w in zip(queries, words, strict=True)], dtype="float64")
