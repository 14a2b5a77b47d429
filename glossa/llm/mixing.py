"""Mixing sources to target weights: tokens a source, repetition rates, then copies of whole documents.

A source of size s and target t has the rate t / s; each of its documents is taken floor(rate) times, and once more if a
hash of the seed and its id, read as a number in [0, 1), is below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, global_row_number, materialize, sized_join

WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for a table of (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes. A target stops at
    ``cap`` times its source's size and the excess is shared again by weight until none is above. Each round of that is one
    aggregate over the table of sources, and the driver sees two sums.
    """
    if share > cap:
        raise ValueError("the sources can't hold that share under this cap")
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by = global_row_number(materialize(by.withColumn("_last", F.col("source").isNull()), "sources"), ["_last", "source"], "_no")
    w = F.lit(weights[-1])
    for i, x in enumerate(weights[:-1]):
        w = F.when(F.pmod("_no", F.lit(len(weights))) == i, F.lit(x)).otherwise(w)
    by = materialize(by.withColumn("_w", w), "weights")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_w") * F.lit(level) >= F.col("source_size") * F.lit(cap)
        n, held, rest = by.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("_w")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (share * total - cap * (held or 0)) / rest
    target = F.lit(0.0) if level is None else F.least(F.col("_w") * F.lit(float(level)), F.col("source_size") * F.lit(float(cap)))
    return by.select("source", "source_size", target.alias("target"))


def draws(seed: int, doc_id: Column, rate: Column) -> Column:
    """floor(rate) copies, and one more where the id's hash under the seed falls below the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))).cast("long")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    small = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    return materialize(small, "words")


def mix(docs: DataFrame, seed: int = 42, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row.

    copies depends on the seed, the id and the source's rate only, so reruns agree and rows that repeat an id are decided alike.
    A null text has size 0, a null id is hashed as the empty string, a null source is a source. A source of size 0 has the target 0
    and its rows no copies. An empty table gives an empty result. The join is by source with 32 salts unless the table of
    sources is small enough to broadcast; texts are not shuffled.
    """
    small = _sizes(docs, id_col, text_col, source_col)
    d = sized_join(small, source_targets(small, share, cap, weights), "source", row_bytes=256)
    d = d.withColumn("copies", draws(seed, F.col("doc_id"), _rate()))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def expand(docs: DataFrame, seed: int = 42, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus itself: each row of ``docs``, with all its columns, as often as ``mix`` takes it.

    Rates are joined by source as in ``mix``. Columns of ``docs`` may have any name.
    """
    rate, copy = fresh(docs.columns, "_rate", "_copy")
    targets = source_targets(_sizes(docs, id_col, text_col, source_col), share, cap, weights)
    d = sized_join(docs, targets.select(F.col("source").alias(source_col), _rate().alias(rate)), source_col, row_bytes=256)
    copies = draws(seed, F.col(id_col), F.col(rate)).cast("int")
    return d.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
