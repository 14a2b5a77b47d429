"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of doc_id (then size, then CRC of the text). A keyed permutation of ``0 .. n-1`` sends row ``r``
to ``p``; its shard is ``p mod shards`` and its slot ``p div shards``. Both can be computed from ``r`` alone, in either direction,
without a table, and shard sizes differ by at most one (law ``rows``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import global_row_number, materialize

ROUNDS = 6
GOLDEN = 0x9E3779B97F4A7C15


def _keys(seed: int) -> list[int]:
    """One key a round, from a splitmix step."""
    out = []
    for i in range(1, ROUNDS + 1):
        z = (seed + i * GOLDEN) & (2**64 - 1)
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        out.append((z ^ (z >> 31)) >> 2)
    return out


def _sides(n: int) -> tuple[int, int]:
    """The smallest near-square rectangle that holds n cells: at most a side too many, so that cycles are hardly ever walked."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round(x: np.ndarray, key: int, mod: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x.astype(np.uint64) + np.uint64(key)) * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z >> np.uint64(33)) % np.uint64(mod)).astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """The permutation of ``0 .. n-1`` at ``rows``."""
    a, b = _sides(n)
    keys = _keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x % a, x // a
        for i, k in enumerate(keys):
            if i % 2:
                right = (right + _round(left, k, b)) % b
            else:
                left = (left + _round(right, k, a)) % a
        return right * a + left

    x = once(np.asarray(rows, dtype=np.int64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x


def invert(places: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """The row that ``permute`` sends to each place: shard s, slot t holds row ``invert(t * shards + s)``."""
    a, b = _sides(n)
    keys = _keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x % a, x // a
        for i, k in reversed(list(enumerate(keys))):
            if i % 2:
                right = (right - _round(left, k, b)) % b
            else:
                left = (left - _round(right, k, a)) % a
        return right * a + left

    x = once(np.asarray(places, dtype=np.int64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x


def shard(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the text's UTF-8 bytes plus 1 and text_crc32 its CRC-32; a null text counts as an empty one (1 and 0). Null ids come
    first. Rows alike in id, size and CRC are interchangeable, each keeps a place of its own. Other columns of ``docs``, of
    whatever name, are not read. An empty table gives an empty result. Only the three small columns are shuffled.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    small = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("text_crc32"),
    )
    numbered = global_row_number(materialize(small, "sizes"), ["doc_id", "size", "text_crc32"])
    n = numbered.count()

    @F.pandas_udf(LongType())
    def place(r: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), n, seed))

    p = numbered.withColumn("_p", place("row_no"))
    return p.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
