"""What several corpus operators share: durable intermediate tables, size-checked joins, global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import filesystem, fresh, materialize, shared_dir, ship

__all__ = ["BROADCAST_LIMIT", "WORD", "class_join", "filesystem", "fresh", "global_row_number", "materialize", "parts_for", "released", "shared_dir", "ship", "sized_join"]

#: A join side is broadcast only when its measured size is below this many bytes.
BROADCAST_LIMIT = 8 << 20
#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds more than one in HOT_KEYS of all rows, so that there are fewer than HOT_KEYS hot ones, and more than HOT_ROWS rows.
HOT_KEYS, HOT_ROWS = 1 << 14, 1 << 16


def released(run):
    """A batch function that gives memory back to the system when its task ends: Python workers outlive their tasks, and what one stage's workers
    hold on to counts against the next stage's."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return wrapped


def parts_for(df: DataFrame) -> int:
    """Partitions that suit a shuffle of what ``df`` yields: the session's setting, but no fewer than its input has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions(), 1)


def sized_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", row_bytes: int = 64, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Join ``left`` to ``right``, one row a key there.

    ``right`` is counted first: it is broadcast when ``rows * row_bytes`` is below ``limit``. Beyond that the join is a
    shuffled one in which the keys of ``left`` are salted over 32 copies of ``right``, so that a key holding a third of all
    rows is spread over many tasks. Null keys match a null key.
    """
    rows = right.count()
    names = [c for c in right.columns if c != on]
    key, salt, rsalt = fresh([*left.columns, *right.columns], "_key", "_salt", "_rsalt")
    r = right.withColumnRenamed(on, key)
    if rows * row_bytes <= limit:
        joined = left.join(F.broadcast(r), F.col(on).eqNullSafe(F.col(key)), how)
    else:
        salted = left.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(32)).cast("int"))
        r = r.withColumn(rsalt, F.explode(F.sequence(F.lit(0), F.lit(31))))
        joined = salted.join(r, F.col(on).eqNullSafe(F.col(key)) & (F.col(salt) == F.col(rsalt)), how)
    return joined.select(*left.columns, *names)


def class_join(rows: DataFrame, per: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """Inner join of ``per`` to ``rows``: it has one row a key, which says in the column ``size`` (left out of the result) how many of the ``total`` rows have it.

    Hot keys are broadcast, under HOT_KEYS rows by their definition, so that rows of a hot key stay where they are; the others are shuffled by key. Keys aren't null.
    ``rows`` is read twice if there may be a hot key and should be a table.
    """
    hot = max(HOT_ROWS, total // HOT_KEYS)
    if total <= hot:
        return rows.join(per.drop(size), on)
    big = F.broadcast(per.where(F.col(size) > hot).drop(size))
    rest = rows.join(F.broadcast(per.where(F.col(size) > hot).select(on)), on, "left_anti")
    return rows.join(big, on).unionByName(rest.join(per.where(F.col(size) <= hot).drop(size), on))


def global_row_number(df: DataFrame, keys: list, name: str = "row_no") -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys``, over all rows.

    Range partitions are sorted, numbered locally and shifted by the sizes of the partitions before them; the driver sees one
    number a partition. Rows that tie in all keys get their numbers in any order, so keys should cover what is to be
    reproducible. ``df`` is read twice (once to sample the ranges), so it should be a table, not a long computation.
    """
    spark = df.sparkSession
    tie, at, part, local, start = fresh(df.columns, "_tie", "_at", "_part", "_local", "_start")
    d = df.withColumn(tie, F.monotonically_increasing_id())
    d = d.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop(tie)
    d = d.withColumn(at, F.monotonically_increasing_id())
    d = materialize(d.withColumn(part, F.shiftright(at, 33).cast("int")).withColumn(local, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), "rows").drop(at)
    total, starts = 0, []
    for p, n in sorted((r[0], r[1]) for r in d.groupBy(part).agg(F.max(local) + 1).collect()):
        starts.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, f"`{part}` int, `{start}` long"))
    return d.join(offsets, part).withColumn(name, F.col(start) + F.col(local)).drop(part, start, local)
