"""Dictionary entries from raw text, from lists and from tables.

Raw text: a line with the key, one or more lines with its value, a line ``</>``. Lines may end in CRLF; white space around the key and the
delimiter doesn't count; what follows the last delimiter is passed over. A record without a value line makes the whole file invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim_whitespace

SCHEMA = "dict string, entry_no long, key string, value string"
DELIMITER = "</>"
#: A line feed and the delimiter line after it, without the line feed that ends that.
_END = r"\n[ \t\r]*+" + DELIMITER + r"[ \t\r]*+(?=\n|\z)"


class InvalidDictionary(ValueError):
    """Text or entries that make no dictionary."""


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, "\r$", ""))


def _entries(r: DataFrame) -> DataFrame:
    """entries from dict, entry_no and ``_rec``, the lines of a record."""
    bad = F.raise_error(F.concat(F.lit("no key and value lines in record "), F.col("entry_no").cast("string"), F.lit(" of "), F.col("dict")))
    value = F.when(F.size("_rec") > 1, F.array_join(F.slice("_rec", 2, F.greatest(F.size("_rec") - 1, F.lit(0))), "\n")).otherwise(bad.cast("string"))
    return r.select("dict", F.col("entry_no").cast("long").alias("entry_no"), trim_whitespace(F.get("_rec", F.lit(0))).alias("key"), value.alias("value"))


def parse_text(texts: DataFrame, name: Column | str = "dict", text: str = "value") -> DataFrame:
    """entries from rows of whole texts. A record without key and value lines fails the query; it isn't silently dropped.

    A text is cut at its delimiter lines once, in time linear in its length; each piece keeps the line feed before its first line, so an empty one has no line at all.
    """
    name = F.lit(name) if isinstance(name, str) and name not in texts.columns else F.col(name) if isinstance(name, str) else name
    d = texts.select(name.alias("dict"), F.split(F.concat(F.lit("\n"), F.col(text)), _END).alias("_pieces"))
    d = d.select("dict", F.posexplode(F.slice("_pieces", F.lit(1), F.size("_pieces") - 1)).alias("entry_no", "_piece"))  # what follows the last delimiter isn't a record
    lines = F.when(F.col("_piece") == "", F.array().cast("array<string>")).otherwise(_lines(F.expr("substring(_piece, 2)")))
    return _entries(d.select("dict", "entry_no", lines.alias("_rec")))


def read_text(spark: SparkSession, path: str, name: str) -> DataFrame:
    """entries of one raw text file, of any size; a file without a delimiter is invalid.

    The file is read in splits. Delimiters are numbered in each and shifted by how many lie in those before, one number a split; the lines of a record then meet.
    """
    d = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("_block"))
    d = d.select(F.regexp_replace("value", "\r$", "").alias("_line"), "_block", F.monotonically_increasing_id().alias("_at"))
    d = d.withColumn("_end", (trim_whitespace(F.col("_line")) == DELIMITER).cast("long"))
    starts, total = [], 0
    for block, n in sorted((r[0], r[1]) for r in d.groupBy("_block").agg(F.sum("_end")).collect()):
        starts.append((block, total))
        total += n
    if not total:
        raise InvalidDictionary(f"{path}: no delimiter")
    w = Window.partitionBy("_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_seen", F.sum("_end").over(w)).where("_end = 0")
    d = d.join(F.broadcast(spark.createDataFrame(starts, "_block long, _before long")), "_block").withColumn("entry_no", F.col("_before") + F.col("_seen"))
    lines = F.array_sort(F.collect_list(F.struct("_block", "_at", "_line")))
    found = d.where(F.col("entry_no") < total).groupBy("entry_no").agg(F.transform(lines, lambda x: x["_line"]).alias("_rec"))
    every = spark.range(total).withColumnRenamed("id", "entry_no")  # two delimiters in a row are a record too, a bad one
    return _entries(every.join(found, "entry_no", "left").select(F.lit(name).alias("dict"), "entry_no", F.coalesce("_rec", F.array().cast("array<string>")).alias("_rec")))


def from_lists(spark: SparkSession, keys: list[str], values: list[str], name: str) -> DataFrame:
    """entries from parallel lists."""
    if len(keys) != len(values):
        raise InvalidDictionary("as many keys as values are needed")
    return spark.createDataFrame([(name, i, k, v) for i, (k, v) in enumerate(zip(keys, values, strict=True))], SCHEMA)


def from_table(df: DataFrame, name: Column, key: Column, value: Column, order: Column | None = None) -> DataFrame:
    """entries from any table; entry_no is ``order``, or a number that rises through its partitions."""
    number = F.monotonically_increasing_id() if order is None else order
    return df.select(name.alias("dict"), number.cast("long").alias("entry_no"), key.alias("key"), value.alias("value"))
