"""Compiled dictionaries: Parquet sorted by key, so that row-group statistics serve exact and prefix searches, with metadata beside it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup, search
from ..sources.records import InvalidDictionary, from_lists, read_text
from . import metadata
from .durable import filesystem

SUFFIX = ".gdict"


def check_entries(entries: DataFrame, already_sorted: bool = False) -> None:
    """InvalidDictionary for an empty key, or for keys out of order where they are said to be sorted."""
    if entries.where("key IS NULL OR key = ''").head(1):
        raise InvalidDictionary("empty key")
    if already_sorted:
        # neighbours by number: each entry meets the next one in a join, whatever the number of rows
        nxt = entries.select("dict", (F.col("entry_no") - 1).alias("entry_no"), F.col("key").alias("_next"))
        if entries.join(nxt, ["dict", "entry_no"]).where("_next < key").head(1):
            raise InvalidDictionary("unsorted key")


def write_entries(entries: DataFrame, output: str, level: int = 5, block_size_kb: int = 8, already_sorted: bool = False, mode: str = "errorifexists") -> None:
    """Range-partitioned and sorted by (key, entry_no); zstd pages of the block size. Keys are checked on the way: entries are computed twice, for the range sample and the sort."""
    if already_sorted:
        check_entries(entries, True)
    bad = F.raise_error(F.lit("empty key")).cast("string")
    entries = entries.withColumn("key", F.when(F.col("key") != "", F.col("key")).otherwise(bad))
    d = entries.repartitionByRange("dict", "key", "entry_no").sortWithinPartitions("dict", "key", "entry_no")
    w = d.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option("parquet.page.size", str(block_size_kb << 10))
    try:
        w.option("parquet.bloom.filter.enabled#key", "true").parquet(output)
    except Exception as e:
        if "empty key" in str(e):
            raise InvalidDictionary("empty key") from None
        raise


def _finish(spark: SparkSession, entries: DataFrame, output: str, meta: dict | str | None, block_size_kb: int, level: int, already_sorted: bool, mode: str) -> Dictionary:
    merged = metadata.merge(meta, metadata.DICTIONARY)
    write_entries(entries, output, level, block_size_kb, already_sorted, mode)
    records = spark.read.parquet(output).count()
    metadata.save(output, metadata.stamp(merged, records, level, True))
    return Dictionary(spark, output)


def compile_text(spark: SparkSession, source: str, output: str, meta: dict | str | None = None, block_size_kb: int = 8, level: int = 5, already_sorted: bool = False, mode: str = "overwrite") -> Dictionary:
    """A dictionary from a raw text file."""
    return _finish(spark, read_text(spark, source, Path(output).name.removesuffix(SUFFIX)), output, meta, block_size_kb, level, already_sorted, mode)


def compile_lists(spark: SparkSession, output: str, keys: list[str], values: list[str], meta: dict | str | None = None, block_size_kb: int = 8, level: int = 5, already_sorted: bool = False, mode: str = "overwrite") -> Dictionary:
    """A dictionary from parallel lists."""
    return _finish(spark, from_lists(spark, keys, values, Path(output).name.removesuffix(SUFFIX)), output, meta, block_size_kb, level, already_sorted, mode)


def recompile(spark: SparkSession, source: str, output: str, meta: dict | str | None = None, block_size_kb: int = 8, level: int = 5) -> Dictionary:
    """The same entries with new metadata over the old and other storage options."""
    old = Dictionary(spark, source)
    if not old:
        raise InvalidDictionary(f"{source}: not a dictionary")
    given = metadata.merge(meta, metadata.DICTIONARY) if not isinstance(meta, dict) else meta
    both = metadata.merge({**old.meta(), **(given if isinstance(meta, dict) else ({k: v for k, v in given.items() if v != metadata.DICTIONARY[k]} if meta else {}))}, metadata.DICTIONARY)
    return _finish(spark, old.entries, output, both, block_size_kb, level, False, "overwrite")


class Dictionary:
    """A compiled dictionary; false if there is none at the path."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None) -> None:
        self.spark, self.path, self.entries = spark, path, None
        try:
            d = spark.read.parquet(path).select("dict", "entry_no", "key", "value")
            self.entries = d.withColumn("dict", F.lit(name)) if name else d
        except Exception:  # noqa: BLE001 - no such path, other files, other columns: all the same to the caller
            self.entries = None

    def __bool__(self) -> bool:
        return self.entries is not None

    def is_valid(self) -> bool:
        return bool(self)

    def meta(self) -> dict:
        return metadata.load(self.path)

    def header(self) -> dict:
        """Metadata and what the files hold."""
        return {"meta": self.meta(), "schema": self.entries.schema.jsonValue(), "entries": self.key_size(), "keys": self.distinct_key_size()}

    def key_size(self) -> int:
        return self.entries.count()

    def distinct_key_size(self) -> int:
        return self.entries.select("key").distinct().count()

    def enumerate_keys(self) -> DataFrame:
        """key, first_index, dup_count, code in the order of keys."""
        return lookup.key_codes(self.entries).drop("dict").orderBy("key")

    def keys(self) -> DataFrame:
        """A key an entry."""
        return self.entries.orderBy("key", "entry_no").select("key")

    def values(self) -> DataFrame:
        """The values in the order of the keys."""
        return self.entries.orderBy("key", "entry_no").select("value")

    def contains(self, word: str) -> bool:
        return lookup.contains(self.entries, word)

    def exact_match_search(self, word: str) -> list[str]:
        return [r.value for r in lookup.exact_match(self.entries, word).collect()]

    def common_prefix_search(self, word: str) -> list[str]:
        return [r.key for r in search.common_prefix_search(self.entries, word).collect()]

    def longest_prefix_len(self, word: str) -> int:
        return search.longest_prefix_len(self.entries, word)

    def predictive_search(self, prefix: str) -> list[str]:
        return [r.key for r in search.predictive_search(self.entries, prefix).collect()]

    def edit_distance_search(self, word: str, distance: int = 1) -> list[str]:
        return [r.key for r in search.edit_distance_search(self.entries, word, distance).collect()]

    def prefix_distance_search(self, word: str, distance: int = 1, suffixes: list[str] | None = None) -> list[list[str]]:
        """A list of keys for each distance from 0."""
        out: list[list[str]] = [[] for _ in range(distance + 1)]
        for r in search.prefix_distance_search(self.entries, word, distance, None, suffixes).collect():
            out[r.distance].append(r.key)
        return out

    def suggest(self, word: str) -> list[tuple[float, str]]:
        return [(r.score, r.key) for r in search.suggestions(self.entries, word).collect()]

    def spellcheck_word(self, word: str, limit: int = 10) -> list[str]:
        return [r.key for r in search.spellcheck(self.entries, word, limit).collect()]

    def regex_search(self, pattern: str, threads: int = 1) -> tuple[list[str], str]:
        """Keys and an error text; how many tasks work on it is Spark's affair."""
        d, error = search.regex_search(self.entries, pattern)
        return ([] if error else [r.key for r in d.collect()]), error

    def extract(self, output: str, crlf: bool = False) -> None:
        """The dictionary as raw text in one file, written by one task in the order of keys; entries() is the way for large ones."""
        end = "\r\n" if crlf else "\n"
        fs, at = filesystem(output)
        with fs.open_output_stream(at) as f:
            for r in self.entries.orderBy("key", "entry_no").select("key", "value").toLocalIterator():
                f.write(f"{r.key}\n{r.value}\n</>\n".replace("\n", end).encode())

    def write_text(self, folder: str) -> None:
        """The dictionary as raw text files, one a task, in the order of keys."""
        self.entries.orderBy("key", "entry_no").select(F.concat_ws("\n", "key", "value", F.lit("</>")).alias("value")).write.text(folder)
