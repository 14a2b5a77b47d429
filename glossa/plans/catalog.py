"""A set of dictionaries under names, their archives and the prior suffixes: what searches over several dictionaries work on."""

from __future__ import annotations

import json
import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators import lookup, search
from ..sources.records import SCHEMA as ENTRIES
from ..sources.trees import SCHEMA as FILES
from . import archive as archives
from .dictionary import Dictionary
from .durable import absolute, beside, filesystem, names_in

log = logging.getLogger("glossa")
_LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "OFF")


def get_version() -> str:
    return __version__


def set_log_level(spark: SparkSession, level: int) -> None:
    """0 (everything) to 6 (nothing), for Spark and for this package."""
    spark.sparkContext.setLogLevel(_LEVELS[level])
    log.setLevel((1, 10, 20, 30, 40, 50, 100)[level])


class Library:
    """Named dictionaries searched together. Unknown names are logged and passed over."""

    def __init__(self, spark: SparkSession, catalog: str | None = None, worker_num: int = 0) -> None:
        """catalog: a JSON file {"dictionaries": {name: path}, "prior_suffix": {language: [suffix, ...]}}."""
        self.spark, self.workers = spark, worker_num
        self._dicts: dict[str, Dictionary] = {}
        self._archives: dict[str, list[archives.Archive]] = {}
        self._suffixes: dict[str, None] = {}
        self._loaded_suffixes: dict[str, list[str]] = {}
        self._valid = True
        if catalog is not None:
            self._load(catalog)

    def _load(self, path: str) -> None:
        try:
            fs, at = filesystem(path)
            with fs.open_input_file(at) as f:
                c = json.loads(f.read())
            for name, where in sorted((c.get("dictionaries") or {}).items()):
                self._valid &= self.insert(name, where)
            self._loaded_suffixes = c.get("prior_suffix") or {}
            for _, own in sorted(self._loaded_suffixes.items()):
                self.insert_prior_suffix(own)
        except (OSError, ValueError, AttributeError) as e:
            log.error("catalog %s: %s", path, e)
            self._valid = False

    def __bool__(self) -> bool:
        return self._valid

    def is_valid(self) -> bool:
        return self._valid

    def insert(self, name: str, path: str) -> bool:
        """Add a dictionary and the archives that lie beside it; False if the name is taken or the path holds none."""
        if name in self._dicts:
            log.error("dictionary %s exists", name)
            return False
        d = Dictionary(self.spark, path, name)
        if not d:
            log.error("%s is no dictionary", path)
            return False
        folder = beside(path)
        self._dicts[name] = d
        self._archives[name] = [a for f in names_in(folder) if f.endswith(archives.SUFFIX) and (a := archives.Archive(self.spark, f"{folder}/{f}", name))]
        return True

    def insert_if_not_exists(self, name: str, path: str) -> bool:
        return name in self._dicts or self.insert(name, path)

    def insert_entries(self, name: str, entries: DataFrame) -> None:
        """Add a dictionary that is a DataFrame of entries."""
        d = Dictionary.__new__(Dictionary)
        d.spark, d.path, d.entries = self.spark, "", entries.select(F.lit(name).alias("dict"), "entry_no", "key", "value")
        self._dicts[name], self._archives[name] = d, []

    def erase(self, name: str) -> None:
        self._dicts.pop(name, None)
        self._archives.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._dicts)

    def save_to_disk(self, path: str) -> None:
        """The catalog as JSON, with absolute paths; suffixes come from the file they were loaded from."""
        c: dict = {"dictionaries": {n: absolute(d.path) for n, d in sorted(self._dicts.items())}}
        if self._loaded_suffixes:
            c["prior_suffix"] = self._loaded_suffixes
        fs, at = filesystem(path)
        with fs.open_output_stream(at) as f:
            f.write(json.dumps(c, indent=2, ensure_ascii=False).encode())

    def insert_prior_suffix(self, suffixes: list[str]) -> None:
        """Append suffixes that aren't there yet; earlier ones rank first."""
        self._suffixes |= {s: None for s in suffixes if s not in self._suffixes}

    def remove_all_prior_suffix(self) -> None:
        self._suffixes.clear()

    @property
    def prior_suffixes(self) -> list[str]:
        return list(self._suffixes)

    def resize_thread_pool(self, n: int) -> None:
        """Kept for its callers: parallelism is the session's."""
        self.workers = n

    def entries(self, names: list[str] | None = None) -> DataFrame:
        """The entries of the named dictionaries in one table, each once."""
        wanted = dict.fromkeys(self.names() if names is None else names)
        for n in wanted:
            if n not in self._dicts:
                log.error("no dictionary %s", n)
        own = [self._dicts[n].entries for n in wanted if n in self._dicts]
        return reduce(DataFrame.unionByName, own) if own else self.spark.createDataFrame([], ENTRIES)

    def files(self, name: str) -> DataFrame:
        own = [a.files for a in self._archives.get(name, [])]
        return reduce(DataFrame.unionByName, own) if own else self.spark.createDataFrame([], FILES)

    # ---- searches: names=None is every dictionary

    def contains(self, word: str, names: list[str] | None = None) -> bool:
        return lookup.contains(self.entries(names), word)

    def contains_file(self, path: str, name: str) -> bool:
        return archives.contains_file(self.files(name), path)

    def extract(self, name: str, path: str, folder: str = "") -> bool:
        """Write a file of the first archive that has it; by default to ``data`` beside the dictionary."""
        if name not in self._dicts:
            log.error("no dictionary %s", name)
            return False
        folder = folder or f"{beside(self._dicts[name].path)}/data"
        return any(a.extract(path, folder) for a in self._archives[name])

    extract_if_exists = extract

    def exact_match_search(self, word: str, names: str | list[str] | None = None) -> list[str] | dict[str, list[str]]:
        """The values in one dictionary, or name -> values of those that have the word."""
        if isinstance(names, str):
            return [r.value for r in lookup.exact_match(self.entries([names]), word).collect()]
        return {r["dict"]: r["values"] for r in lookup.exact_match_lists(self.entries(names), word).collect()}

    def lookup(self, word: str, names: list[str] | None = None) -> dict[str, list[str]]:
        return lookup.lookup(self.entries(names), word)

    def common_prefix_search(self, word: str, names: list[str] | None = None) -> list[str]:
        return [r.key for r in search.common_prefix_search(self.entries(names), word).collect()]

    def longest_prefix_len(self, word: str, names: list[str] | None = None) -> int:
        return search.longest_prefix_len(self.entries(names), word)

    def edit_distance_search(self, word: str, names: list[str] | None = None, edit_distance: int = 1) -> list[str]:
        return [r.key for r in search.edit_distance_search(self.entries(names), word, edit_distance).collect()]

    def predictive_search(self, prefix: str, names: list[str] | None = None) -> list[str]:
        return [r.key for r in search.predictive_search(self.entries(names), prefix).collect()]

    def suggest(self, word: str, names: list[str] | None = None) -> list[str]:
        return [r.key for r in search.suggest(self.entries(names), word).collect()]

    def prefix_distance_search(self, word: str, names: list[str] | None = None, max_distance: int = 1) -> list[str]:
        return [r.key for r in search.prefix_distance_search(self.entries(names), word, max_distance, None, self.prior_suffixes).collect()]

    def regex_search(self, pattern: str, names: list[str] | None = None) -> tuple[list[str], str]:
        if names is not None and not any(n in self._dicts for n in names):
            return [], ""
        d, error = search.regex_search(self.entries(names), pattern)
        return ([] if error else [r.key for r in d.collect()]), error
