"""Command line: search, write and extract dictionaries and archives. Exit code 1: no match, or it failed."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from . import __version__
from .operators import lookup, search
from .plans import archive, dictionary, metadata
from .plans.catalog import Library, set_log_level

PRIOR_SUFFIXES = ["する", "う", "く", "ぐ", "す", "つ", "ぬ", "ぶ", "む", "る", "い", "하다", "다"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("glossa")
    p.add_argument("-v", "--version", action="version", version=__version__)
    p.add_argument("-l", "--log-level", type=int, default=4, choices=range(7))
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("key", nargs="?", default="")
    s.add_argument("-f", "--dictionary", action="append", required=True)
    for flag in (("-m", "--meta"), ("-c", "--contains"), ("--common-prefix",), ("--longest-prefix",), ("-p", "--predictive"), ("-r", "--regex"), ("-g", "--suggest"), ("-s", "--spellcheck"), ("-u", "--enumerate")):
        s.add_argument(*flag, action="store_true")
    s.add_argument("-P", "--prefix-distance", type=int)
    s.add_argument("-e", "--edit-distance", type=int)
    w = sub.add_parser("write")
    w.add_argument("-f", "--input", required=True, action="append")
    w.add_argument("-o", "--output", required=True)
    w.add_argument("-t", "--title", default="")
    w.add_argument("-d", "--desc", default="")
    w.add_argument("-m", "--meta")
    w.add_argument("-b", "--block-size", type=int, default=8)
    w.add_argument("-c", "--compress-level", type=int, default=5)
    w.add_argument("-s", "--sorted", action="store_true")
    w.add_argument("-z", "--zstd-dict-size", type=int, default=100, help="taken for its callers: Parquet compresses pages without a trained dictionary")
    for q in (s, w):
        q.add_argument("-w", "--worker-threads", type=int, default=0, help="taken for its callers: the session's cores do the work")
    x = sub.add_parser("extract")
    x.add_argument("input")
    x.add_argument("-k", "--key-file")
    x.add_argument("-o", "--output", default="data")
    return p


def _text(arg: str) -> str:
    """A file's text if the argument names one, else itself."""
    if arg and os.path.isfile(arg):
        with open(arg, encoding="utf-8") as f:
            return f.read()
    return arg


def run_search(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    if all(f.rstrip("/").endswith(archive.SUFFIX) for f in a.dictionary):
        own = [archive.Archive(spark, f) for f in a.dictionary]
        if a.meta:
            return [json.dumps(x.meta(), ensure_ascii=False) for x in own]
        if a.contains:
            return ["true"] if any(x.contains(a.key) for x in own) else []
        return [k for x in own for k in x.extract_all_key()]
    lib = Library(spark)
    for i, f in enumerate(a.dictionary):
        if not lib.insert(f"{i:04d}", f):
            return []
    e = lib.entries()
    if a.meta:
        return [json.dumps(metadata.load(f), ensure_ascii=False) for f in a.dictionary]
    if a.contains:
        return ["true"] if lookup.contains(e, a.key) else []
    if a.common_prefix:
        return lib.common_prefix_search(a.key)
    if a.longest_prefix:
        return [str(n)] if (n := lib.longest_prefix_len(a.key)) else []
    if a.predictive:
        return lib.predictive_search(a.key)
    if a.prefix_distance is not None:
        lib.insert_prior_suffix(PRIOR_SUFFIXES)
        return lib.prefix_distance_search(a.key, None, a.prefix_distance)
    if a.edit_distance is not None:
        return lib.edit_distance_search(a.key, None, a.edit_distance)
    if a.regex:
        words, error = lib.regex_search(a.key)
        if error:
            print(error, file=sys.stderr)
        return words
    if a.suggest or a.spellcheck:
        d = search.suggestions(e, a.key) if a.suggest else search.spellcheck(e, a.key)
        return [f"{r.score:.6f}\t{r.key}" for r in d.collect()]
    if a.enumerate:
        return [f"{r.key}\t{r.code}" for r in lookup.key_codes(e).orderBy("dict", "key").collect()]
    return [v for own in lib.exact_match_search(a.key).values() for v in own]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("glossa").getOrCreate()
    set_log_level(spark, a.log_level)
    if a.command == "search":
        found = run_search(spark, a)
        print(*found, sep="\n") if found else None
        return int(not found)
    if a.command == "write":
        meta = (json.loads(_text(a.meta)) if a.meta else {}) | {k: _text(v) for k, v in (("Title", a.title), ("Description", a.desc)) if v}
        try:
            if os.path.isdir(a.input[0]) and not a.input[0].rstrip("/").endswith(dictionary.SUFFIX):
                archive.compile_tree(spark, a.input, a.output, meta, a.block_size, a.compress_level)
            elif a.input[0].rstrip("/").endswith(dictionary.SUFFIX):
                dictionary.recompile(spark, a.input[0], a.output, meta, a.block_size, a.compress_level)
            else:
                dictionary.compile_text(spark, a.input[0], a.output, meta, a.block_size, a.compress_level, a.sorted)
        except Exception as e:  # noqa: BLE001 - an exit code is what callers see
            print(e, file=sys.stderr)
            return 1
        return 0
    if a.input.rstrip("/").endswith(archive.SUFFIX):
        own = archive.Archive(spark, a.input)
        if not own:
            return 1
        wanted = _text(a.key_file).split("\n") if a.key_file else None
        return int(not (own.extract_all(a.output) if wanted is None else all([own.extract(k, a.output) for k in wanted if k])))
    d = dictionary.Dictionary(spark, a.input)
    if not d:
        return 1
    d.extract(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
