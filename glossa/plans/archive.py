"""File archives: path -> bytes as Parquet sorted by path."""

from __future__ import annotations

import posixpath
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.trees import SCHEMA as FILES
from ..sources.trees import Inbox, from_items, read_tree
from . import metadata
from .durable import beside, filesystem, shared_dir, ship

SUFFIX = ".gfiles"


def write_files(spark: SparkSession, files: DataFrame, output: str, meta: dict | str | None = None, block_size_kb: int = 8, level: int = 5, mode: str = "overwrite") -> Archive:
    """An archive from files(dict, archive, path, content, length)."""
    merged = metadata.merge(meta, metadata.ARCHIVE)
    d = files.repartitionByRange("path").sortWithinPartitions("path")
    d.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option("parquet.page.size", str(block_size_kb << 10)).parquet(output)
    metadata.save(output, metadata.stamp(merged, spark.read.parquet(output).count(), level, None))
    return Archive(spark, output)


def _names(output: str) -> tuple[str, str]:
    return posixpath.basename(output.rstrip("/")).removesuffix(SUFFIX), posixpath.basename(beside(output))


def compile_tree(spark: SparkSession, roots: str | list[str], output: str, meta: dict | str | None = None, block_size_kb: int = 8, level: int = 5) -> Archive:
    """An archive of directory trees."""
    return write_files(spark, read_tree(spark, roots, *_names(output)), output, meta, block_size_kb, level)


def compile_items(spark: SparkSession, items: list[tuple[str, bytes]], output: str, meta: dict | str | None = None, block_size_kb: int = 8, level: int = 5) -> Archive:
    """An archive of (path, bytes) pairs."""
    return write_files(spark, from_items(spark, items, *_names(output)), output, meta, block_size_kb, level)


def compile_pushed(spark: SparkSession, inbox: Inbox, n: int, output: str, meta: dict | str | None = None, block_size_kb: int = 8, level: int = 5, size: int = 64, timeout: float = 60.0) -> Archive:
    """An archive of the next n files that a producer pushes: lots of ``size`` are written to the shared folder as they come, then sorted together."""
    folder, names = shared_dir(spark, "pushed"), _names(output)
    spark.createDataFrame([], FILES).write.parquet(folder)
    for lot in inbox.batches(n, size, timeout):
        from_items(spark, lot, *names).write.mode("append").parquet(folder)
    return write_files(spark, spark.read.schema(FILES).parquet(folder), output, meta, block_size_kb, level)


def safe_target(key: str) -> str | None:
    """Where a file is to go below a folder; None for a key that leads out of it."""
    at = posixpath.normpath(key.replace("\\", "/")) if key else "."
    return None if at == "." or at.startswith(("/", "../")) or at == ".." else at


def extract_files(files: DataFrame, folder: str) -> DataFrame:
    """path, written: every file of the table below a folder that the executors share; keys that lead out of it aren't written.

    A file is written under another name and moved into place, so a repeated task does no harm. Links in a local folder aren't followed out of it.
    """
    ship(files.sparkSession)

    def run(batches):
        from os.path import realpath

        from pyarrow.fs import LocalFileSystem

        fs, root = filesystem(folder)
        local = isinstance(fs, LocalFileSystem)
        for pdf in batches:
            done = []
            for key, data in zip(pdf["path"], pdf["content"], strict=True):
                at = safe_target(key)
                target = f"{root}/{at}"
                if at and local and not realpath(target).startswith(realpath(root) + "/"):
                    at = None
                if at:
                    fs.create_dir(posixpath.dirname(target), recursive=True)
                    part = f"{target}.{uuid.uuid4().hex[:8]}.part"
                    with fs.open_output_stream(part) as f:
                        f.write(data)
                    fs.move(part, target)
                done.append(at is not None)
            yield pd.DataFrame({"path": pdf["path"], "written": done})

    return files.select("path", "content").mapInPandas(run, "path string, written boolean")


def contains_file(files: DataFrame, path: str, name: str | None = None) -> bool:
    """Whether any archive (of a dictionary) has a file."""
    d = files if name is None else files.where(F.col("dict") == name)
    return bool(d.where(F.col("path") == path).select(F.lit(1)).head(1))


def keys(files: DataFrame) -> DataFrame:
    """path, in order."""
    return files.select("path").orderBy("path")


class Archive:
    """A compiled archive; false if there is none at the path."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None) -> None:
        self.spark, self.path, self.files = spark, path, None
        try:
            d = spark.read.parquet(path).select("dict", "archive", "path", "content", "length")
            self.files = d.withColumn("dict", F.lit(name)) if name else d
        except Exception:  # noqa: BLE001
            self.files = None

    def __bool__(self) -> bool:
        return self.files is not None

    def is_valid(self) -> bool:
        return bool(self)

    def meta(self) -> dict:
        return metadata.load(self.path)

    def header(self) -> dict:
        return {"meta": self.meta(), "schema": self.files.schema.jsonValue(), "files": self.files.count()}

    def contains(self, key: str) -> bool:
        return contains_file(self.files, key)

    def extract_all_key(self) -> list[str]:
        return [r.path for r in keys(self.files).collect()]

    def extract(self, key: str, folder: str = "data") -> bool:
        got = extract_files(self.files.where(F.col("path") == key).limit(1), folder).collect()
        return bool(got) and got[0].written

    extract_if_exists = extract

    def extract_all(self, folder: str = "data") -> bool:
        return extract_files(self.files, folder).where("NOT written").limit(1).count() == 0
