"""Tables in the shared folder, and the position of rows in a global order."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()

#: Bytes of an Arrow batch sent to a Python worker, where the session has Spark's default (64 MB): texts may be long, and a worker holds a batch several times.
BATCH_BYTES = 4 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, and bound their batches."""
    if spark.conf.get(_BATCH).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="glossa-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; only on one machine, where that isn't set, under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="glossa-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{qualified(spark, base).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it to be on, so that Python workers look in the same place."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of ``taken`` (ignoring case, as Spark does)."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows neither repeats its work nor loses it with an executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str = "pos", first: int = 1) -> DataFrame:
    """``df`` with the position of each row in a total order, without bringing the rows into one task.

    Range partitions are sorted and numbered, then shifted by the sizes of those before; one count a partition reaches the driver.
    """
    at, part, local, start = fresh(df.columns, "_at", "_part", "_local", "_start")
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    d = materialize(d.withColumn(part, F.shiftright(at, 33)).withColumn(local, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at), "numbered")
    starts, total = [], first
    for p, n in sorted((r[0], r[1]) for r in d.groupBy(part).agg(F.max(local) + 1).collect()):
        starts.append((p, total))
        total += n
    offsets = F.broadcast(d.sparkSession.createDataFrame(starts, f"`{part}` long, `{start}` long"))
    return d.join(offsets, part).withColumn(name, F.col(start) + F.col(local)).drop(part, start, local)


def absolute(path: str) -> str:
    """A local path made absolute; one with a scheme as it is."""
    return path if "://" in path or path.startswith("file:") else os.path.abspath(path)


def beside(path: str) -> str:
    """The folder that a path lies in."""
    return absolute(path).rstrip("/").rpartition("/")[0]


def names_in(folder: str) -> list[str]:
    """What lies in a folder, in order; nothing if there is none."""
    from pyarrow.fs import FileSelector

    fs, root = filesystem(folder)
    return sorted(f.base_name for f in fs.get_file_info(FileSelector(root, allow_not_found=True)))


def filesystem(uri: str):
    """The Arrow filesystem of a shared folder and the path in it; usable in Python workers."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)
