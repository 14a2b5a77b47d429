"""Files of directory trees, and of a producer that pushes them."""

from __future__ import annotations

from collections.abc import Iterator
from queue import Empty, Queue

import pandas as pd
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import filesystem, ship

SCHEMA = "dict string, archive string, path string, content binary, length long"


def _listed(root: str) -> list[tuple[str, str, int]]:
    """(path below the root, full path, size) of every regular file."""
    fs, base = filesystem(root)
    found = fs.get_file_info(FileSelector(base, recursive=True))
    head = root[: len(root) - len(base)] if root.endswith(base) else ""
    base = base.rstrip("/")
    return [(f.path[len(base) + 1 :], head + f.path, f.size) for f in found if f.type == FileType.File]


def read_tree(spark: SparkSession, roots: str | list[str], archive: str, name: str) -> DataFrame:
    """files of one or more roots, found recursively; the key is the path below its root with forward slashes.

    Spark's own binary source leaves out empty and hidden files, so paths are listed here and tasks of about 64 MB read the contents.
    """
    ship(spark)
    every = [x for root in ([roots] if isinstance(roots, str) else roots) for x in _listed(root)]
    if not every:
        return spark.createDataFrame([], SCHEMA)
    rows, task, held = [], 0, 0
    for key, full, size in every:
        if held and held + size > 64 << 20:
            task, held = task + 1, 0
        held += size + 1024
        rows.append((task, key, full))

    def read(batches):
        for pdf in batches:
            for key, full in zip(pdf["path"], pdf["full"], strict=True):
                fs, at = filesystem(full)
                with fs.open_input_stream(at) as f:
                    content = f.read()
                yield pd.DataFrame({"dict": [name], "archive": [archive], "path": [key], "content": [content], "length": [len(content)]})

    listed = spark.createDataFrame(rows, "task int, path string, full string").repartitionById(task + 1, F.col("task"))
    return listed.mapInPandas(read, SCHEMA)


def from_items(spark: SparkSession, items: list[tuple[str, bytes]], archive: str, name: str) -> DataFrame:
    """files from (path, bytes) pairs."""
    return spark.createDataFrame([(name, archive, p, bytearray(b), len(b)) for p, b in items], SCHEMA)


#: Files that an inbox holds before its producer has to wait.
WAITING = 8


class Inbox:
    """Pushed files on their way to an archive. A producer in another thread waits while WAITING of them lie here."""

    def __init__(self, waiting: int = WAITING) -> None:
        self._queue: Queue[tuple[str, bytes]] = Queue(waiting)
        self._kept: list[tuple[str, bytes]] = []

    def push(self, path: str, data: bytes, timeout: float | None = None) -> None:
        """queue.Full if there is no room for so many seconds; without a timeout the wait has no end."""
        self._queue.put((path, data), timeout=timeout)

    def take(self, n: int, timeout: float = 60.0) -> list[tuple[str, bytes]]:
        """The next n files; ValueError if one doesn't come for so many seconds, and what has come stays for the next call."""
        try:
            while len(self._kept) < n:
                self._kept.append(self._queue.get(timeout=timeout))
        except Empty:
            raise ValueError(f"{len(self._kept)} files were pushed, {n} are wanted") from None
        out, self._kept = self._kept[:n], self._kept[n:]
        return out

    def batches(self, n: int, size: int = WAITING, timeout: float = 60.0) -> Iterator[list[tuple[str, bytes]]]:
        """n files in lots of at most ``size``, so that no more of them than that are in memory at once."""
        while n > 0:
            yield self.take(min(n, size), timeout)
            n -= size
