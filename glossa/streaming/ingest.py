"""Files and entries that keep arriving, appended to archives and dictionaries by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, root: str, archive: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """files that appear below a folder; a bounded number a batch is the back-pressure. Spark's streaming source passes empty and hidden files over."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    d = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", "")
    return d.select(F.lit(name).alias("dict"), F.lit(archive).alias("archive"), F.ltrim(F.substring(path, len(base) + 1, 1 << 20), F.lit("/")).alias("path"), "content", "length")


def append_to(stream: DataFrame, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start appending a stream to Parquet, exactly once; until what is there now has been read, or on and on."""
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", output)
    return (w.trigger(availableNow=True) if available_now else w).start()


def word_stream(texts: DataFrame, name: str, text: str = "text", at: str | None = None, late: str = "10 minutes") -> DataFrame:
    """dict, key of words that arrive; with an event time each word once within the watermark."""
    d = texts.withWatermark(at, late) if at else texts
    words = d.select(F.lit(name).alias("dict"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)).alias("key"), *([at] if at else []))
    return words.dropDuplicatesWithinWatermark(["dict", "key"]) if at else words
