"""Content dedup over a stream of items. An extension: the batch operators are the ones with counterparts elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_files(spark, path: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """Files that arrive below path, as a stream of items with their modification time."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select(F.xxhash64("path").alias("item_id"), "path", "content", "length", F.col("modificationTime").alias("ts"))


def new_content(stream: DataFrame, time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first item of each content within the watermark; state is one hash per content and is dropped after the delay."""
    hashed = stream.withColumn("sha256", F.sha2("content", 256))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["sha256"])


def windowed_volume(stream: DataFrame, time_col: str = "ts", window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Items and bytes per window of event time."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("window")).agg(F.count("*").alias("items"), F.sum("length").alias("bytes"))
