"""Items: one row per file or text, as (item_id, path, content, length).

Files come through Spark's binaryFile source, whose filters on path, length and modificationTime are pushed to the listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsmith.functions.scalars import joined_bytes

ITEM_COLUMNS = ["item_id", "path", "content", "length"]


def text_items(df: DataFrame, id_col: str, text_col: str, suffix: str = "", keep: list[str] = ()) -> DataFrame:
    """A text table as items; null text is an empty item. keep: further columns to carry."""
    content = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    path = F.concat(F.col(id_col).cast("string"), F.lit(suffix))
    return df.select(F.col(id_col).cast("bigint").alias("item_id"), path.alias("path"), content.alias("content"), F.octet_length(content).cast("bigint").alias("length"), *keep)


def file_items(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, largest: int | None = None) -> DataFrame:
    """Files below path as items; the id is a hash of the path. Files larger than largest are left out by the listing.

    Spark's file sources skip files of no bytes, so these give no row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    if largest is not None:
        files = files.where(F.col("length") <= largest)
    return files.select(F.xxhash64("path").alias("item_id"), "path", "content", "length")


def grouped_items(items: DataFrame, by: str) -> DataFrame:
    """Items of one group joined in the order of their ids; for groups of bounded size, as each becomes one value."""
    parts = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("item_id", "content"))).alias("parts"))
    content = joined_bytes(F.transform("parts", lambda part: part["content"]))
    return parts.select(F.xxhash64(by).alias("item_id"), F.col(by).alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))


def admitted(items: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Items within a size cap, and the rejected rest with an error_class."""
    return items.where(F.col("length") <= cap), items.where(F.col("length") > cap).select("item_id", "path", "length", F.lit("OutputLimitError").alias("error_class"))
