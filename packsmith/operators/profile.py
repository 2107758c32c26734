"""Profiles of items: size, fingerprint, byte entropy and verdict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsmith.functions.arrow import in_batches, items_of
from packsmith.functions.scalars import verdict

#: What the reference's analysis looks at; as sample, for comparison with it.
SAMPLE_BYTES = 1 << 20
#: Bytes counted at once.
PIECE_BYTES = 1 << 20


def byte_entropy(data: bytes) -> float:
    """Bits per byte, 0 for empty data."""
    whole, counts = np.frombuffer(data, np.uint8), np.zeros(256, np.int64)
    for start in range(0, len(whole), PIECE_BYTES):
        counts += np.bincount(whole[start : start + PIECE_BYTES], minlength=256)
    share = counts[counts > 0] / max(1, len(data))
    return float(-(share * np.log2(share)).sum()) + 0.0


def with_entropy(items: DataFrame, sample: int | None = None, column: str = "h") -> DataFrame:
    """items with the entropy of the whole content, or of the first sample bytes; only these and one number cross to Python."""

    @F.pandas_udf("double")
    def entropy(data):
        return data.map(lambda d: byte_entropy(d or b""))

    return items.withColumn(column, entropy(F.col("content") if sample is None else F.substring("content", 1, sample)))


def profile(items: DataFrame, sample: int | None = None, keep: list[str] = ()) -> DataFrame:
    """item_id, size, sha256, entropy (3 places) and verdict (on the unrounded entropy); with sample=SAMPLE_BYTES of a prefix, as the reference."""
    out = with_entropy(items, sample)
    return out.select("item_id", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.round("h", 3).alias("entropy"), verdict(F.col("h")).alias("verdict"), *keep)


def byte_histogram(items: DataFrame) -> DataFrame:
    """(item_id, byte, n) for every byte value that occurs."""

    schema = pa.schema([("item_id", pa.int64()), ("byte", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for item, data in items_of(batches, ["item_id", "content"]):
            counts = np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)
            for byte in np.flatnonzero(counts).tolist():
                yield item, byte, int(counts[byte])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(counted(batches), schema)

    return items.select("item_id", "content").mapInArrow(rows, "item_id bigint, byte int, n bigint")
