"""Rows told apart by their texts, for decisions that depend on the text alone.

The key of a text is its SHA-256, so equal keys are equal texts; a null text has a null key and equals no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys up to this number are broadcast: 32 bytes each.
BROADCAST_TEXTS = 1_000_000


def text_key(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text_col), 256))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """One key for the id and the text of a row, never null: 16 bytes of the text's SHA-256 (none for a null text), then the id."""
    text = F.coalesce(F.substring(text_key(text_col), 1, 16), F.lit(b""))
    number = F.coalesce(F.concat(F.lit(":"), F.col(id_col).cast("bigint").cast("string")), F.lit("")).cast("binary")
    return F.concat(text, number)


def unused(df: DataFrame, stem: str) -> str:
    """A column name like stem that df doesn't have, whatever the case."""
    known = {c.lower() for c in df.columns}
    while stem.lower() in known:
        stem += "_"
    return stem


def without_texts(docs: DataFrame, gone: DataFrame, text_col: str = "text", most: int = BROADCAST_TEXTS) -> DataFrame:
    """The rows of docs whose text has none of the keys of gone (distinct rows, one column); rows with a null text stay.

    The keys are broadcast only while they are counted to be at most `most`; otherwise the join is Spark's to plan.
    """
    key, own = unused(docs, "__key"), unused(docs, "__gone")
    gone = gone.toDF(own)
    side = F.broadcast(gone) if gone.limit(most + 1).count() <= most else gone
    return docs.withColumn(key, text_key(text_col)).join(side, F.col(key) == F.col(own), "left_anti").drop(key)
