"""Deltas between versions: what is new by hash, in first-seen order, and putting the new version together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsmith.operators.dedup import first_pieces, restore


def new_pieces(base: DataFrame, new: DataFrame) -> DataFrame:
    """The first piece of each hash that the base does not have. What the base has goes first, by its distinct hashes; the rest is
    already dealt by hash when its first pieces are taken."""
    return first_pieces(new.join(base.select("sha").distinct(), "sha", "left_anti"))


def delta_stats(base: DataFrame, new: DataFrame) -> DataFrame:
    """new_chunks, total_chunks, reused_from_base (chunks that the base has) and reused_chunks (total less distinct new ones
    that occur again; a repeat of a new chunk counts as reused)."""
    known = base.select("sha").distinct().withColumn("known", F.lit(True))
    per_hash = new.groupBy("sha").agg(F.count("*").alias("n")).join(known, "sha", "left")
    fresh = F.col("known").isNull()
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    n_new = F.count(F.when(fresh, 1))
    return per_hash.agg(n_new.alias("new_chunks"), total.alias("total_chunks"), F.coalesce(F.sum(F.when(~fresh, F.col("n"))), F.lit(0)).cast("bigint").alias("reused_from_base"), (total - n_new).alias("reused_chunks"))


def create_delta(base: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, blobs): the whole order of the new version, and the bytes of the hashes that are not in the base."""
    return new.select("item_id", "seq", "sha", "len"), new_pieces(base, new).select("sha", "data")


def apply_delta(base: DataFrame, order: DataFrame, blobs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Restore the new version: a blob of the delta wins over the base; a hash in neither gives an error_class."""
    own = blobs.select("sha", F.col("data").alias("own"))
    old = first_pieces(base.join(order.select("sha").distinct(), "sha", "left_semi")).select("sha", F.col("data").alias("old"))
    both = own.join(old, "sha", "full_outer").select("sha", F.coalesce("own", "old").alias("data"))
    return restore(order, both, ids)


def base_digest(items: DataFrame) -> str:
    """One hash over a whole version: of its item ids and content hashes in order, by a sum that needs no order of rows."""
    row = items.agg(F.count("*").alias("n"), F.sum(F.xxhash64("item_id", F.sha2("content", 256)).cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}:{row.s}"
