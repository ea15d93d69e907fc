"""Sharding: contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import checkpointed, joined_counted, running_totals, unused, written


def assign_shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16, whole_share: float = 0.05) -> DataFrame:
    """Shard of every row of `docs` (doc_id, text): doc_id, size, text_crc32, shard, slot.

    Rows are ordered by a hash of their text and then doc_id, so equal texts lie side by side; shards
    are cut from that order at equal targets of bytes (UTF-8 bytes of the text plus `overhead`). A
    row goes to the shard in which its middle byte falls, so a shard is at most one document off its
    target on each side. Rows of equal text stay in one shard, that of their common middle byte, if together they have at most
    `whole_share` of a target; larger groups are cut, as the shards would not be near equal otherwise. Slots number a shard's rows from 0 without gaps.

    Null text counts as no bytes (crc32 0), like empty text; null doc_ids sort first; repeated rows each get a slot of
    their own; an empty table gives no rows; other columns are not read.
    """
    return _placed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), [], n_shards, overhead, whole_share).select("doc_id", "size", "text_crc32", "shard", "slot")


def _placed(docs: DataFrame, keep: list[str], n_shards: int, overhead: int, whole_share: float) -> DataFrame:
    """The shards of `docs` (doc_id, text not null), with the columns `keep`; they also order equal rows."""
    text = F.col("text")
    rows = docs.select(*keep, "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_order"), F.lit(1).cast("long").alias("_one"))
    rows = checkpointed(running_totals(rows, [], ["_order", "text_crc32", "size", "doc_id", *keep], {"size": "_bytes", "_one": "_rows"}))
    # equal texts: where the group begins and how long it is
    same = ["_order", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.count("*").alias("n"), F.min("_bytes").alias("_start"), F.first("_bytes_all").alias("_total"))
    groups = groups.where((F.col("n") > 1) & (F.col("n") * F.col("size") * n_shards <= F.col("_total") * whole_share)).select(*same, "n", (F.col("_start") * 2 + F.col("n") * F.col("size")).alias("_middle"))
    rows = joined_counted(rows, groups, same, rows.count(), how="left")
    middle = F.coalesce("_middle", F.col("_bytes") * 2 + F.col("size")).cast("decimal(38,0)") * n_shards
    rows = rows.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle / (F.col("_bytes_all") * 2))).cast("int"))
    first = rows.groupBy("shard").agg(F.min("_rows").alias("_first"))  # at most n_shards rows
    return rows.join(F.broadcast(first), "shard").select(*keep, "doc_id", "size", "text_crc32", "shard", (F.col("_rows") - F.col("_first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, overhead: int = 16, whole_share: float = 0.05) -> None:
    """Writes `docs` (doc_id, text) with all their columns to folders `shard`=0.. of Parquet files, each in slot order.

    Every row is written once, also without a doc_id or with one that repeats: rows are numbered and written first. Where
    `docs` has a column shard or slot, those of the result get underscores before their names.
    """
    shard, slot = unused(docs, "shard"), unused(docs, "slot")
    numbered = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")))
    placed = _placed(numbered.select("_row", "_doc.doc_id", F.coalesce("_doc.text", F.lit("")).alias("text")), ["_row"], n_shards, overhead, whole_share).select("_row", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = numbered.join(placed, "_row").select("_doc.*", F.col("_shard").alias(shard), F.col("_slot").alias(slot))
    rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op3_query(spark, sf_dir: str) -> DataFrame:
    rows = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
