"""Contiguous shards of near equal bytes from global prefix sums, in DataFrame functions only.

Rows get a global order (hash of the text, id) by range partitioning, so equal texts are neighbours and even a huge
group of them spreads over partitions. Within partitions running sums give local offsets; the totals of partitions,
one row each, are summed up and added. Cuts lie at equal byte targets; a cut that falls inside a small group of equal
texts (up to `snap` of a shard) moves to the nearer end of the group, so such groups stay whole.

Cases: null text has size 1 (the separator) and the checksum of no bytes; ties are rows alike in every column used,
so their order does not matter; fewer rows than shards leave shards empty; empty tables give empty results.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS, SNAP = 16, 0.02


def prefixes(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, h, with the bytes and rows before each in the global order."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, "h", "doc_id", "text_crc32").withColumn("pid", F.spark_partition_id()))
    totals = placed.groupBy("pid").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = totals.select("pid", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("pid").orderBy("h", "doc_id", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("b"), F.count(F.lit(1)).over(inside).alias("n"))
    return local.join(starts, "pid").select("doc_id", "size", "text_crc32", "h", (F.col("b0") + F.col("b")).alias("bytes_before"), (F.col("n0") + F.col("n")).alias("rows_before"))


def cuts(rows: DataFrame, shards: int, snap: float) -> list[int]:
    """shards - 1 byte positions; at most that many groups are looked up."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * k // shards for k in range(1, shards)]
    inside = F.filter(F.lit(targets).cast("array<long>"), lambda t: (t > F.col("bytes_before")) & (t < F.col("bytes_before") + F.col("size")) | (t == F.col("bytes_before")))
    crossed = rows.withColumn("targets", inside).where(F.size("targets") > 0).select("h").distinct()
    ends = rows.join(F.broadcast(crossed), "h").groupBy("h").agg(F.min("bytes_before").alias("lo"), F.max(F.col("bytes_before") + F.col("size")).alias("hi")).collect()
    out = []
    for t in targets:
        near = next((g for g in ends if g.lo <= t < g.hi), None)
        small = near is not None and near.hi - near.lo <= snap * total / shards
        out.append(t if not small else near.lo if t - near.lo <= near.hi - t else near.hi)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, snap: float = SNAP) -> DataFrame:
    """doc_id, size, text_crc32, shard and the gapless slot in it."""
    rows = cut(prefixes(docs))
    at = cuts(rows, shards, snap)
    # a row belongs to the shard that holds its middle byte, so a cut inside a row moves at most half of it
    middle = F.col("bytes_before") + F.col("size") / 2
    number = F.size(F.filter(F.lit(at).cast("array<long>"), lambda c: c <= middle)) if at else F.lit(0)
    numbered = rows.withColumn("shard", number.cast("int"))
    first = numbered.groupBy("shard").agg(F.min("rows_before").alias("first"))
    return numbered.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") - F.col("first")).alias("slot"))


def report(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
