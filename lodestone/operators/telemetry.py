"""Statistics over event rows: stages of an interaction, network totals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(sorted_values: Column, p: float) -> Column:
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(n - 1, F.floor(F.lit(p / 100) * n).cast("int")))


def stage_stats(events: DataFrame, stage: str, ms: str, order: str) -> DataFrame:
    """n, last, p50, p95, max and total per stage. Percentiles are nearest-rank, from value counts rather than rows."""
    counts = events.where(F.col(ms).isNotNull()).groupBy(stage, ms).agg(F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window

    w = Window.partitionBy(stage).orderBy(ms)
    run = counts.select(stage, F.col(ms).alias("v"), F.sum("k").over(w).alias("upto"), F.sum("k").over(Window.partitionBy(stage)).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(p / 100) * F.col("n"))), F.col("v")))
    ranks = run.groupBy(stage).agg(at(50).alias("p50"), at(95).alias("p95"))
    sums = events.groupBy(stage).agg(F.count(ms).alias("n"), F.max_by(ms, F.struct(order, ms)).alias("last"), F.max(ms).alias("max"), F.sum(ms).alias("total"))
    return sums.join(ranks, stage)


def network_totals(events: DataFrame, nbytes: str, ms: str, cached: Column) -> DataFrame:
    """Cold and warm requests, bytes, and goodput of cold ones in bytes per second."""
    cold = ~cached
    g = events.agg(F.count_if(cold).alias("cold"), F.count_if(cached).alias("warm"), F.sum(F.when(cold, F.col(nbytes))).alias("cold_bytes"), F.sum(F.when(cold, F.col(ms))).alias("cold_ms"))
    return g.withColumn("goodput", 1000 * F.col("cold_bytes") / F.nullif(F.col("cold_ms"), F.lit(0)))


def frame_totals(frames: DataFrame, ms: str, long_ms: float = 50.0) -> DataFrame:
    return frames.agg(F.count_if(F.col(ms) >= long_ms).alias("long_frames"), (1000 / F.nullif(F.avg(ms), F.lit(0.0))).alias("fps"))


def stage_traffic(events: DataFrame, stage: str, nbytes: str, wire: str, cached: Column) -> DataFrame:
    """Bytes, bytes on the wire, and cold and warm requests per stage."""
    return events.groupBy(stage).agg(F.sum(nbytes).alias("bytes"), F.sum(wire).alias("wire"), F.count_if(~cached).alias("cold"), F.count_if(cached).alias("warm"))
