"""Exact percentiles, linear between ranks, from value counts: no task holds the distinct values of a table.

Values are counted, then counted again by a monotone bucket of the value. Buckets are few (BUCKETS per factor e, so under
400,000 for all doubles), and their running sum says which of them hold the wanted ranks; only these are looked into,
value by value in order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def bucket(v: Column) -> Column:
    """A whole number that never falls as v grows."""
    size = F.floor(F.log1p(F.abs(v)) * BUCKETS)
    return F.when(v >= 0, size).otherwise(-size - 1)


def quantiles(df: DataFrame, value: Column, at: list[float]) -> DataFrame:
    """One row: n, min, max and the array `q` of percentiles; nulls and NaN are left out, n is 0 and the rest null with none."""
    counts = df.select(value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("k")).withColumn("b", bucket(F.col("v")))
    sums = counts.groupBy("b").agg(F.sum("k").alias("k"))
    order = Window.orderBy("b")  # the few buckets
    before = sums.select("b", (F.sum("k").over(order) - F.col("k")).alias("first"), F.sum("k").over(order).alias("end"), F.sum("k").over(Window.partitionBy()).alias("n"))
    rank = F.transform(F.lit(list(at)).cast("array<double>"), lambda p: p * (F.col("n") - 1))
    wanted = F.array_distinct(F.concat(F.transform(rank, lambda r: F.floor(r)), F.transform(rank, lambda r: F.ceil(r))))
    hit = before.withColumn("wanted", F.filter(wanted, lambda r: (r >= F.col("first")) & (r < F.col("end")))).where(F.size("wanted") > 0)
    inside = Window.partitionBy("b").orderBy("v")
    met = counts.join(F.broadcast(hit), "b").withColumn("upto", F.col("first") + F.sum("k").over(inside))
    got = met.select("n", "v", F.explode(F.filter("wanted", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("k")))).alias("r"))
    by_rank = got.agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m"))
    one = F.transform(rank, lambda r: F.col("m")[F.floor(r)] + (r - F.floor(r)) * (F.col("m")[F.ceil(r)] - F.col("m")[F.floor(r)]))
    ends = counts.agg(F.min("v").alias("min"), F.max("v").alias("max"))
    return ends.join(F.broadcast(by_rank.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, one).alias("q")))).select("n", "min", "max", "q")
