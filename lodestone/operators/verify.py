"""Fidelity: no row lost, none counted twice."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pyramid import TILE


def tile_mismatches(rows: DataFrame, manifest_tiles: DataFrame) -> DataFrame:
    """Tiles whose rows differ from the manifest's count, either side missing included."""
    now = rows.groupBy(*TILE).agg(F.count(F.lit(1)).alias("found"))
    both = now.join(manifest_tiles.select(*TILE, F.col("n_rows").alias("declared")), list(TILE), "full")
    return both.where(~F.col("found").eqNullSafe(F.col("declared")))


def summary(rows: DataFrame, source_rows: int, cell_limit: int = 512 * 512) -> DataFrame:
    """One row: leaf rows against the source, and inner tiles past their limit."""
    per_tile = rows.groupBy(*TILE).agg(F.bool_or("is_leaf").alias("is_leaf"), F.count(F.lit(1)).alias("n"), F.sum("merged_count").alias("merged"))
    got = per_tile.agg(F.coalesce(F.sum(F.when(F.col("is_leaf"), F.col("merged"))), F.lit(0)).alias("leaf_rows"), F.count_if((F.col("n") > cell_limit) & ~F.col("is_leaf")).alias("overfull"), F.count(F.lit(1)).alias("tiles"))
    verdict = F.when(F.col("leaf_rows") > source_rows, "rows counted in more than one leaf").when(F.col("leaf_rows") < source_rows, "rows in no leaf at all").when(F.col("overfull") > 0, "an inner tile exceeds its limit").otherwise("ok")
    return got.withColumn("source_rows", F.lit(source_rows)).withColumn("verdict", verdict)


def group_summary(leaf_cube: DataFrame, source_rows: int) -> DataFrame:
    """Facts behind all leaf cells against the source."""
    got = leaf_cube.where("is_leaf").agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("facts"))
    return got.withColumn("source_rows", F.lit(source_rows)).withColumn("verdict", F.when(F.col("facts") > source_rows, "facts counted in more than one leaf").when(F.col("facts") < source_rows, "facts in no leaf at all").otherwise("ok"))


def column_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(column, differing): how many rows of two results differ, per column; null equals null and NaN equals NaN. Rows that
    only one side has differ in every column."""
    others = [c for c in a.columns if c not in keys]
    plain_ = lambda df, name: df.select(*keys, F.struct(*others).alias(name))
    both = plain_(a, "_a").join(plain_(b, "_b"), keys, "full")
    sums = both.agg(*[F.count_if(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]) | F.col("_a").isNull() | F.col("_b").isNull()).alias(c) for c in others])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("differing")) for c in others])).alias("r")).select("r.*")
