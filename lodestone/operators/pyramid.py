"""Pyramids in closed form: a row is at zoom z iff the tile that holds it at z - 1 is no leaf.

Per-tile facts that decide leaves are aggregated bottom-up over shifted indexes, never by a loop over levels on the
driver and never with a whole tile in one task: cells are pre-aggregated, so even the one tile of zoom 0 receives at
most 512 x 512 rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import Partial
from ..functions.tiling import BITS, GRID_BITS, MAX_ZOOM, Bbox, deep_index, grid_edge, shift

TILE = ("z", "tx", "ty")


def indexed(df: DataFrame, root: Bbox) -> DataFrame:
    return df.withColumns({"ix": deep_index(root, "x"), "iy": deep_index(root, "y")})


def at_zooms(df: DataFrame, zooms: Column) -> DataFrame:
    """df once per zoom of an array column, with tx, ty."""
    return df.withColumn("z", F.explode(zooms)).withColumns({"tx": shift(F.col("ix"), F.col("z")), "ty": shift(F.col("iy"), F.col("z"))})


def raw(df: DataFrame, root: Bbox) -> DataFrame:
    """One leaf tile with every row."""
    return df.withColumns({"z": F.lit(0), "tx": F.lit(0).cast("long"), "ty": F.lit(0).cast("long"), "is_leaf": F.lit(True)})


# --- quadtree ----------------------------------------------------------------------------------------------------


def quadtree_tiles(points: DataFrame, max_zoom: int, budget: int) -> DataFrame:
    """(z, tx, ty, n, is_leaf) for all tiles down to the leaves, and none below. points: ix, iy.

    Counts of the deepest occupied cells are shifted up: one row per cell and zoom, pre-aggregated. A cell of the parent's
    grid lies in one child, so children also carry what the parent is judged by.
    """
    cells = points.groupBy(shift(F.col("ix"), max_zoom, GRID_BITS).alias("gx"), shift(F.col("iy"), max_zoom, GRID_BITS).alias("gy")).agg(F.count(F.lit(1)).alias("n"))
    up = lambda c: F.call_function("shiftright", F.col(c), (F.lit(max_zoom) - F.col("z")).cast("int"))
    each = cells.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(max_zoom)))).groupBy("z", up("gx").alias("gx"), up("gy").alias("gy")).agg(F.sum("n").alias("n"))
    wide = each.groupBy("z", F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    tile = lambda c: F.shiftright(c, GRID_BITS - 1)
    tiles = wide.groupBy("z", tile("gx").alias("tx"), tile("gy").alias("ty")).agg(F.sum("n").alias("n"), F.sum("k").alias("cells"), F.count(F.lit(1)).alias("wide"))
    leaf = lambda n, cells, z: (n <= budget) | (z >= max_zoom) | (cells == n)
    return below_leaves(
        tiles, {"n": F.col("n"), "is_leaf": leaf(F.col("n"), F.col("cells"), F.col("z"))}, [F.sum("n").alias("pn"), F.sum("wide").alias("pw")], leaf(F.col("pn"), F.col("pw"), F.col("z") - 1)
    )


def below_leaves(tiles: DataFrame, keep: dict[str, Column], totals: list[Column], parent_is_leaf: Column) -> DataFrame:
    """Tiles without those whose parent is a leaf; leaf-ness only grows downwards, so the parent decides.

    The four children of a tile are gathered once; `totals` over them say what the parent is.
    """
    child_ = F.struct("tx", "ty", *[c.alias(n) for n, c in keep.items()])
    families = tiles.groupBy("z", F.shiftright("tx", 1).alias("px"), F.shiftright("ty", 1).alias("py")).agg(F.collect_list(child_).alias("children"), *totals)
    return families.where((F.col("z") == 0) | ~parent_is_leaf).select("z", F.inline("children"))


def leaf_zooms(tiles: DataFrame, deepest: DataFrame, max_zoom: int) -> DataFrame:
    """(bx, by, leaf_z): the zoom of the leaf over each deepest tile (bx, by)."""
    up = lambda c: F.call_function("shiftright", F.col(c), (F.lit(max_zoom) - F.col("z")).cast("int"))
    over = deepest.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(max_zoom)))).withColumns({"tx": up("bx"), "ty": up("by")})
    return over.join(tiles.where("is_leaf").select(*TILE), list(TILE)).select("bx", "by", F.col("z").alias("leaf_z"))


def in_tiles(rows: DataFrame, tiles: DataFrame, max_zoom: int) -> DataFrame:
    """rows (with ix, iy) once per zoom from 0 to that of their leaf, with z, tx, ty, is_leaf.

    The leaf is found by one join on the deepest tile, before rows are copied to zooms.
    """
    keyed = rows.withColumns({"bx": shift(F.col("ix"), max_zoom), "by": shift(F.col("iy"), max_zoom)})
    leaves = leaf_zooms(tiles, keyed.select("bx", "by").distinct(), max_zoom)
    return at_zooms(keyed.join(leaves, ["bx", "by"]), F.sequence(F.lit(0), F.col("leaf_z"))).withColumn("is_leaf", F.col("z") == F.col("leaf_z")).drop("bx", "by", "leaf_z")


def quadtree(points: DataFrame, root: Bbox, max_zoom: int, budget: int, order: list[str], tiles: DataFrame | None = None) -> DataFrame:
    """All tile rows: leaves hold every row, inner tiles the first row of each grid cell with merged_count.

    order: columns that decide which row stands for a cell. tiles: quadtree_tiles, if it is written already.
    """
    points = indexed(points, root)
    rows = in_tiles(points, quadtree_tiles(points.select("ix", "iy"), max_zoom, budget) if tiles is None else tiles, max_zoom)
    names = [c for c in rows.columns if c not in (*TILE, "ix", "iy", "is_leaf")]
    cell = [shift(F.col("ix"), F.col("z"), GRID_BITS).alias("gx"), shift(F.col("iy"), F.col("z"), GRID_BITS).alias("gy")]
    inner = rows.where(~F.col("is_leaf")).groupBy(*TILE, *cell).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r"), F.count(F.lit(1)).cast("int").alias("merged_count"))
    leaves = rows.where("is_leaf").select(*TILE, *names, F.lit(1).alias("merged_count"), "is_leaf")
    return leaves.unionByName(inner.select(*TILE, "r.*", "merged_count", F.lit(False).alias("is_leaf")))


# --- aggregate pyramid --------------------------------------------------------------------------------------------


def aggregate_tiles(marks: DataFrame) -> DataFrame:
    """(z, tx, ty, is_leaf): a tile is a leaf iff no mark in it becomes real deeper. marks: ix, iy, zreal."""
    deepest = marks.groupBy(shift(F.col("ix"), MAX_ZOOM).alias("tx"), shift(F.col("iy"), MAX_ZOOM).alias("ty")).agg(F.max("zreal").alias("zreal"))
    up = lambda c: F.call_function("shiftright", F.col(c), (F.lit(MAX_ZOOM) - F.col("z")).cast("int"))
    each = deepest.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(MAX_ZOOM)))).groupBy("z", up("tx").alias("tx"), up("ty").alias("ty")).agg(F.max("zreal").alias("zreal"))
    return below_leaves(each, {"is_leaf": F.col("zreal") <= F.col("z")}, [F.max("zreal").alias("pz")], F.col("pz") <= F.col("z") - 1)


def mark_keys() -> dict[str, Column]:
    """(real, k1, k2): a real mark is its place, a merged one its grid cell. Needs z, zreal, x, y, ix, iy."""
    real = F.col("zreal") <= F.col("z")
    cell = lambda i: shift(F.col(i), F.col("z"), GRID_BITS).cast("double")
    return {"real": real, "k1": F.when(real, F.col("x").cast("double")).otherwise(cell("ix")), "k2": F.when(real, F.col("y").cast("double")).otherwise(cell("iy"))}


def placed(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """rows (with ix, iy, zreal) in every tile that shows them, with mark keys."""
    return in_tiles(rows, tiles, MAX_ZOOM).withColumns(mark_keys())


def aggregate(marks: DataFrame, root: Bbox, measures: list[str], dictionaries: list[str], tiles: DataFrame | None = None) -> DataFrame:
    """All tile rows: real marks as they are; others merged per grid cell, numbers averaged and dictionaries by their
    most frequent value (the lowest on ties). Null numbers become NaN. marks: x, y, zreal, channels[, geometry].
    tiles: aggregate_tiles, if it is written already."""
    marks = indexed(marks, root)
    rows = placed(marks, aggregate_tiles(marks.select("ix", "iy", "zreal")) if tiles is None else tiles)
    shape = [c for c in ("geometry", "part_offsets") if c in marks.columns]
    as_f32 = lambda c: F.coalesce(c.cast("float"), F.lit(float("nan")).cast("float"))
    real = rows.where("real").select(*TILE, "is_leaf", "real", "k1", "k2", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), *shape, F.lit(1).alias("merged_count"), *[as_f32(F.col(m)).alias(m) for m in measures], *dictionaries)
    cells = rows.where(~F.col("real")).groupBy(*TILE, "is_leaf", "real", "k1", "k2").agg(F.count(F.lit(1)).cast("int").alias("merged_count"), *[as_f32(F.avg(F.col(m).cast("double"))).alias(m) for m in measures], *[F.mode(d, True).alias(d) for d in dictionaries])
    lo = {a: grid_edge(root, F.col("z"), a, F.col(k)) for a, k in (("x", "k1"), ("y", "k2"))}
    hi = {a: grid_edge(root, F.col("z"), a, F.col(k) + 1) for a, k in (("x", "k1"), ("y", "k2"))}
    ring = F.array(*[c.cast("float") for c in (lo["x"], lo["y"], hi["x"], lo["y"], hi["x"], hi["y"], lo["x"], hi["y"], lo["x"], lo["y"])])
    made = {"geometry": ring, "part_offsets": F.array(F.lit(0), F.lit(5))}
    merged = cells.withColumns({"x": ((lo["x"] + hi["x"]) / 2).cast("float"), "y": ((lo["y"] + hi["y"]) / 2).cast("float"), **{c: made[c] for c in shape}})
    return real.unionByName(merged)


def cube(facts: DataFrame, root: Bbox, grain: list[str], parts: list[Partial], tiles: DataFrame | None = None) -> DataFrame:
    """Partial aggregates per tile, mark and grain cell. facts: x, y, zreal, channels.

    Facts are summed per place and grain first, so the zooms multiply places, not facts. A place is one mark: it becomes
    real at the least zreal of its facts.
    """
    if tiles is None:
        tiles = aggregate_tiles(indexed(facts.groupBy("x", "y").agg(F.min("zreal").alias("zreal")), root))
    base = facts.groupBy("x", "y", *grain).agg(F.min("zreal").alias("zreal"), *[_wide(p) for p in parts])
    base = base.withColumn("zreal", F.min("zreal").over(Window.partitionBy("x", "y")))
    return placed(indexed(base, root), tiles).groupBy(*TILE, "is_leaf", "real", "k1", "k2", *grain).agg(*[_narrow(p) for p in parts])


def _wide(p: Partial) -> Column:
    """The partial in f64, so that summing twice rounds once."""
    if p.kind == "cnt":
        return F.count(F.lit(1)).alias(p.name)
    v = F.col(p.channel).cast("double")
    v = v * F.col(p.weight).cast("double") if p.kind == "swp" else v
    return {"min": F.min, "max": F.max}.get(p.kind, lambda c: F.coalesce(F.sum(c), F.lit(0.0)))(v).alias(p.name)


def _narrow(p: Partial) -> Column:
    if p.kind == "cnt":
        return F.sum(p.name).cast("int").alias(p.name)
    return {"min": F.min, "max": F.max}.get(p.kind, F.sum)(p.name).cast("float").alias(p.name)


def numbered(rows: DataFrame) -> DataFrame:
    """mki: position of a mark in its tile by key, from 0. Tiles of a leaf pyramid hold at most 512 x 512 merged marks."""
    return rows.withColumn("mki", (F.dense_rank().over(Window.partitionBy(*TILE).orderBy("real", "k1", "k2")) - 1).cast("int"))


def metadata(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*TILE).agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or("is_leaf").alias("is_leaf"))


def signal_m4(df: DataFrame, t: str, v: str, lo: float, hi: float, buckets: int) -> DataFrame:
    """Time-series M4: first, last, least and largest value of each of `buckets` equal spans of t."""
    b = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((F.col(t).cast("double") - lo) / (hi - lo) * buckets)))
    key = F.struct(t, v)
    return df.where(F.col(v).isNotNull()).groupBy(b.cast("int").alias("bucket")).agg(F.min(key)[v].alias("first"), F.max(key)[v].alias("last"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(F.lit(1)).alias("n"))


assert BITS == MAX_ZOOM + GRID_BITS
