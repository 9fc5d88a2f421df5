"""A view end to end: source to facts, plan, marks, tiles, cube, manifest."""
from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import NUMERIC, View
from .functions.geometry import extent, real_zoom
from .functions.tiling import Bbox
from .operators import domains, fold, marks, pyramid, verify
from .plans import planner
from .sources import adapters, sinks


def with_real_zoom(df, root: Bbox):
    ext = extent(F.col("geometry")) if "geometry" in df.columns else F.lit(None).cast("double")
    return df.withColumn("zreal", real_zoom(ext, root))


def at_places(facts):
    """Facts with the least zreal of their place, so that folds of facts and of the cube show the same marks."""
    least = facts.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min("zreal").alias("_z"))
    same = facts["x"].eqNullSafe(least["_x"]) & facts["y"].eqNullSafe(least["_y"])
    return facts.join(least, same).withColumn("zreal", F.col("_z")).drop("_x", "_y", "_z")


def bake(spark: SparkSession, view: View, store: sinks.BakeStore, budget: int = planner.POINT_BUDGET) -> dict:
    """Write a version of the view and point to it; returns its manifest."""
    view.validate()
    version = store.new_version(view.id)
    at = lambda *p: store.path(view.id, version, *p)
    source = adapters.facts(spark, view)
    probe = planner.probe(source)
    plan = planner.plan(view, probe, budget)
    sinks.write_sorted(source, at("facts.parquet"), plan.root, view.storage)
    facts = spark.read.parquet(at("facts.parquet"))
    per_mark, per_fact, grain = [c.name for c in view.channels], [], []
    shown = view
    if view.grouped:
        per_mark, per_fact = marks.classify(facts, view)
        grain = marks.grain_of(view, per_fact)
        marks.group(with_real_zoom(facts, plan.root), view, per_mark).withColumn("id", F.concat_ws(":", "x", "y")).write.mode("overwrite").parquet(at("marks.parquet"))
        rows, shown = spark.read.parquet(at("marks.parquet")), marks.effective_view(view, per_mark)
        sinks.write_fold_facts(at_places(with_real_zoom(facts, plan.root)), at("fold.parquet"))
    else:
        rows = facts
    numbers = [c.name for c in shown.channels if c.type in NUMERIC]
    others = [c.name for c in shown.channels if c.type not in NUMERIC and c.name in rows.columns]

    def written_tiles(made):
        """The tile table is small and used again and again: written once, rows are then read once."""
        made.write.mode("overwrite").parquet(at("tile-index.parquet"))
        return spark.read.parquet(at("tile-index.parquet"))

    if plan.reduction == "aggregate":
        placed = rows if view.grouped else with_real_zoom(rows, plan.root)
        index = written_tiles(pyramid.aggregate_tiles(pyramid.indexed(placed, plan.root).select("ix", "iy", "zreal")))
        tiles = pyramid.aggregate(placed, plan.root, numbers, others, index)
    elif plan.reduction == "quadtreeLod":
        ids = [c.name for c in view.channels if c.role == "identity"]
        scalars = [c for c, t in rows.dtypes if not t.startswith("array")]
        index = written_tiles(pyramid.quadtree_tiles(pyramid.indexed(rows, plan.root).select("ix", "iy"), plan.max_zoom, plan.budget))
        tiles = pyramid.quadtree(rows, plan.root, plan.max_zoom, plan.budget, ids or scalars, index)
    else:
        nan = F.lit(float("nan")).cast("float")
        tiles = pyramid.raw(rows.withColumns({c: F.coalesce(F.col(c).cast("float"), nan) for c in numbers}), plan.root).withColumn("merged_count", F.lit(1))
    sinks.write_tiles(tiles, at("tiles.parquet"))
    written = spark.read.parquet(at("tiles.parquet"))
    pyramid.metadata(written).write.mode("overwrite").parquet(at("tile-list.parquet"))
    route = None
    if view.grouped:
        reals = spark.read.parquet(at("fold.parquet"))
        sinks.write_tiles(pyramid.numbered(pyramid.cube(reals, plan.root, grain, marks.cube_partials(view), index)), at("cube.parquet"))
        route = asdict(planner.route(spark.read.parquet(at("cube.parquet")), view))
    manifest = {"view": view.id, "version": version, "plan": {**asdict(plan)}, "rows": probe.count, "distinct": probe.distinct, "sketches": {"distinctRsd": planner.DISTINCT_RSD, "quantileRankError": 1 / domains.ACCURACY}, "perFact": per_fact, "grain": grain, "domains": domains.scan(facts, view), "route": route, "firstPaint": sinks.first_paint(view, per_fact, plan.reduction)}
    store.publish(view.id, version, manifest)
    return manifest


def check(spark: SparkSession, view: View, store: sinks.BakeStore) -> list[str]:
    """Problems of the latest version; none if every source row is in exactly one leaf."""
    found = store.latest(view.id)
    if found is None:
        return ["never baked"]
    version, manifest = found
    tiles = spark.read.parquet(store.path(view.id, version, "tiles.parquet"))
    listed = spark.read.parquet(store.path(view.id, version, "tile-list.parquet"))
    problems = [f"tile {r.z}/{r.tx}/{r.ty}: {r.found} rows, {r.declared} declared" for r in verify.tile_mismatches(tiles, listed).limit(20).collect()]
    if view.grouped:
        r = verify.group_summary(spark.read.parquet(store.path(view.id, version, "cube.parquet")), manifest["rows"]).first()
    else:
        r = verify.summary(tiles, manifest["rows"]).first()
    return problems + ([r.verdict] if r.verdict != "ok" else [])


def fold_view(spark: SparkSession, view: View, store: sinks.BakeStore, tiles: list[str], names: list[str], filters: dict[str, str], from_cube: bool = True):
    """Named measures of the latest version under filters, for 'z/x/y' tiles."""
    found = store.latest(view.id)
    if found is None or not view.grouped:
        raise LookupError(f"view '{view.id}' has nothing to fold")
    if not tiles or not names:
        raise ValueError("tiles and measures must not be empty")
    version, manifest = found
    known = {m.name: m.tree for m in view.measures}
    if bad := [n for n in names if n not in known]:
        raise ValueError(f"unknown measure '{bad[0]}'")
    wanted = [(z, x, y) for z, keys in fold.tile_keys(tiles).items() for x, y in keys]
    temporal = {c.name for c in view.channels if c.type == "date" or c.role == "temporal"}
    ctx = fold.context(fold.active(filters, {c.name for c in view.channels}), temporal)
    picked = {n: known[n] for n in names}
    if from_cube:
        return fold.fold_cube(spark.read.parquet(store.path(view.id, version, "cube.parquet")), picked, ctx, wanted, manifest["grain"])
    root = Bbox(**manifest["plan"]["root"])
    return fold.fold(spark.read.parquet(store.path(view.id, version, "fold.parquet")), root, picked, ctx, wanted, manifest["grain"])
