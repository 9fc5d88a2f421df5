"""Cube cells as slabs: axes, cell ids, sparse rows or dense cumulative planes per tile.

A cell of a mark is one combination of the grain. Categorical axes are outer, ordered (temporal) ones inner, and the
innermost ordered axis is cumulative in dense planes, so that a range is the difference of two entries.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_day
from ..functions.measures import Partial
from .fold import Context
from .pyramid import TILE

DENSE_GATE = 0.5


@dataclass(frozen=True)
class Axis:
    channel: str
    values: tuple[str, ...]
    ordered: bool
    stride: int


def axis_values(df: DataFrame, channel: str) -> DataFrame:
    """Non-null values in the order of the raw column, as text."""
    return df.where(F.col(channel).isNotNull()).groupBy(channel).agg(F.lit(1).alias("one")).orderBy(channel).select(iso_day(F.col(channel), dict(df.dtypes)[channel]).alias("value"))


def axes(domains: dict[str, tuple[list[str], bool]]) -> list[Axis]:
    """domains: channel to (values, ordered), in grain order. Strides grow from the innermost axis outwards."""
    order = [c for c in domains if not domains[c][1]] + [c for c in domains if domains[c][1]]
    out, stride = [], 1
    for c in reversed(order):
        values, ordered = domains[c]
        out.append(Axis(c, tuple(values), ordered, stride))
        stride *= max(1, len(values))
    return out[::-1]


def n_cells(plan: list[Axis]) -> int:
    return plan[0].stride * max(1, len(plan[0].values)) if plan else 1


def code(df_kind: str, a: Axis) -> Column:
    """Position in the axis; null where unknown. Domains hold at most 4096 values, so a literal array will do."""
    return F.nullif(F.array_position(F.lit(list(a.values)).cast("array<string>"), iso_day(F.col(a.channel), df_kind)), F.lit(0)) - 1


def cell_id(df: DataFrame, plan: list[Axis]) -> Column:
    kinds = dict(df.dtypes)
    out = F.lit(0).cast("long")
    for a in plan:
        out = out + code(kinds[a.channel], a) * a.stride
    return out.cast("int")


def layouts(cells: DataFrame, plan: list[Axis], gate: float = DENSE_GATE) -> DataFrame:
    """Per tile: marks, occupied cells, occupancy and layout. cells: tile, mki and one row per occupied cell."""
    size = n_cells(plan)
    stats = cells.groupBy(*TILE, "mki").agg(F.count(F.lit(1)).alias("k")).groupBy(*TILE).agg(F.count(F.lit(1)).alias("marks"), F.sum("k").alias("nnz"))
    return stats.withColumn("occupancy", F.col("nnz") / (F.col("marks") * size)).withColumn("layout", F.when(F.col("occupancy") >= gate, "dense").otherwise("sparse"))


def leaf_occupancy(cells: DataFrame, plan: list[Axis]) -> DataFrame:
    """Occupancy of all leaf tiles together."""
    marks = cells.where("is_leaf").groupBy(*TILE, "mki").agg(F.count(F.lit(1)).alias("k"))
    return marks.agg(F.sum("k").alias("nnz"), F.count(F.lit(1)).alias("marks")).withColumn("occupancy", F.col("nnz") / (F.col("marks") * n_cells(plan)))


def sparse(cells: DataFrame, parts: list[Partial]) -> DataFrame:
    """Compressed rows per tile: offsets of marks, cell ids, one value list per partial. cells: tile, mki, cell_id.

    A tile is one block of the export and holds a bounded number of marks and cells. Marks without cells keep an empty
    range. Cells are counted per mark and summed up along the tile, so the work is linear in cells and marks.
    """
    row = F.struct("cell_id", *[p.name for p in parts])
    marks = cells.groupBy(*TILE, "mki").agg(F.sort_array(F.collect_list(row)).alias("r"))
    along = Window.partitionBy(*TILE).orderBy("mki")
    run = marks.withColumns({"end": F.sum(F.size("r")).over(along), "gap": F.col("mki") - F.coalesce(F.lag("mki").over(along), F.lit(-1))})
    packed = run.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("mki", "end", "gap", "r"))).alias("m"))
    starts = F.flatten(F.transform("m", lambda x: F.array_repeat((x["end"] - F.size(x["r"])).cast("int"), x["gap"])))
    offsets = F.concat(starts, F.array(F.element_at("m", -1)["end"].cast("int")))
    rows = packed.select(*TILE, offsets.alias("offsets"), F.flatten(F.transform("m", lambda x: x["r"])).alias("r"))
    return rows.select(*TILE, "offsets", F.transform("r", lambda x: x["cell_id"]).alias("cell_ids"), *[_plane("r", p) for p in parts])


def _plane(rows: str, p: Partial) -> Column:
    return F.transform(rows, lambda x: x[p.name]).alias(p.name)


def dense(cells: DataFrame, plan: list[Axis], parts: list[Partial]) -> DataFrame:
    """Long form of dense planes: every (mki, cell) of a tile; empty cells are 0, or NaN for extrema; additive partials
    run up along the innermost ordered axis (in f64, rounded once). cells: tile, mki, cell_id, partials."""
    every = cells.select(*TILE, "mki").distinct().withColumn("cell_id", F.explode(F.sequence(F.lit(0), F.lit(n_cells(plan) - 1))))
    full = every.join(cells.select(*TILE, "mki", "cell_id", *[p.name for p in parts]), [*TILE, "mki", "cell_id"], "left")
    bins = len(plan[-1].values) if plan and plan[-1].ordered else 1
    run = Window.partitionBy(*TILE, "mki", F.floor(F.col("cell_id") / bins)).orderBy("cell_id").rowsBetween(Window.unboundedPreceding, 0)
    nan = F.lit(float("nan")).cast("float")
    filled = {p.name: F.coalesce(F.col(p.name).cast("float"), nan) if p.kind in ("min", "max") else F.sum(F.coalesce(F.col(p.name), F.lit(0)).cast("double")).over(run).cast("int" if p.kind == "cnt" else "float") for p in parts}
    return full.select(*TILE, "mki", "cell_id", *[v.alias(k) for k, v in filled.items()])


def planes(long: DataFrame, parts: list[Partial]) -> DataFrame:
    """Dense planes as arrays per tile, cell-major: plane[cell * marks + mki]."""
    packed = long.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("cell_id", "mki", *[p.name for p in parts]))).alias("r"))
    return packed.select(*TILE, *[_plane("r", p) for p in parts])


def bins_of(a: Axis, lo: str | None, hi: str | None) -> tuple[int, int]:
    """First and last bin of an ISO range; first > last where nothing lies in it."""
    return (bisect_left(a.values, lo) if lo else 0), (bisect_right(a.values, hi) if hi else len(a.values)) - 1


def range_by_difference(long: DataFrame, plan: list[Axis], p: Partial, lo: int, hi: int) -> DataFrame:
    """Per mark and category: the partial over bins lo..hi of the innermost axis, from two entries of the running sum,
    or from a scan for extrema, which skips NaN."""
    bins = len(plan[-1].values)
    at, cat = F.col("cell_id") % bins, F.floor(F.col("cell_id") / bins).alias("category")
    if p.kind in ("min", "max"):
        v = F.when(at.between(lo, hi) & ~F.isnan(p.name), F.col(p.name))
        value = F.min(v) if p.kind == "min" else F.max(v)
    else:
        value = F.max(F.when(at == hi, F.col(p.name))) - F.coalesce(F.max(F.when(at == lo - 1, F.col(p.name))), F.lit(0))
    return long.groupBy(*TILE, "mki", cat).agg(value.alias(p.name))


def needed_cells(plan: list[Axis], ctx: Context, cumulative: bool = True) -> list[int] | None:
    """Cell ids a context reads; None where it can match nothing. Of a cumulative axis only two entries per range."""
    picks = []
    for i, a in enumerate(plan):
        at = list(range(len(a.values)))
        if a.channel in ctx.equals:
            at = [a.values.index(ctx.equals[a.channel])] if ctx.equals[a.channel] in a.values else []
        if a.channel in ctx.ranges:
            lo, hi = bins_of(a, *ctx.ranges[a.channel])
            at = [j for j in at if lo <= j <= hi]
        if cumulative and a.ordered and i == len(plan) - 1 and at:
            at = [at[0] - 1] * (at[0] > 0) + [at[-1]]
        picks.append([j * a.stride for j in at])
    if any(not p for p in picks) or not set(ctx.equals) | set(ctx.ranges) <= {a.channel for a in plan}:
        return None
    out = [0]
    for p in picks:
        out = [o + j for o in out for j in p]
    return sorted(out)


# --- folds over slabs ----------------------------------------------------------------------------------------------


def decoded(cells: DataFrame, plan: list[Axis]) -> DataFrame:
    """cells (cell_id) with the channel of every axis as text."""
    return cells.withColumns({a.channel: F.get(F.lit(list(a.values)).cast("array<string>"), (F.floor(F.col("cell_id") / a.stride) % max(1, len(a.values))).cast("int")) for a in plan})


def cell_mask(plan: list[Axis], ctx: Context) -> list[bool] | None:
    """Which cells a context keeps, by cell id; None where it keeps none."""
    kept = needed_cells(plan, ctx, cumulative=False)
    if kept is None:
        return None
    out = [False] * n_cells(plan)
    for c in kept:
        out[c] = True
    return out


def sparse_rows(slabs: DataFrame, parts: list[Partial]) -> DataFrame:
    """Cells (tile, mki, cell_id, partials) of compressed rows: the inverse of `sparse`. Marks without cells give none."""
    lists = F.arrays_zip("cell_ids", *[p.name for p in parts])
    marks = slabs.select(*TILE, "offsets", lists.alias("r")).select(*TILE, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("offsets") - 1), lambda i: F.slice("r", F.get("offsets", i - 1) + 1, F.get("offsets", i) - F.get("offsets", i - 1)))).alias("mki", "r"))
    return marks.select(*TILE, "mki", F.inline("r")).withColumnRenamed("cell_ids", "cell_id")


def dense_rows(tiles: DataFrame, plan: list[Axis], parts: list[Partial], ctx: Context) -> DataFrame:
    """Cells (tile, mki, cell_id, partials) that dense planes hold inside a context.

    planes: cell-major arrays with additive partials summed up along the innermost ordered axis, so a range is the
    difference of two entries; extrema are scanned over the range. The range of that axis is used up here: its rows carry
    the first cell of the range.
    """
    inner = plan[-1] if plan and plan[-1].ordered else None
    bins = len(inner.values) if inner else 1
    lo, hi = bins_of(inner, *ctx.ranges.get(inner.channel, (None, None))) if inner else (0, 0)
    if inner and inner.channel in ctx.equals:
        at = inner.values.index(ctx.equals[inner.channel]) if ctx.equals[inner.channel] in inner.values else bins
        lo, hi = max(lo, at), min(hi, at)
    kept = needed_cells([a for a in plan if a is not inner], Context({c: v for c, v in ctx.equals.items() if not inner or c != inner.channel}, {c: v for c, v in ctx.ranges.items() if not inner or c != inner.channel}), cumulative=False)
    known = set(ctx.equals) | set(ctx.ranges) <= {a.channel for a in plan}
    firsts = sorted({c // bins * bins for c in kept}) if kept is not None and known and lo <= hi else []
    marks = F.floor(F.size(parts[0].name) / n_cells(plan)).cast("int")
    wide = tiles.withColumn("marks", marks).withColumn("mki", F.explode(F.sequence(F.lit(0), F.col("marks") - 1))).withColumn("base", F.explode(F.lit(firsts or [0]).cast("array<int>")))
    if not firsts:
        wide = wide.where(F.lit(False))
    entry = lambda p, c: F.get(p.name, c * F.col("marks") + F.col("mki"))

    def value(p: Partial) -> Column:
        if p.kind in ("min", "max"):
            span = F.filter(F.transform(F.sequence(F.col("base") + lo, F.col("base") + hi), lambda c: entry(p, c)), lambda v: ~F.isnan(v))
            return F.array_min(span) if p.kind == "min" else F.array_max(span)
        before = entry(p, F.col("base") + lo - 1) if lo > 0 else F.lit(0)
        return (entry(p, F.col("base") + hi).cast("double") - before).cast("int" if p.kind == "cnt" else "double")

    return wide.select(*TILE, "mki", (F.col("base") + lo).cast("int").alias("cell_id"), *[value(p).alias(p.name) for p in parts])


def fold_slabs(plan: list[Axis], parts: list[Partial], measures, ctx: Context, rows: DataFrame | None = None, planes_: DataFrame | None = None) -> DataFrame:
    """z, tx, ty, mki, measures, alive: measures of marks from sparse rows, dense planes, or tiles of both kinds.

    `parts` must hold the count partial, which tells cells apart from empty entries of planes. Every mark keeps its row.
    """
    from .fold import tail

    grain, pieces, marks = [a.channel for a in plan], [], []
    inner = plan[-1].channel if plan and plan[-1].ordered else None
    if rows is not None:
        cells, mask = sparse_rows(rows, parts), cell_mask(plan, ctx)
        marks.append(rows.select(*TILE, F.explode(F.sequence(F.lit(0), F.size("offsets") - 2)).alias("mki")))
        kept = F.get(F.lit(mask).cast("array<boolean>"), F.col("cell_id")) if mask else F.lit(False)
        pieces.append(cells.where(kept))
    if planes_ is not None:
        marks.append(planes_.select(*TILE, F.explode(F.sequence(F.lit(0), F.floor(F.size(parts[0].name) / n_cells(plan)).cast("int") - 1)).alias("mki")))
        pieces.append(dense_rows(planes_, plan, parts, ctx).where("cnt > 0"))
    cells, every = pieces[0], marks[0]
    for c, m in zip(pieces[1:], marks[1:]):
        cells, every = cells.unionByName(c), every.unionByName(m)
    inside = decoded(cells, plan).select(*TILE, "mki", *[c for c in grain if c != inner], *[p.name for p in parts])
    every = every.select(*TILE, "mki", *[F.lit(None).cast(dict(inside.dtypes)[c]).alias(c) for c in inside.columns[len(TILE) + 1 :]])
    # marks without a cell inside enter as rows outside the context
    both = inside.withColumn("_in", F.lit(True)).unionByName(every.withColumn("_in", F.lit(False)))
    return tail(both, [*TILE, "mki"], measures, ctx, grain, inside=F.col("_in"))


def occupancy_distribution(layout: DataFrame, gate: float = DENSE_GATE) -> DataFrame:
    """One row over the tiles of `layouts`: how full they are, and which share of tiles and of cells lies over the gate."""
    over = F.col("occupancy") >= gate
    return layout.agg(
        F.count(F.lit(1)).alias("tiles"), F.min("occupancy").alias("least"), F.avg("occupancy").alias("mean"), F.max("occupancy").alias("most"),
        F.avg(over.cast("double")).alias("dense_tiles"), (F.sum(F.when(over, F.col("nnz")).otherwise(0)) / F.sum("nnz")).alias("dense_cells"),
    )


def witness(cells: DataFrame) -> DataFrame:
    """Facts behind each tile's cells."""
    return cells.groupBy(*TILE).agg(F.sum("cnt").cast("long").alias("facts"))
