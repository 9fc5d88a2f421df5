"""The fold: measures of marks re-aggregated under a filter context, from a cube or straight from facts."""
from __future__ import annotations

from collections import OrderedDict, defaultdict
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_day, parse_range
from ..functions.measures import UNKNOWN_CODE, ArgExtreme, Expr, Partial, extreme, flat, over_partials, partials
from ..functions.tiling import Bbox
from .pyramid import TILE, at_zooms, indexed, mark_keys

MARK = (*TILE, "real", "k1", "k2")


@dataclass(frozen=True)
class Context:
    """Equality on dictionary channels, inclusive ISO day ranges (open where None) on temporal ones."""

    equals: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)


def active(filters: dict[str, str], known) -> dict[str, str]:
    """Filters that say something about a known channel."""
    return {k: v for k, v in filters.items() if k in known and v not in (None, "", "(all)")}


def split(filters: dict[str, str], per_fact) -> tuple[dict[str, str], dict[str, str]]:
    """(per-mark predicates, fold context)."""
    return {k: v for k, v in filters.items() if k not in per_fact}, {k: v for k, v in filters.items() if k in per_fact}


def context(filters: dict[str, str], temporal) -> Context:
    return Context({k: v for k, v in filters.items() if k not in temporal}, {k: parse_range(v) for k, v in filters.items() if k in temporal and parse_range(v)})


def predicate(ctx: Context, grain, kinds: dict[str, str]) -> Column:
    """True for cells inside the context; a channel outside the grain makes everything false."""
    tests = []
    for c, v in ctx.equals.items():
        tests.append(F.col(c) == v if c in grain else F.lit(False))
    for c, (lo, hi) in ctx.ranges.items():
        if c not in grain:
            tests.append(F.lit(False))
            continue
        day = F.col(c).cast("date") if kinds.get(c) in ("date", "timestamp", "timestamp_ntz") else F.to_date(iso_day(F.col(c), kinds.get(c, "string")))
        tests += [day >= F.lit(lo).cast("date")] * bool(lo) + [day <= F.lit(hi).cast("date")] * bool(hi)
    return reduce(and_, tests) if tests else F.lit(True)


def mark_filters(df: DataFrame, filters: dict[str, str], temporal) -> DataFrame:
    """Predicates on per-mark channels: equality, or a day range that rows without a day pass only if its end is open."""
    kinds = dict(df.dtypes)
    for c, v in filters.items():
        if c in temporal:
            lo, hi = parse_range(v) or (None, None)
            day = F.to_date(iso_day(F.col(c), kinds[c]))
            if lo:
                df = df.where(day.isNull() | (day >= F.lit(lo).cast("date")))
            if hi:
                df = df.where(day <= F.lit(hi).cast("date"))
        else:
            df = df.where(F.col(c) == v)
    return df


def tail(cells: DataFrame, keys, measures: dict[str, Expr], ctx: Context, grain, inside: Column | None = None) -> DataFrame:
    """Every mark with its measures, null where nothing of it survives. cells: keys, grain, partials.

    One grouping computes all flat measures: cells outside the context only keep their mark. Arg measures return the
    dimension's value (code it with `coded`) and take a grouping by dimension each. Cells are dealt by mark once; every
    grouping and join after that finds its rows in place. inside: which cells count, instead of the context's predicate.
    """
    inside = F.coalesce(predicate(ctx, grain, dict(cells.dtypes)) if inside is None else inside, F.lit(False))
    plain = {n: t for n, t in measures.items() if not isinstance(t, ArgExtreme)}
    if len(plain) < len(measures):
        cells = cells.repartition(*keys)
    out = cells.groupBy(*keys).agg(F.bool_or(inside).alias("alive"), *[flat(t, inside=inside).alias(n) for n, t in plain.items()])
    out = out.withColumns({n: F.when(F.col("alive"), F.col(n)) for n in plain}) if plain else out
    for name, t in measures.items():
        if isinstance(t, ArgExtreme):
            inner = cells.where(inside).groupBy(*keys, t.dimension).agg(flat(t.inner).alias("iv"))
            best = inner.where(F.col("iv").isNotNull() & ~F.isnan("iv")).groupBy(*keys).agg(extreme(F.col(t.dimension), F.col("iv"), t.largest).alias(name))
            out = out.join(best, list(keys), "left")
    return out.select(*keys, *measures, "alive")


def coded(folded: DataFrame, measures: dict[str, Expr], domains: dict[str, list[str]]) -> DataFrame:
    """A fold as its readers take it: z, tx, ty, mki, numbers as f32 with NaN for nothing, arg measures as canonical codes
    of their dimension's domain (at most 4096 values) with 65535 for nothing."""
    from .pyramid import numbered

    rows = folded if "mki" in folded.columns else numbered(folded)
    nan = F.lit(float("nan")).cast("float")

    def edge(name: str, t: Expr) -> Column:
        if not isinstance(t, ArgExtreme):
            return F.coalesce(F.col(name).cast("float"), nan)
        at = F.nullif(F.array_position(F.lit(domains[t.dimension]).cast("array<string>"), F.col(name).cast("string")), F.lit(0)) - 1
        return F.coalesce(at, F.lit(UNKNOWN_CODE)).cast("int")

    return rows.select(*TILE, "mki", *[edge(n, t).alias(n) for n, t in measures.items()])


class FoldCache:
    """Coded folds by (version, tile, measures, context); the least recently used of `size` tiles leaves first.

    A tile of a fold is a screenful of marks by nature, so its rows are kept on the driver. fold: called with the tiles
    that are missing, gives their coded rows.
    """

    def __init__(self, size: int = 256):
        self.size, self.kept = size, OrderedDict()

    @staticmethod
    def key(version: str, tile, measures: dict[str, Expr], ctx: Context):
        return version, tuple(tile), tuple(sorted((n, str(t)) for n, t in measures.items())), tuple(sorted(ctx.equals.items())), tuple(sorted(ctx.ranges.items()))

    def get(self, version: str, tiles, measures: dict[str, Expr], ctx: Context, fold) -> dict:
        """tile -> its rows, in order of mki."""
        keys = {tuple(t): self.key(version, t, measures, ctx) for t in tiles}
        missing = [t for t, k in keys.items() if k not in self.kept]
        found = {t: self.kept[k] for t, k in keys.items() if k in self.kept}
        if missing:
            fresh: dict = {t: [] for t in missing}
            for r in fold(missing).orderBy(*TILE, "mki").collect():
                fresh[r.z, r.tx, r.ty].append(r)
            found |= fresh
        for t, k in keys.items():
            self.kept[k] = found[t]
            self.kept.move_to_end(k)
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)
        return found


def control(channel: str, kind: str, value) -> Column:
    """The predicate of one control of a view: select (a value), multiSelect (a list), dateRange (from..to), range (lo, hi).

    Open ends are None; an empty list or value lets everything pass.
    """
    c = F.col(channel)
    if value in (None, "", "(all)") or value == []:
        return F.lit(True)
    if kind == "select":
        return c == F.lit(value)
    if kind == "multiSelect":
        return c.isin(*value)
    if kind == "dateRange":
        lo, hi = parse_range(value) or (None, None)
        day = F.to_date(c)
        return reduce(and_, [F.lit(True), *[day >= F.lit(lo).cast("date")] * bool(lo), *[day <= F.lit(hi).cast("date")] * bool(hi)])
    if kind == "range":
        lo, hi = value
        return reduce(and_, [F.lit(True), *([c >= lo] if lo is not None else []), *([c <= hi] if hi is not None else [])])
    raise ValueError(f"unknown control '{kind}'")


def controlled(df: DataFrame, view, values: dict) -> DataFrame:
    """Rows that pass all controls of a view. values: by channel; controls without one use their default."""
    for f in view.filters:
        df = df.where(control(f["channel"], f.get("control", "select"), values.get(f["channel"], f.get("default"))))
    return df


def tile_keys(texts) -> dict[int, list[tuple[int, int]]]:
    """'z/x/y' keys by zoom."""
    out = defaultdict(list)
    for z, x, y in (map(int, t.split("/")) for t in texts):
        out[z].append((x, y))
    return dict(out)


def viewport_range(root: Bbox, tiles) -> Column:
    """A plain range on x and y around all requested tiles, which the scan can push down; exact membership comes later."""
    lo_x, lo_y, hi_x, hi_y = [], [], [], []
    for z, x, y in tiles:
        n = 1 << z
        lo_x.append(x / n), lo_y.append(y / n), hi_x.append((x + 1) / n), hi_y.append((y + 1) / n)
    out = F.lit(True)
    for axis, lo, hi in (("x", lo_x, hi_x), ("y", lo_y, hi_y)):
        a, b = root.axis(axis)
        slack = 1e-6 * (b - a)
        if min(lo) > 0:
            out = out & (F.col(axis) >= F.lit(a + min(lo) * (b - a) - slack))
        if max(hi) < 1:
            out = out & (F.col(axis) <= F.lit(a + max(hi) * (b - a) + slack))
    return out


def in_request(tiles) -> Column:
    """Membership in the tiles of one request, a screenful by nature: a literal list of packed keys, no join."""
    packed = [(z << 54) | (x << 27) | y for z, x, y in tiles]
    return F.shiftleft(F.col("z").cast("long"), 54).bitwiseOR(F.shiftleft(F.col("tx"), 27)).bitwiseOR(F.col("ty")).isin(packed)


def cells_of(facts: DataFrame, root: Bbox, tiles, grain, parts: list[Partial]) -> DataFrame:
    """Cells of the requested tiles from facts (x, y, zreal, channels). One plan for all zooms."""
    tiles = [tuple(map(int, t)) for t in tiles]
    used = sorted({c for p in parts for c in (p.channel, p.weight) if c})
    near = indexed(facts.where(viewport_range(root, tiles)).select("x", "y", "zreal", *dict.fromkeys([*grain, *used])), root)
    rows = at_zooms(near, F.array(*[F.lit(z) for z in sorted({t[0] for t in tiles})])).where(in_request(tiles)).withColumns(mark_keys())
    return rows.groupBy(*MARK, *grain).agg(*[p.from_facts() for p in parts])


def fold(facts: DataFrame, root: Bbox, measures: dict[str, Expr], ctx: Context, tiles, grain) -> DataFrame:
    """z, tx, ty, mark key, measures, alive; marks of a tile keep their rows whatever the context."""
    parts = list(dict.fromkeys([*partials(measures.values()), Partial("cnt")]))
    return tail(cells_of(facts, root, tiles, grain, parts), MARK, measures, ctx, grain)


def fold_cube(cube: DataFrame, measures: dict[str, Expr], ctx: Context, tiles, grain) -> DataFrame:
    """The same from a materialised cube: a scan of the requested tiles and of the needed partials."""
    tiles = [tuple(map(int, t)) for t in tiles]
    parts = [p.name for p in partials(measures.values())]
    cells = cube.where(F.col("z").isin(sorted({t[0] for t in tiles})) & in_request(tiles)).select(*MARK, *grain, *parts)
    return tail(cells, MARK, measures, ctx, grain)


def default_context(facts: DataFrame, root: Bbox, measures, tiles, grain) -> DataFrame:
    return fold(facts, root, measures, Context(), tiles, grain)


def inspect(facts: DataFrame, root: Bbox, measures, ctx: Context, tile, grain) -> DataFrame:
    """The fold of one tile, marks that survive only."""
    return fold(facts, root, measures, ctx, [tile], grain).where("alive").drop("alive")
