"""Facts to marks: which channels vary within a mark, and one row per place."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Channel, View
from ..functions.measures import ArgExtreme, extreme, flat, over_facts, parse, partials

SHAPE = ("geometry", "part_offsets")


def classify_frame(facts: DataFrame, channels: list[str]) -> DataFrame:
    """(channel, per_fact): whether some place holds two values of it, null being a value.

    One pass: per place, min against max and the nulls of each channel; no distinct sets are kept.
    """
    per_place = facts.groupBy("x", "y").agg(*[f.alias(f"{k}_{c}") for c in channels for k, f in (("lo", F.min(c)), ("hi", F.max(c)), ("nulls", F.count_if(F.col(c).isNull())))], F.count(F.lit(1)).alias("_n"))
    varies = [((F.col(f"lo_{c}") < F.col(f"hi_{c}")) | ((F.col(f"nulls_{c}") > 0) & (F.col(f"nulls_{c}") < F.col("_n")))) for c in channels]
    found = per_place.agg(*[F.coalesce(F.bool_or(v), F.lit(False)).alias(c) for c, v in zip(channels, varies)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("per_fact")) for c in channels])).alias("r")).select("r.*")


def classify(facts: DataFrame, view: View) -> tuple[list[str], list[str]]:
    """Names of per-mark and per-fact channels; checks the view's rules that need them."""
    names = [c.name for c in view.channels]
    varies = {r.channel for r in classify_frame(facts, names).collect() if r.per_fact} if names else set()
    view.validate_classified(varies)
    return [n for n in names if n not in varies], [n for n in names if n in varies]


def group(facts: DataFrame, view: View, per_mark: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per place: shape, per-mark channels and every measure without a filter context.

    order: columns that decide which fact gives a place its shape and channels where facts differ; the view's identity
    channels, or else the values themselves. With zreal, a place has the least of its facts.
    """
    trees = {m.name: m.tree for m in view.measures}
    keep = [c for c in (*SHAPE, *per_mark) if c in facts.columns]
    plain = {n: t for n, t in trees.items() if not isinstance(t, ArgExtreme)}
    by = order or [c.name for c in view.channels if c.role == "identity" and c.name in facts.columns]
    stands = [F.min_by(F.struct(*keep), F.struct(*by, *(c for c in keep if c not in by))).alias("_kept")] if keep else []
    least = [F.min("zreal").alias("zreal")] if "zreal" in facts.columns else []
    out = facts.groupBy("x", "y").agg(*stands, *least, *[flat(t, over_facts).cast("float").alias(n) for n, t in plain.items()], F.count(F.lit(1)).alias("n_facts"))
    out = out.select("x", "y", *[F.col("_kept")[c].alias(c) for c in keep], *[c for c in out.columns if c not in ("x", "y", "_kept")])
    for name, t in trees.items():
        if isinstance(t, ArgExtreme):
            out = out.join(arg_measure(facts, ["x", "y"], name, t), ["x", "y"], "left")
    return out


def aggregate_block(facts: DataFrame, spec: dict) -> DataFrame:
    """A view's aggregate block: one row per combination of `by`, with each of `measures` (name: expression)."""
    by, trees = list(spec["by"]), {n: parse(e) for n, e in (spec.get("measures") or {}).items()}
    plain = [flat(t, over_facts).alias(n) for n, t in trees.items() if not isinstance(t, ArgExtreme)]
    out = facts.groupBy(*by).agg(*plain) if plain else facts.select(*by).distinct()
    for name, t in trees.items():
        if isinstance(t, ArgExtreme):
            best = arg_measure(facts, by, name, t)
            same = [out[c].eqNullSafe(best[c]) for c in by]
            out = out.join(best, same, "left").select(*[out[c] for c in out.columns], best[name])
    return out.select(*by, *trees)


def artifacts(facts: DataFrame, view: View, per_mark: list[str]) -> DataFrame:
    """(channel, position, value): canonical orders of what a grouped view shows as a dictionary, at most 4096 values each.

    Per-mark dictionaries are ordered by their own values, an arg measure by all values of its dimension over the facts,
    not just those that win somewhere.
    """
    from .domains import coded

    source = {c.name: c.name for c in view.channels if c.type == "dict" and c.name in per_mark} | {m.name: m.tree.dimension for m in view.measures if isinstance(m.tree, ArgExtreme)}
    orders = [coded(facts, column).select(F.lit(shown).alias("channel"), F.col("code").alias("position"), "value") for shown, column in source.items()]
    out = orders[0] if orders else facts.sparkSession.createDataFrame([], "channel string, position int, value string")
    for o in orders[1:]:
        out = out.unionByName(o)
    return out


def arg_measure(facts: DataFrame, keys: list[str], name: str, t: ArgExtreme) -> DataFrame:
    """(keys, name): the dimension value with the extremal inner aggregate, the first in order on ties."""
    inner = facts.groupBy(*keys, t.dimension).agg(flat(t.inner, over_facts).alias("iv")).where(F.col("iv").isNotNull() & ~F.isnan("iv"))
    return inner.groupBy(*keys).agg(extreme(F.col(t.dimension), F.col("iv"), t.largest).alias(name))


def effective_view(view: View, per_mark: list[str]) -> View:
    """What is drawn: per-mark channels and measures as channels (arg measures as dictionaries, others f32)."""
    if not view.grouped:
        return view
    made = tuple(Channel(m.name, m.name, "dimension" if isinstance(m.tree, ArgExtreme) else "measure", "dict" if isinstance(m.tree, ArgExtreme) else "f32") for m in view.measures)
    return replace(view, channels=(Channel("id", "id", "identity", "dict"), *(c for c in view.channels if c.name in per_mark), *made), measures=())


def grain_of(view: View, per_fact: list[str]) -> list[str]:
    """Channels that cube cells are kept apart by."""
    return [c.name for c in view.channels if c.name in per_fact and (c.type in ("dict", "date") or c.role == "temporal")]


def cube_partials(view: View):
    from ..functions.measures import Partial

    return list(dict.fromkeys([*partials([m.tree for m in view.measures]), Partial("cnt")]))
