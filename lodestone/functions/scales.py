"""Value to bucket and colour: scale inference, normalisation, breaks, legends, lookup tables."""
from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles

# Named colour ramps and palettes.
SEQUENTIAL = {
    "viridis": ["#440154", "#3b528b", "#21918c", "#5ec962", "#fde725"],
    "plasma": ["#0d0887", "#7e03a8", "#cc4778", "#f89540", "#f0f921"],
    "magma": ["#000004", "#51127c", "#b73779", "#fc8961", "#fcfdbf"],
    "inferno": ["#000004", "#57106e", "#bc3754", "#f98e09", "#fcffa4"],
    "cividis": ["#00204d", "#3d4c6b", "#7c7b78", "#bcaf6f", "#ffe945"],
    "turbo": ["#30123b", "#3f9afd", "#1ae4b6", "#f9ba38", "#7a0403"],
    "blues": ["#cde2fb", "#86b6ef", "#3987e5", "#1c5cab", "#0d366b"],
    "greens": ["#e5f5e0", "#a1d99b", "#41ab5d", "#238b45", "#00441b"],
    "oranges": ["#feedde", "#fdbe85", "#fd8d3c", "#e6550d", "#a63603"],
    "greys": ["#1e1e1e", "#505050", "#828282", "#bebebe", "#f5f5f5"],
}
DIVERGING = {
    "blueRed": ["#2a78d6", "#f0efec", "#e34948"],
    "redBlue": ["#e34948", "#f0efec", "#2a78d6"],
    "blueOrange": ["#2166ac", "#f7f7f7", "#b35806"],
    "purpleGreen": ["#762a83", "#f7f7f7", "#1b7837"],
    "spectral": ["#3288bd", "#99d594", "#ffffbf", "#fc8d59", "#d53e4f"],
}
CATEGORICAL = {
    "okabeIto": ["#E69F00", "#56B4E9", "#009E73", "#F0E442", "#0072B2", "#D55E00", "#CC79A7", "#BBBBBB"],
    "category": ["#3987e5", "#199e70", "#c98500", "#008300", "#9085e9", "#e66767", "#d55181", "#d95926"],
    "status": ["#0ca30c", "#fab219", "#ec835a", "#d03b3b"],
}
LEGEND_CAP, LUT_TEXELS, LOG_FLOOR = 10, 1024, 1e-9


def scale_type(encoding: dict, domain: dict | None = None) -> str:
    """What is said explicitly, else what palette, thresholds or a value list imply, else linear."""
    if encoding.get("scale"):
        return encoding["scale"]
    if encoding.get("palette"):
        return "categorical"
    if encoding.get("thresholds"):
        return "threshold"
    return "categorical" if domain and "values" in domain else "linear"


def normalized(v: Column, lo: float, hi: float, kind: str = "linear") -> Column:
    """Position in [0, 1]; log and sqrt act on both ends too, log above a floor."""
    f = {"linear": lambda x: x, "sqrt": lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), "log": lambda x: F.log(F.greatest(x, F.lit(LOG_FLOOR)))}[kind]
    g = {"linear": lambda x: x, "sqrt": lambda x: math.sqrt(max(x, 0.0)), "log": lambda x: math.log(max(x, LOG_FLOOR))}[kind]
    a, b = g(lo), g(hi)
    t = (f(v.cast("double")) - F.lit(a)) / F.lit(b - a) if b > a else F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def diverging(v: Column, lo: float, mid: float, hi: float) -> Column:
    """0..0.5 below the midpoint, 0.5..1 above, each arm stretched by itself."""
    v = v.cast("double")
    below = 0.5 * (v - lo) / (mid - lo) if mid > lo else F.lit(0.5)
    above = 0.5 + 0.5 * (v - mid) / (hi - mid) if hi > mid else F.lit(0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v < mid, below).otherwise(above)))


def robust_bounds(df: DataFrame, column: str) -> DataFrame:
    """2nd and 98th percentile of finite values, linear between ranks; least and largest below 8 of them."""
    v = F.when(~F.isnan(column), F.col(column).cast("double"))
    got = quantiles(df, v, [0.02, 0.98])
    return got.select(F.when(F.col("n") >= 8, F.col("q")[0]).otherwise(F.col("min")).alias("lo"), F.when(F.col("n") >= 8, F.col("q")[1]).otherwise(F.col("max")).alias("hi"))


def quantized(v: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin from 0, clamped at both ends."""
    return (F.greatest(F.lit(1), F.least(F.lit(bins), F.width_bucket(v.cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)))) - 1).cast("int")


def thresholded(v: Column, breaks: list[float]) -> Column:
    """Number of breaks at or below the value."""
    return sum(((v.cast("double") >= b).cast("int") for b in sorted(breaks)), F.lit(0))


def quantile_breaks(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bins - 1 inner breaks, one row."""
    return quantiles(df, F.col(column), [i / bins for i in range(1, bins)]).select(F.col("q").alias("breaks"))


def quantile_bin(df: DataFrame, column: str, bins: int) -> DataFrame:
    """df with `bin`; the one row of breaks is attached by broadcast."""
    at = F.size(F.filter("breaks", lambda b: b <= F.col(column).cast("double"))).cast("int")
    return df.join(F.broadcast(quantile_breaks(df, column, bins))).withColumn("bin", at).drop("breaks")


def sized(v: Column, lo: float, hi: float, least: float = 2.0, most: float = 24.0) -> Column:
    """Size of a mark between two radii, its area in step with the value; the least for what has none."""
    some = v.isNotNull() & ~F.isnan(v.cast("double"))
    return F.when(some, F.lit(least) + (most - least) * F.sqrt(normalized(v, lo, hi))).otherwise(F.lit(least))


def category_code(v: Column, domain: list[str]) -> Column:
    """Position in the domain; its size for anything unknown."""
    return F.coalesce(F.nullif(F.array_position(F.lit(domain).cast("array<string>"), v), F.lit(0)) - 1, F.lit(len(domain))).cast("int")


def known(v: Column, domain: list[str] | None = None) -> Column:
    """False for marks that carry no value: NaN, or a code past the domain."""
    return v < len(domain) if domain is not None else ~F.isnan(v)


def palette_color(code: Column, palette: list[str]) -> Column:
    """Colours in fixed order, repeating past the end."""
    return F.get(F.lit(palette).cast("array<string>"), F.pmod(code, F.lit(len(palette))).cast("int"))


def rgb(color: str) -> tuple[int, int, int]:
    return tuple(int(color[i : i + 2], 16) for i in (1, 3, 5))


def stops(scheme: str | None, family: str = "sequential") -> list[tuple[int, int, int]]:
    table, default = {"sequential": (SEQUENTIAL, "viridis"), "diverging": (DIVERGING, "blueRed"), "categorical": (CATEGORICAL, "okabeIto")}[family]
    return [rgb(c) for c in table.get(scheme or "", table[default])]


def interpolated(t: Column, ramp: list[tuple[int, int, int]]) -> Column:
    """Piecewise linear struct(r, g, b) at t in [0, 1], rounded."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (len(ramp) - 1)
    i = F.least(F.floor(t), F.lit(len(ramp) - 2)).cast("int")
    channel = lambda k: F.floor(F.get(F.lit([float(s[k]) for s in ramp]).cast("array<double>"), i) * (1 - (t - i)) + F.get(F.lit([float(s[k]) for s in ramp]).cast("array<double>"), i + 1) * (t - i) + 0.5).cast("int")
    return F.struct(*[channel(k).alias(n) for k, n in enumerate("rgb")])


def ramp_at(t: float, ramp) -> tuple[int, int, int]:
    t = min(1.0, max(0.0, t)) * (len(ramp) - 1)
    i = min(int(t), len(ramp) - 2)
    return tuple(math.floor(a * (1 - (t - i)) + b * (t - i) + 0.5) for a, b in zip(ramp[i], ramp[i + 1]))


def lookup_table(kind: str, scheme: str | None = None, breaks: list[float] = (), categories: int = 0) -> list[tuple[int, int, int]]:
    """Colours by texel: one per category and one for unknown, or 1024 over the range."""
    if kind == "categorical":
        colors = stops(scheme, "categorical")
        return [colors[i % len(colors)] for i in range(categories)] + [(128, 128, 128)]
    family = "diverging" if kind == "diverging" else "sequential"
    ramp = stops(scheme, family)
    if not breaks:
        return [ramp_at(i / (LUT_TEXELS - 1), ramp) for i in range(LUT_TEXELS)]
    lo, hi, n = breaks[0], breaks[-1], max(1, len(breaks))
    return [ramp_at(bisect_right(breaks, lo + (hi - lo) * i / (LUT_TEXELS - 1)) / n, ramp) for i in range(LUT_TEXELS)]


def legend(kind: str, breaks: list[float] = (), values: list[str] = (), lo: float | None = None, hi: float | None = None, data: tuple[float, float] | None = None) -> dict:
    """Items and labels, at most ten; flags where data goes past the ends."""
    if kind == "categorical":
        return {"items": list(values[:LEGEND_CAP]), "more": max(0, len(values) - LEGEND_CAP)}
    if breaks:
        ends = [f"< {breaks[0]:g}", *[f"{a:g} – {b:g}" for a, b in zip(breaks, breaks[1:])], f"≥ {breaks[-1]:g}"]
        return {"items": ends[:LEGEND_CAP], "more": max(0, len(ends) - LEGEND_CAP)}
    return {"lo": lo, "hi": hi, "clamped_lo": bool(data and data[0] < lo), "clamped_hi": bool(data and data[1] > hi)}


def embed_url(base: str, **state) -> str:
    """A link that carries the view state; f_<channel> are filters."""
    from urllib.parse import urlencode

    return f"{base}?{urlencode({k: v for k, v in state.items() if v not in (None, '')})}"


def parse_embed(url: str) -> dict:
    from urllib.parse import parse_qsl, urlsplit

    q = dict(parse_qsl(urlsplit(url).query))
    return {k: v for k, v in q.items() if not k.startswith("f_")} | {"filters": {k[2:]: v for k, v in q.items() if k.startswith("f_")}}
