"""Channel domains: numeric range with quantile grid, distinct values, temporal range."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NUMERIC, View
from ..functions.dates import iso_day
from ..functions.quantiles import quantiles

QUANTILES, CAP = 129, 4096
#: Sketched quantiles are off by at most 1 / ACCURACY of the rows in rank.
ACCURACY = 10_000


def numeric(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """min, max and a grid of 129 quantiles, linear between ranks (or sketched)."""
    at = [i / (QUANTILES - 1) for i in range(QUANTILES)]
    v = F.col(column).cast("double")
    if exact:
        return quantiles(df, v, at).where("n > 0").select("min", "max", F.col("q").alias("quantiles"))
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.percentile_approx(v, at, ACCURACY).alias("quantiles")).where("min is not null")


def distinct(df: DataFrame, column: str) -> DataFrame:
    """Distinct values as text, null as 'null', in code-point order."""
    return df.select(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("value")).distinct().orderBy("value")


def coded(df: DataFrame, column: str) -> DataFrame:
    """(value, code): canonical codes by position in the ordered domain."""
    values = distinct(df, column).limit(CAP + 1).agg(F.sort_array(F.collect_list("value")).alias("v"))
    return values.select(F.posexplode("v").alias("code", "value")).select("value", "code")


def temporal(df: DataFrame, column: str) -> DataFrame:
    kind = dict(df.dtypes)[column]
    day = iso_day(F.col(column), kind)
    return df.agg(F.min(day).alias("from"), F.max(day).alias("to")).where("`from` is not null")


def values_of(df: DataFrame, column: str) -> tuple[list[str], bool]:
    """At most CAP values for a manifest, and whether there are more."""
    got = [r.value for r in df.select(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("value")).distinct().limit(CAP + 1).collect()]
    return sorted(got)[:CAP], len(got) > CAP


def scan(df: DataFrame, view: View) -> dict[str, dict]:
    """Domains of all channels that the data has; absent columns and all-null numbers are left out."""
    out: dict[str, dict] = {}
    for c in (c for c in view.channels if c.name in df.columns and c.role != "identity"):
        if c.type in NUMERIC:
            r = numeric(df, c.name, exact=False).first()
            if r:
                out[c.name] = {"min": r["min"], "max": r["max"], "quantiles": list(r.quantiles)}
        elif c.type == "date":
            r = temporal(df, c.name).first()
            if r:
                out[c.name] = {"values": list(dict.fromkeys([r["from"], r["to"]]))}
        else:
            values, more = values_of(df, c.name)
            out[c.name] = {"values": values, "truncated": more}
    return out
