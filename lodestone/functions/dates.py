"""Calendar days and date ranges."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers below this are days since 1970, others milliseconds.
DAY_LIMIT = 10_000_000


def iso_day(c: Column, kind: str) -> Column:
    """yyyy-MM-dd of a date, timestamp, day count, epoch milliseconds or text column of the given Spark type name."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        days = F.date_add(F.lit("1970-01-01").cast("date"), F.when(c < DAY_LIMIT, c).cast("int"))
        return F.date_format(F.coalesce(days, F.timestamp_millis(F.when(c >= DAY_LIMIT, c).cast("long")).cast("date")), "yyyy-MM-dd")
    return c if kind == "string" else F.date_format(c.cast("date"), "yyyy-MM-dd")


def parse_range(text: str | None) -> tuple[str | None, str | None] | None:
    """'from..to' with open ends; a bare date is that day; nothing is no range."""
    if not text or text == "(all)":
        return None
    lo, dots, hi = text.partition("..")
    return (lo or None, hi or None) if dots else (lo, lo)


def make_range(lo: str | None, hi: str | None) -> str:
    return "" if not lo and not hi else lo if lo == hi else f"{lo or ''}..{hi or ''}"


def in_range(day: str, text: str | None) -> bool:
    r = parse_range(text)
    return r is None or (r[0] is None or day >= r[0]) and (r[1] is None or day <= r[1])
