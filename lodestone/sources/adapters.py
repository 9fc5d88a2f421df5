"""Sources: any SQL text or Spark-readable data becomes the canonical facts x, y[, geometry, part_offsets], channels."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Channel, View
from ..functions import geometry
from ..functions.dates import iso_day

_PLAIN = {"f32": "float", "f64": "double", "i32": "int", "i64": "bigint"}


def _from_format(kind: str):
    return lambda spark, view: spark.read.format(kind).options(**{k: v for k, v in view.storage.get("options", {}).items()}).load(view.query)


def _jdbc(spark: SparkSession, view: View) -> DataFrame:
    return spark.read.format("jdbc").options(query=view.query, **view.storage.get("options", {})).load()


#: How each adapter turns source.query into a DataFrame: SQL over registered views, or a path.
ADAPTERS = {"sql": lambda spark, view: spark.sql(view.query), "jdbc": _jdbc} | {k: _from_format(k) for k in ("parquet", "orc", "csv", "json")}


def resolve(name: str):
    if name not in ADAPTERS:
        raise ValueError(f"no source adapter '{name}'")
    return ADAPTERS[name]


def register_tables(spark: SparkSession, folder: str, names) -> None:
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def placed(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with the place of each row in it, `_file` and `_row`, whatever tasks read it: the order of first()."""
    df = spark.read.parquet(path)
    at = df.metadataColumn("_metadata")
    return df.select("*", at["file_path"].alias("_file"), at["row_index"].alias("_row"))


def cast(c: Channel, kind: str) -> Column:
    """A channel in its declared type. Unsigned types wrap; dictionaries turn null into the text 'null'."""
    col = F.col(c.column)
    if c.type == "dict":
        return F.coalesce(col.cast("string"), F.lit("null"))
    if c.type == "date":
        return F.to_date(iso_day(col, kind))
    if c.type in ("u8", "u16"):
        return F.pmod(col.cast("bigint"), F.lit(256 if c.type == "u8" else 65536)).cast("int")
    return col.cast(_PLAIN[c.type])


def filtered(df: DataFrame, predicates) -> DataFrame:
    """All bake filters; the probe and the extract share them."""
    return reduce(lambda d, p: d.where(F.expr(p)), predicates, df)


def canonical(df: DataFrame, view: View) -> DataFrame:
    kinds = dict(df.dtypes)
    shape = geometry.columns(view.geometry)
    own = {c.name: cast(c, kinds.get(c.column, "string")) for c in view.channels}
    return filtered(df, view.bake_filters).select(*[v.alias(k) for k, v in {**shape, **own}.items()])


def facts(spark: SparkSession, view: View) -> DataFrame:
    return canonical(resolve(view.adapter)(spark, view), view)
