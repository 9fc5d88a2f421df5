"""Helpers shared by the training-data operators."""
from __future__ import annotations

import gc
import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: ASCII white space of the contracts: space and \x09-\x0D, the set that bytes.split() uses.
WORD_GAP = "[ \\t-\\r]+"
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share. A local one serves only a local master (tests); a cluster must name its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def limit_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold BATCH_BYTES at most, unless the session says otherwise: rows alone bound no memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Stash:
    """Written tables in the shared folder: lineage is cut, sizes are known to the planner, and files go when dropped.

    As a context it removes all that is left at its end, so results that outlive it must be `cut` first.
    """

    def __init__(self, spark: SparkSession):
        limit_batches(spark)
        self.spark, self.at, self.names = spark, f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}", itertools.count()

    def put(self, df: DataFrame, **options) -> DataFrame:
        path = f"{self.at}/{next(self.names)}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stashed = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._stashed)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        remove(self.spark, self.at)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that nothing refers to any more.

    Spark frees them when the driver happens to collect garbage; iterative jobs would fill the disks before that.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row; Catalyst would else copy it into lambdas."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def salted(hot: DataFrame, small: DataFrame, keys: list[str], salts: int, by: Column, how: str = "inner") -> DataFrame:
    """Join whose rows of one key spread over `salts` tasks; `small` (unique keys) is repeated per salt.

    by: a column of hot that spreads the rows of a key.
    """
    spread = hot.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


#: A key is hot if it holds at least a thousandth of the rows, so there are at most a thousand hot keys at any size.
HOT_KEYS, HOT_LEAST, HOT_SALTS = 1000, 200, 64


def spread(hot: DataFrame, small: DataFrame, keys: list[str], total: int, by: Column, how: str = "inner") -> DataFrame:
    """Join of `hot` with `small`, whose keys are unique and whose column n says how many of `total` rows of hot each key has.

    Rows of hot keys go to HOT_SALTS tasks, and only these keys of small are repeated. The list of hot keys is broadcast:
    it has HOT_KEYS rows at most.
    """
    salt, mark = spare(hot, "salt", "is_hot")
    large = F.col("n") >= max(HOT_LEAST, total / HOT_KEYS)
    known = F.broadcast(small.where(large).select(*keys, F.lit(True).alias(mark)))
    dealt = hot.join(known, keys, "left").withColumn(salt, F.when(F.col(mark), F.pmod(F.xxhash64(by), F.lit(HOT_SALTS)).cast("int")).otherwise(F.lit(0))).drop(mark)
    copies = small.withColumn(salt, F.explode(F.when(large, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have, however its own are cased."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def plus(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of df with one more field; StructType.add would change the one that df caches."""
    return StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])
