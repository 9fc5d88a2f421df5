"""Small text files and folders in whatever file system holds them, through Spark's own file API."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("files are read and written through a Spark session; start one first")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm, p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def read(path: str) -> str | None:
    """The text of a file; None where there is none."""
    jvm, p, fs = _at(path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write(path: str, text: str) -> None:
    """Whole or not at all: written beside the file, then renamed over it."""
    jvm, p, fs = _at(path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    spark = SparkSession.getActiveSession()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    context.rename(fs.makeQualified(new), fs.makeQualified(p), how)


def names(folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    _, p, fs = _at(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(path: str) -> bool:
    _, p, fs = _at(path)
    return fs.exists(p)


def make(folder: str) -> None:
    _, p, fs = _at(folder)
    fs.mkdirs(p)


def remove(path: str) -> None:
    _, p, fs = _at(path)
    fs.delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; a local one serves a local master only."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='lodestone-')}/scratch-{uuid.uuid4().hex}"
