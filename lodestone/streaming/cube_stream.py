"""A cube kept up to date from a stream: additive partials of each micro-batch are merged into a table of versions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import Partial
from ..sources import files


def merge(old: DataFrame | None, new: DataFrame, keys: list[str], parts: list[Partial]) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*keys).agg(*[p.merged() for p in parts])


class CubeSink:
    """foreachBatch target. A batch writes its own cells as delta d<epoch>; every `compact` deltas are merged into a base
    b<epoch> that covers all epochs up to its own, and what it covers is removed. A delta names its batch, so a batch that
    is replayed after a failure is recognised and not added twice. Only folders with a _SUCCESS file count."""

    def __init__(self, folder: str, keys: list[str], parts: list[Partial], compact: int = 16):
        self.folder, self.keys, self.parts, self.compact = folder, keys, parts, compact

    def _written(self) -> tuple[int, list[int]]:
        """The epoch of the newest base (-1 without one) and the epochs of deltas after it."""
        done = [n for n in files.names(self.folder) if n[:1] in "bd" and n[1:].isdigit() and files.exists(f"{self.folder}/{n}/_SUCCESS")]
        base = max([int(n[1:]) for n in done if n[0] == "b"], default=-1)
        return base, sorted(int(n[1:]) for n in done if n[0] == "d" and int(n[1:]) > base)

    def versions(self) -> list[int]:
        """Epochs that are in the cube and can still be told apart, the newest last."""
        base, deltas = self._written()
        return ([base] if base >= 0 else []) + deltas

    def read(self, spark: SparkSession) -> DataFrame | None:
        base, deltas = self._written()
        paths = [f"{self.folder}/b{base}"] * (base >= 0) + [f"{self.folder}/d{e}" for e in deltas]
        return merge(None, spark.read.parquet(*paths), self.keys, self.parts) if paths else None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        base, deltas = self._written()
        if epoch <= base or epoch in deltas:
            return
        cells = batch.groupBy(*self.keys).agg(*[p.from_facts() for p in self.parts])
        cells.write.mode("overwrite").parquet(f"{self.folder}/d{epoch}")
        if len(deltas) + 1 >= self.compact:
            self.read(batch.sparkSession).write.mode("overwrite").parquet(f"{self.folder}/b{epoch}")
            for n in files.names(self.folder):
                if n[:1] in "bd" and n[1:].isdigit() and int(n[1:]) <= epoch and n != f"b{epoch}":
                    files.remove(f"{self.folder}/{n}")


def windowed_partials(stream: DataFrame, time: str, width: str, late: str, keys: list[str], parts: list[Partial]) -> DataFrame:
    """Partials per window and key of an event stream; windows close once `late` has passed."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*[p.from_facts() for p in parts]).select(F.col("w.start").alias("start"), *keys, *[p.name for p in parts])
