"""Connected components of an edge table by rounds of local union-find. Only row counts reach the driver.

A round deals its edges to tasks of about `per_task`, whichever end is hot; each task joins its own edges by union-find
and says for every node it saw the smallest node of the node's local tree. Over all tasks a node keeps the smallest of
these roots (a pre-aggregated minimum); where tasks differ, its other roots are joined to that one by edges of the next
round. The nodes of a round are the roots of the one before, so tables shrink, and the round whose edges fit a single
task is the last. Labels are then passed back from the last round to the first.
"""
from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, spread

PER_TASK = 200_000


def joined(pairs) -> dict[int, int]:
    """Every node of the pairs with the smallest node that they connect it to."""
    up: dict[int, int] = {}
    for a, b in pairs:
        for x in (a, b):
            up.setdefault(x, x)
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a < b:
            up[b] = a
        else:
            up[a] = b
    for x in sorted(up):  # parents are smaller, so theirs are settled
        up[x] = up[up[x]]
    return up


def _local(batches):
    up = joined(p for b in batches for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    at, ids, roots = 0, list(up), list(up.values())
    while at < len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 50_000], pa.int64()), pa.array(roots[at : at + 50_000], pa.int64())], names=["id", "root"])
        at += 50_000


def renamed(labels: DataFrame, upper: DataFrame) -> DataFrame:
    """labels (id, root) whose roots take their own root in upper, where they have one."""
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    to = upper.select(F.col("id").alias("root"), F.col("root").alias("to")).join(sizes, "root")
    return spread(labels, to, ["root"], labels.count(), F.col("id"), "left").select("id", F.coalesce("to", "root").alias("root"))


def components(stash: Stash, edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(id, root) for every end of edges (a, b): root is the smallest id reachable. A table of the stash.

    An edge from a node to itself makes it a component; no edges give no rows; repeated edges count once.
    """
    edges, levels = stash.put(edges.select("a", "b")), []
    while True:
        tasks = math.ceil(edges.count() / per_task)
        dealt = edges.repartition(tasks) if tasks > 1 else edges.coalesce(1)
        local = stash.put(dealt.mapInArrow(_local, "id long, root long"))
        stash.drop(edges)
        if tasks <= 1:
            break
        least = stash.put(local.groupBy("id").agg(F.min("root").alias("root")))
        levels.append(least)
        told = local.join(least.withColumnRenamed("root", "least"), "id").where("root <> least")
        edges = stash.put(told.select(F.col("least").alias("a"), F.col("root").alias("b")).distinct())
        stash.drop(local)
    while levels:
        below = levels.pop()
        labels = stash.put(renamed(below, local))
        stash.drop(below, local)
        local = labels
    return local
