"""Document quality by hierarchical empirical Bayes: classifier evidence plus posteriors of host and path.

A document classifier (boosted trees over dense features, fitted on at most `max_labels` labelled rows chosen by hash)
gives each row its probability p under the global prior and so its evidence, logit(p) - logit(prior). Two classifiers are
fitted, each on one half of the labelled rows; a row they were fitted on is judged by the other one, all others by the
mean of both. Soft counts (n, sum of v) are grouped by path and by host, where v is the label of a labelled row and p
elsewhere. The spread between hosts, and between the paths of a host, beyond what sampling explains gives two
concentrations by the method of moments; each host shrinks to the global prior, each path to its host, by
n / (n + concentration). A document's score adds its evidence to the log odds of its path. Host and path counts both
leave the document itself out, so a page alone on its path rests on its host, and a page alone on its host on the prior.

Only (host, path) sums are shuffled, pre-aggregated; hosts and paths return to the rows by salted joins.

Cases: null hosts form one host, null paths one path of it; null text counts as empty; a document labelled twice counts
by its smaller label; without labels of both kinds the evidence is 0 and the prior the label mean (0.5 with none); one
host or path alone has no spread and gets the largest concentration.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import toxicity
from .chunked import per_process
from .common import cut, limit_batches, salted

MAX_LABELS, SALTS, LARGEST = 20_000, 64, 1e6


def features(text: str, tokens: toxicity.Tokens) -> list[float]:
    lines = [x for x in text.split("\n") if x.strip()]
    words = text.split()
    runs = list(zip(words, words[1:], words[2:], words[3:]))
    n = max(1, len(words))
    return [*toxicity.shape(text, words, Counter(words), tokens), len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(runs)) / max(1, len(runs)), float(len(words) < 20), sum(len(w) == 1 and not w.isalnum() for w in words) / n]


WIDTH = len(toxicity.SHAPES) + 5


def matrix(texts: list) -> np.ndarray:
    tokens = per_process("tokens", toxicity.Tokens)
    return np.array([features(t or "", tokens) for t in texts], np.float64).reshape(len(texts), WIDTH)


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))


def train(docs: DataFrame, known: DataFrame) -> tuple[list[toxicity.Boosted], float]:
    """One classifier fitted on fold 1 and one on fold 0 of known (doc_id, y, fold; bounded), and the share of label 1."""

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("fold"), pa.array(list(matrix(b.column("text").to_pylist())), pa.list_(pa.float64()))], names=["doc_id", "y", "fold", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").mapInArrow(measured, "doc_id long, y int, fold int, x array<double>")
    got = sorted(rows.groupBy("doc_id").agg(F.min(F.struct("x", "y", "fold")).alias("r")).select("doc_id", "r.*").collect(), key=lambda r: r.doc_id)
    y, fold = np.array([r.y for r in got], np.float64), np.array([r.fold for r in got], np.int64)
    x = np.array([r.x for r in got], np.float64).reshape(len(got), WIDTH)
    return [toxicity.Boosted(rounds=40).fit(x[fold != k], y[fold != k]) for k in (0, 1)], float(y.mean()) if len(y) else 0.5


def concentration(groups: DataFrame, around: Column) -> float:
    """Method of moments from (n, s): how many observations a group's prior is worth."""
    r = F.col("s") / F.col("n")
    a = groups.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * (r - around) ** 2).alias("ssb"), F.sum(F.col("n") * around * (1 - around)).alias("v")).first()
    if not a.n or a.g < 2:
        return LARGEST
    within, n0 = a.v / a.n, (a.n - a.n2 / a.n) / (a.g - 1)
    between = max(0.0, (a.ssb / (a.g - 1) - within) / max(n0, 1e-9))
    return float(min(LARGEST, max(1.0, within / between - 1))) if between > 0 else LARGEST


def posteriors(rows: DataFrame, mean: float, m_host: float, m_path: float) -> DataFrame:
    """rows (v, host_n, host_s, path_n, path_s) with host_posterior and path_posterior, the row itself left out of both."""
    host = (F.col("host_s") - F.col("v") + m_host * mean) / (F.col("host_n") - 1 + m_host)
    return rows.withColumn("host_posterior", host).withColumn("path_posterior", (F.col("path_s") - F.col("v") + m_path * F.col("host_posterior")) / (F.col("path_n") - 1 + m_path))


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score for every row."""
    limit_batches(docs.sparkSession)
    given = known_labels(labels)
    known = cut(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")))
    models, prior = train(docs, known)
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))

    def apply(batches):
        for b in batches:
            x, fold = matrix(b.column("text").to_pylist()), b.column("fold").fill_null(-1).to_numpy(zero_copy_only=False)
            each = np.stack([m.margin(x) - m.base + base if m.trees else np.full(b.num_rows, base) for m in models])
            margin = np.where(fold == 0, each[0], np.where(fold == 1, each[1], each.mean(0)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(margin, pa.float64()), pa.array(1 / (1 + np.exp(-margin)))], names=["doc_id", "host", "path", "margin", "p"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("\u0000")).alias("host"), F.coalesce(path.cast("string"), F.lit("\u0000")).alias("path"), "text")
    rows = rows.join(F.broadcast(known.select("doc_id", "fold")), "doc_id", "left").mapInArrow(apply, "doc_id long, host string, path string, margin double, p double")
    rows = cut(rows.join(given, "doc_id", "left").withColumn("v", F.coalesce(F.col("y").cast("double"), F.col("p"))).drop("y"))
    paths = cut(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("path_n"), F.sum("v").alias("path_s")))
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    whole = hosts.agg(F.sum("host_s") / F.sum("host_n")).first()[0]
    mean = 0.5 if whole is None else float(whole)
    m_host = concentration(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), F.lit(mean))
    both = paths.join(hosts, "host")
    m_path = concentration(both.select(F.col("path_n").alias("n"), F.col("path_s").alias("s"), ((F.col("host_s") + m_host * mean) / (F.col("host_n") + m_host)).alias("around")), F.col("around"))
    out = posteriors(salted(rows, both, ["host", "path"], SALTS, F.col("doc_id")), mean, m_host, m_path).withColumn("evidence", F.col("margin") - F.lit(base))
    return out.select("doc_id", "evidence", "host_posterior", "path_posterior", (1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("path_posterior")))))).alias("score"))


def of_url(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, for tables that have one."""
    return F.lower(F.parse_url(url, F.lit("HOST"))), F.regexp_extract(F.parse_url(url, F.lit("PATH")), "^/([^/]*)", 1)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Hosts are sources. Documents carry no path, so the language section of a source stands in for it."""
    return scored(docs, labels, F.col("source"), F.col("lang")).withColumn("kept", F.col("score") >= 0.5)
