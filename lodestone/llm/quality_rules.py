"""Quality rules over lines and words, in DataFrame functions only.

Base measures come from whole texts. The method is cross-document line frequency: normalised lines are hashed and
the distinct documents of a host that hold each are counted. A line of more than `line_docs` documents is common.
Texts that are almost only common lines are copies of one another rather than pages with boilerplate, so they have no
vote: a common line is removed where more than `line_docs` documents that would outlive its removal hold it, that is,
with `keep_share` of their characters or more elsewhere. A document that keeps less than `keep_share` of its characters
is depleted and rejected. (A group of copies thus never votes itself out; near-duplicate detection deals with it. A host
whose pages are 70 % template and 30 % own text is cleaned.)

Cases: null text has no words and fails the base rule; null hosts form one host; every row is a document, but equal
texts of a host count once; lines without a word are never counted or removed; empty tables give empty results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, cut, let, release, salted, spare

LINE_DOCS, KEEP_SHARE, SALTS = 20, 0.3, 64
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def _shifted(a: Column, by: int) -> Column:
    """hash(a[i], a[i + by]) wherever both exist."""
    size = F.size(a)
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(size - by, F.lit(0))), F.slice(a, F.lit(by + 1), F.greatest(size - by, F.lit(0))), lambda x, y: F.xxhash64(x, y))


def repeated_words(ws: Column) -> Column:
    """Words inside 8-word windows that occur twice or more. Window hashes double in width: 1, 2, 4, 8."""

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(p: Column) -> Column:
            at = lambda j: F.get(p, j)["h"]
            twice = F.filter(F.transform(p, lambda x, j: F.when((x["h"] == at(j - 1)) | (x["h"] == at(j + 1)), x["i"])), lambda i: i.isNotNull())
            return let(F.array_sort(twice), lambda q: F.aggregate(q, F.struct(F.lit(-8).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(8), i - acc["last"])).alias("n")))["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, count))

    one = F.transform(ws, lambda w: F.xxhash64(w))
    eight = let(one, lambda a: let(_shifted(a, 1), lambda b: let(_shifted(b, 2), lambda c: _shifted(c, 4))))
    return F.when(F.size(ws) < 9, F.lit(0)).otherwise(let(eight, covered)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host, text hash, base measures and one (hash, characters) per distinct line with a word."""
    text = F.coalesce("text", F.lit(""))
    real = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    norm = lambda x: F.lower(F.trim(F.regexp_replace(x, WORD_GAP, " ")))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), F.xxhash64(text).alias("th"), F.length(text).alias("chars"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(real, lambda a: F.struct((F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"), F.transform(a, lambda x: F.struct(F.xxhash64(norm(x)).alias("h"), F.length(x).alias("c"))).alias("lines"))).alias("l"),
    )
    return base.select("doc_id", "host", "th", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.lines").withColumn("uid", F.monotonically_increasing_id())


def line_shares(rows: DataFrame, line_docs: int = LINE_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """(uid, hit): characters of removed lines, for rows that have any. rows: uid, host, th, lines; materialised."""
    each = rows.select("uid", "host", "th", F.aggregate("lines", F.lit(0), lambda a, x: a + x["c"]).alias("all_c"), F.explode("lines").alias("x")).select("uid", "host", "th", "all_c", F.col("x.h").alias("h"), F.col("x.c").alias("c"))
    each = each.withColumn("host", F.coalesce("host", F.lit("\u0000"))).groupBy("uid", "host", "th", "h").agg(F.sum("c").alias("c"), F.first("all_c").alias("all_c"))
    counted = lambda df: df.groupBy("host", "h", "th").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("one").alias("n_docs")).where(F.col("n_docs") > line_docs).select("host", "h")
    common = cut(salted(each, counted(each), ["host", "h"], SALTS, F.col("uid")))
    rest = common.groupBy("uid").agg((1 - F.sum("c") / F.first("all_c")).alias("rest"))
    voters = common.join(rest.where(F.col("rest") >= keep_share), "uid", "left_semi")
    return salted(common, counted(voters), ["host", "h"], SALTS, F.col("uid"))


def judged(docs: DataFrame, line_docs: int = LINE_DOCS, keep_share: float = KEEP_SHARE) -> tuple[DataFrame, DataFrame]:
    """Measures with base_failed, removed_chars, depleted and kept; and the removed (uid, h)."""
    rows = cut(measures(docs))
    removed = cut(line_shares(rows, line_docs, keep_share))
    release(docs.sparkSession)
    lost = removed.groupBy("uid").agg(F.sum("c").alias("removed_chars"), F.first("all_c").alias("line_chars"))
    out = rows.join(lost, "uid", "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = F.coalesce(F.col("line_chars") - F.col("removed_chars") < keep_share * F.col("line_chars"), F.lit(False))
    return out.withColumn("base_failed", failed).withColumn("depleted", depleted).withColumn("kept", ~failed & ~depleted), removed.select("uid", "h")


def report(docs: DataFrame) -> DataFrame:
    return judged(docs)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("removed_chars").cast("long").alias("removed_chars"))


def clean(docs: DataFrame) -> DataFrame:
    """docs without rejected rows and without removed lines; n_chars follows the text. Other columns stay, whatever their names.

    Rows meet their verdicts by (doc_id, hash of the text, host), so equal rows share one.
    """
    key, ids, hosts, hashed, gone = spare(docs, "key", "id", "host", "th", "gone")
    verdicts, removed = judged(docs)
    lines = removed.groupBy("uid").agg(F.collect_set("h").alias(gone))
    verdicts = verdicts.where("kept").join(lines, "uid", "left").groupBy(F.col("doc_id").alias(ids), F.col("host").alias(hosts), F.col("th").alias(hashed)).agg(F.first(gone).alias(gone))
    names = docs.columns
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    both = keyed.join(verdicts, F.col("doc_id").cast("long").eqNullSafe(F.col(ids)) & (F.col(key) == F.col(hashed)) & F.col("source").eqNullSafe(F.col(hosts)), "inner")
    norm = lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, WORD_GAP, " "))))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(gone, norm(x))), "\n")
    out = both.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out).select(*names)
