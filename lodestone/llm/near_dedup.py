"""Near-duplicates: DartMinHash signatures, banded candidates, exact verification, connected classes.

Signature. Every shingle is a region of the plane with its weight as width. Darts fall as a Poisson process driven by
hashes of the shingle: dart after dart has a rank (height) and a coordinate in 0..k-1; only ranks below a threshold of
about (k ln k + 2k) / total weight are thrown, so a text costs about that many darts however long it is. The lowest
rank per coordinate is kept; coordinates that stayed empty are thrown again at twice the height. Two texts agree in a
coordinate with probability equal to their weighted Jaccard similarity. Weights are
how often a text holds a shingle ("count", Jaccard of multisets) or 1 ("binary", plain Jaccard).

Candidates. Equal texts are first reduced to one. k coordinates form bands of `rows`; texts that share a band meet in
a bucket. No bucket emits its pairs: each member is paired with two pivots, the member whose bands are the most
crowded (the centre of a group of copies) and one drawn by hash. Pairs are verified on whole shingle sets and verified
pairs joined to components. Members of buckets that still hold several components are then compared exactly, block
against block inside tasks (a pair in the first band it shares, and only across components), so no similar pair that
shares a band is left out.

Result: class of each row = smallest id of its component. At similarity 0.8 a pair shares a band with probability
1 - (1 - 0.8^rows)^bands = 0.99995 for 25 bands of 5.

Cases: words are separated by ASCII white space; texts of 1 to 4 words are one shingle; texts without words (null,
empty, blank) are duplicates of equal texts only, null counting as empty; equal rows get equal results; the class of
rows without ids is null where no member has one; ties go to the smaller node.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, cut, spare, spread
from .components import components, renamed

#: Odd factors of the words of a shingle.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
WORDS, SIMILARITY, BANDS, ROWS, GROUP, BLOCK = 5, 0.8, 25, 5, 256, 512


def mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finaliser, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Hash of every run of n words, in order."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        return mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64))
    size = len(h) - n + 1
    out = h[:size] * FACTORS[0]
    for i in range(1, n):
        out += h[i : size + i] * FACTORS[i % len(FACTORS)] + np.uint64(i)
    return mix(out)


def units(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Regions cut into strips of unit width: strip w of an element is there if its weight exceeds w; strip 0 is the element."""
    weights = weights.astype(np.int64)
    if not len(elements) or weights.max() == 1:
        return elements
    nth = np.arange(weights.sum()) - np.repeat(weights.cumsum() - weights, weights)
    out = np.repeat(elements, weights)
    more = nth > 0
    out[more] = mix(out[more] + nth[more].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart (as a hash) of each of k coordinates."""
    strips = units(elements, weights)
    height = (k * np.log(k) + 2 * k) / len(strips)
    while True:
        ranks, darts = [], []
        key, base, n = strips, np.zeros(len(strips)), 0
        width = 1 if height < 0.1 else int(np.ceil(height + 3 * np.sqrt(height)))
        while len(key):
            # `width` darts of every strip at once; strips whose last one is still below the height throw more
            step = np.arange(n, n + width, dtype=np.uint64)
            rank = base[:, None] - np.log(unit(mix(key[:, None] + (step * np.uint64(2) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)))).cumsum(axis=1)
            i, j = np.nonzero(rank <= height)
            ranks.append(rank[i, j])
            darts.append(mix(key[i] ^ ((step[j] * np.uint64(2) + np.uint64(2)) * np.uint64(0xA24BAED4963EE407))))
            more = rank[:, -1] <= height
            key, base, n = key[more], rank[more, -1], n + width
        rank, dart = np.concatenate(ranks), np.concatenate(darts)
        dart = dart[np.argsort(-rank, kind="stable")]
        at = (dart % np.uint64(k)).astype(np.int64)
        sig, hit = np.zeros(k, np.uint64), np.zeros(k, bool)
        sig[at] = dart  # written from the latest to the earliest
        hit[at] = True
        if hit.all():
            return sig
        height *= 2


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for part in sig.reshape(bands, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out.view(np.int64)


def _signed(bands: int, rows: int, words: int, weighting: str):
    def apply(batches):
        hashes = WordHashes()
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                s = shingles(text or "", hashes, words)
                if len(s):
                    e, c = np.unique(s, return_counts=True) if weighting == "count" else (np.unique(s), np.ones(1))
                    out.append(bands_of(signature(e, c, bands * rows), bands, rows))
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("t1"), b.column("t2"), pa.array(out, pa.list_(pa.int64()))], names=["id", "t1", "t2", "bands"])

    return apply


def similarity(a, b, weighting: str = "binary") -> float:
    """Weighted Jaccard of two (elements, counts)."""
    (ea, ca), (eb, cb) = a, b
    if min(len(ea), len(eb)) == 0:
        return 0.0
    if weighting != "count":
        both = len(ea) + len(eb) - len(np.union1d(ea, eb))
        return both / (len(ea) + len(eb) - both)
    _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    both = np.minimum(ca[ia], cb[ib]).sum()
    return float(both / (ca.sum() + cb.sum() - both))


def _verify(words: int, least: float, weighting: str):
    """Rows come sorted: a pivot's text, then those of its members. One pivot's set is held at a time."""

    def apply(batches):
        hashes, held, pivot = WordHashes(), None, None
        for b in batches:
            keep = []
            for i, (p, member, text) in enumerate(zip(b.column("p").to_pylist(), b.column("m").to_pylist(), b.column("text").to_pylist())):
                s = shingles(text or "", hashes, words)
                s = np.unique(s, return_counts=True) if weighting == "count" else (np.unique(s), None)
                if member == -1:
                    held, pivot = s, p
                elif pivot == p and similarity(held, s, weighting) >= least - 1e-12:
                    keep.append(i)
            got = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column("p"), got.column("id_m")], names=["a", "b"])

    return apply


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float, weighting: str) -> DataFrame:
    """(a, b): the pairs (p, m) whose whole texts are similar enough. A pivot's members go to groups of about GROUP."""
    sized = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int"))
    members = spread(pairs, sized, ["p"], pairs.count(), F.col("m")).withColumn("s", F.pmod(F.xxhash64("m"), "parts").cast("int"))
    pivots = sized.join(texts.withColumnRenamed("id", "p"), "p").select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"), "text")
    left = pivots.select("p", "s", F.lit(-1).cast("long").alias("m"), F.lit(None).cast("long").alias("id_m"), "text")
    right = members.join(texts.withColumnRenamed("id", "m"), "m").select("p", "s", F.lit(0).cast("long").alias("m"), F.col("m").alias("id_m"), "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.unionByName(right).repartition(n, "p", "s").sortWithinPartitions("p", "s", "m").mapInArrow(_verify(words, least, weighting), "a long, b long")


def signed_rows(docs: DataFrame, words: int, bands: int, rows: int, weighting: str) -> tuple[DataFrame, DataFrame]:
    """(id, text, t1, t2) of every row, and (id, t1, t2, bands): two hashes name a text."""
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})
    return source, source.mapInArrow(_signed(bands, rows, words, weighting), "id long, t1 long, t2 long, bands array<long>")


def distinct_texts(signed: DataFrame) -> DataFrame:
    """(node, t1, t2, least, bands): one node per distinct text with its least id. Copies cost a row per task."""
    return signed.groupBy("t1", "t2").agg(F.min("id").alias("least"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id())


def candidates(stash: Stash, nodes: DataFrame) -> DataFrame:
    """(key, node, p1, p2): members of buckets of two texts or more, with both pivots of the bucket.

    A band's key holds the number of the band, so keys of different bands never meet.
    """
    one = nodes.select("node", F.explode("bands").alias("key"))
    crowded = one.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stash.put(one.join(crowded, "key"))
    mass = members.groupBy("node").agg(F.sum(F.log2("n")).alias("mass"))
    central, drawn = F.struct(-F.col("mass"), F.col("node")), F.struct(F.xxhash64("node"), F.col("node"))
    pivots = members.join(mass, "node").groupBy("key").agg(F.min_by("node", central).alias("p1"), F.min_by("node", drawn).alias("p2"), F.first("n").alias("n"))
    met = stash.put(spread(members.select("key", "node"), pivots, ["key"], members.count(), F.col("node")))
    stash.drop(members)
    return met


def pivot_pairs(met: DataFrame) -> DataFrame:
    """(p, m) once per unordered pair of a pivot p and a member m."""
    each = met.select(F.explode(F.array("p1", "p2")).alias("p"), F.col("node").alias("m")).where("p <> m")
    first = each.groupBy(F.least("p", "m").alias("x"), F.greatest("p", "m").alias("y")).agg(F.max(F.col("p") < F.col("m")).alias("first"))
    return first.select(F.when(F.col("first"), F.col("x")).otherwise(F.col("y")).alias("p"), F.when(F.col("first"), F.col("y")).otherwise(F.col("x")).alias("m"))


def unsettled(met: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """(key, node, root, g, slot, slots): members of buckets that hold several components beyond the pivots' own pairs.

    Both pivots of a bucket met all its members, so only the other members can hold untried pairs. A component with
    `block` members in the bucket or more forms a group g of its own, the smaller ones share group -1; groups fall into
    slots of about `block` members.
    """
    rest = met.where("node <> p1 AND node <> p2").join(roots.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    parts = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    small = F.col("c") < block
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(small, F.col("c")).otherwise(0)).alias("few")).where("k > 1")
    parts = parts.join(mixed, "key").select("key", "root", F.when(small, -1).otherwise(F.col("root")).alias("g"), F.ceil(F.when(small, F.col("few")).otherwise(F.col("c")) / block).cast("int").alias("slots"))
    return rest.join(parts, ["key", "root"]).withColumn("slot", F.pmod(F.xxhash64("node"), "slots").cast("int"))


def _settle(words: int, least: float, weighting: str):
    """Rows come sorted by pair of blocks: the members of one are held as an inverted index, those of the other stream by.

    Emits edges between roots of different components, and of those only the ones that join something new.
    """

    def apply(batches):
        hashes, group, held, up = WordHashes(), None, [], {}
        index = None

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        def compare(node, root, bands, e, key, alone):
            """Links of one text to the held ones; alone: the block meets itself, so only earlier members count."""
            post, at, start, sizes, all_bands = index
            same = all_bands == bands
            first = same.argmax(1)
            # a pair is compared in the first band that it shares
            ok = same.any(1) & (bands[first] == key) & (np.minimum(sizes, len(e)) >= least * np.maximum(sizes, len(e)) - 1e-9)
            if alone:
                ok &= np.array([h[0] < node for h in held])
            mine = top(root)
            ok &= np.array([top(h[1]) != mine for h in held])
            if not ok.any():
                return
            lo = np.searchsorted(post, e)
            hit = lo[(lo < len(post)) & (post[np.minimum(lo, len(post) - 1)] == e)] if len(post) else lo[:0]
            n = start[hit + 1] - start[hit]
            where = np.repeat(start[hit] - n.cumsum() + n, n) + np.arange(n.sum())
            both = np.bincount(at[where], minlength=len(held))
            for i in np.flatnonzero(ok & (both > 0) & (both >= least * (sizes + len(e) - both) - 1e-9)):
                r = top(held[i][1])
                if r != top(root):
                    links.append((held[i][1], root))
                    up[max(r, top(root))] = min(r, top(root))

        def indexed():
            e = np.concatenate([h[3] for h in held])
            d = np.repeat(np.arange(len(held)), [len(h[3]) for h in held])
            order = np.argsort(e, kind="stable")
            post, start = np.unique(e[order], return_index=True)
            return post, d[order], np.append(start, len(e)), np.array([len(h[3]) for h in held]), np.stack([h[2] for h in held])

        for b in batches:
            links = []
            columns = [b.column(c).to_pylist() for c in ("key", "ga", "i", "gb", "j", "side", "node", "root", "bands", "text")]
            for key, ga, i, gb, j, side, node, root, bands, text in zip(*columns):
                if group != (key, ga, i, gb, j):
                    if index is None and held:
                        index = indexed()
                        for h in held:
                            compare(*h, group[0], True)
                    group, held, index, up = (key, ga, i, gb, j), [], None, {}
                e, c = np.unique(shingles(text or "", hashes, words), return_counts=True)
                e, bands = units(e, c) if weighting == "count" else e, np.array(bands, np.int64)
                if side == 0:
                    held.append((node, root, bands, e))
                elif held:
                    index = index or indexed()
                    compare(node, root, bands, e, key, False)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        links = []
        if index is None and held:
            index = indexed()
            for h in held:
                compare(*h, group[0], True)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return apply


def crossing(members: DataFrame, texts: DataFrame, words: int, least: float, weighting: str) -> DataFrame:
    """(a, b): edges between the components of similar members of a bucket that no pivot has settled. Exact.

    Blocks of members are compared pairwise inside tasks; blocks of one and the same component are not. Only links
    leave a task, never pairs.
    """
    groups = members.select("key", "g", "slots").distinct()
    other = groups.select("key", F.col("g").alias("gb"), F.col("slots").alias("sb"))
    blocks = groups.withColumnsRenamed({"g": "ga", "slots": "sa"}).join(other, "key").where("ga < gb OR ga = -1 AND gb = -1")
    blocks = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sa") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("sb") - 1))).where("ga <> gb OR i <= j").select("key", "ga", "i", "gb", "j")
    one, two = F.struct("ga", "i", F.lit(0).alias("side")), F.struct(F.col("gb").alias("ga"), F.col("j").alias("i"), F.lit(1).alias("side"))
    sides = F.when((F.col("ga") == F.col("gb")) & (F.col("i") == F.col("j")), F.array(one)).otherwise(F.array(one, two))
    ends = blocks.withColumn("end", F.explode(sides)).select("key", "ga", "i", "gb", "j", F.col("end.ga").alias("g"), F.col("end.i").alias("slot"), F.col("end.side").alias("side"))
    rows = members.select("key", "node", "root", "g", "slot").join(ends, ["key", "g", "slot"]).join(texts.select(F.col("id").alias("node"), "bands", "text"), "node")
    order = ["key", "ga", "i", "gb", "j"]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *order).sortWithinPartitions(*order, "side", "node").select(*order, "side", "node", "root", "bands", "text").mapInArrow(_settle(words, least, weighting), "a long, b long")


def linked(stash: Stash, source: DataFrame, nodes: DataFrame, words: int, least: float, weighting: str, block: int = BLOCK) -> DataFrame:
    """(id, root) of nodes that are similar to another one: components of all similar pairs that share a band."""
    met = candidates(stash, nodes)
    involved = met.select("node").distinct().join(nodes.select("node", "t1", "t2", "bands"), "node")
    texts = stash.put(source.join(involved, ["t1", "t2"]).dropDuplicates(["node"]).select(F.col("node").alias("id"), "bands", "text"))
    pairs = stash.put(pivot_pairs(met))
    roots = components(stash, verified(pairs, texts.select("id", "text"), words, least, weighting))
    members = stash.put(unsettled(met, roots, block))
    stash.drop(met, pairs)
    upper = components(stash, crossing(members, texts, words, least, weighting))
    # nodes without a link so far enter as their own root
    alone = upper.join(roots, "id", "left_anti").select("id", F.col("id").alias("root"))
    return renamed(stash.put(roots.unionByName(alone)), upper)


def classes(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighting: str = "count") -> DataFrame:
    """doc_id, class_id for every row of docs, with the hashes t1, t2 of its text."""
    with Stash(docs.sparkSession) as stash:
        source, signed = signed_rows(docs, words, bands, rows, weighting)
        signed = stash.put(signed)
        nodes = stash.put(distinct_texts(signed))
        roots = linked(stash, source, nodes, words, least, weighting).withColumnRenamed("id", "node")
        named = stash.put(nodes.select("node", "t1", "t2", "least", F.col("n").alias("copies")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        class_of = named.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n"))
        named = spread(named, class_of, ["root"], named.count(), F.col("node")).select("t1", "t2", "class_id", F.col("copies").alias("n"))
        rows = signed.select("id", "t1", "t2")
        return cut(spread(rows, named, ["t1", "t2"], rows.count(), F.col("id")).select(F.col("id").alias("doc_id"), "class_id", "t1", "t2"))


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class: that of the class id; of rows equal in id and class one, settled by their text's hash.

    Rows without an id stay only where their whole class has none. Columns of docs may have any names.
    """
    h1, h2, key, k1, k2 = spare(docs, "h1", "h2", "key", "k1", "k2")
    kept = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min(F.struct("t1", "t2")).alias("t"))
    kept = kept.select(F.col("class_id").alias(key), F.col("t.t1").alias(k1), F.col("t.t2").alias(k2))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({h1: F.xxhash64(text), h2: F.xxhash64(F.lit(7), text)})
    out = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(h1) == F.col(k1)) & (F.col(h2) == F.col(k2)), "left_semi")
    return out.dropDuplicates(["doc_id", h1, h2]).select(*docs.columns)
