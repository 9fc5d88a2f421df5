"""Exact top-k BM25 search: an inverted index per shard, block-max WAND inside, an exact merge outside.

Statistics (documents, mean length, document frequency) are global, so scores do not depend on the shards; they are summed
from the indexes, so every text is read once. A shard holds a bounded number of bytes and is indexed once: the index is a
table with a row per shard. Documents of a shard are ordered by likeness (halved again and again by the direction in which
they differ most, then by which of the most frequent terms they hold), so neighbours are of one language or template, and
cut into aligned blocks; every term keeps the blocks that hold it with its largest BM25 weight in each. Queries are ordered
by likeness as well.

Terms that at most SHORT documents of a shard hold are scored at once, by lists of one length: nearly every block holds one
posting of them, so a bound would cost what it saves. Terms that more than DENSE of a block's documents and more than LEAST
of the shard's hold (at most WIDE terms) have their weights in matrices, one for each run of blocks. A block is bounded by
the most that short lists gave in it and by the block maxima of the other terms. Queries without a threshold first score the
blocks with the largest bounds in full and take the k-th best score so far. Blocks whose bound falls below the threshold are
skipped with their postings, and a matrix is multiplied only with the queries that reach it; the others are scored in full.
These products are in f32; documents that reach the threshold within the error of such sums are scored again in f64. So each
shard's k best are exact (with all ties), and shards are merged by rank. All steps run on a slab of queries at once.

Queries are taken in blocks of about QUERY_BYTES; a block is broadcast and every shard's index read once for it, so
neither documents nor indexes are shuffled again. GROUPS tasks a core share the shards; a task keeps the k best of its
shards for each query of the block, which are also the threshold for the next of them, and sends on only these.

BM25: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 1.2, b = 0.75; a query term counts as often as it occurs.
Terms are lower-cased words between ASCII white space without edge punctuation.

Cases: null text has no terms; a query or document without known terms has no results; ties go to the smaller id,
null ids last; equal rows are separate results; fewer than k matching rows give fewer results; ids keep all 64 bits.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, cut

K, K1, B = 10, 1.2, 0.75
SHARD_BYTES, QUERY_BYTES, BLOCK, LIKE, FLUSH, DENSE, LEAST, WIDE, SLAB = 8_000_000, 16_000_000, 128, 24, 400_000, 0.05, 16, 2048, 128
#: Runs of blocks in a shard, and how often its documents, and the queries of a block, are halved by likeness; by so many terms at most.
CHUNKS, HALVED, FEATURES = 256, 4, 256
#: The longest list of postings that is scored without regard to blocks.
SHORT = 128
#: Tasks a core that answer for all shards to a block of queries.
GROUPS = 4
#: Numbers in the dense matrix of a shard, and in an array over a slab of queries and all documents of a shard.
MATRIX, CELLS = 3_000_000, 320_000
STRIP = b".,;:!?\"'()[]{}<>|*#$%&=+-_/\\"


def terms(text: str) -> list[bytes]:
    return [t for w in text.lower().encode().split() if (t := w.strip(STRIP))]


class TermHashes(dict):
    """Lower-cased raw word -> hash of its term, 0 for none; remembered up to a bound. The hash 0 itself becomes 1."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        term = word.strip(STRIP)
        self[word] = h = (xxhash.xxh3_64_intdigest(term) or 1) if term else 0
        return h

    def of(self, text: str) -> np.ndarray:
        """Hashes of a text's terms, in order."""
        words = text.lower().encode().split()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return h[h != 0].view(np.int64)


def _counted(batches):
    """Document frequency of terms and, as term 0, documents and their length, from the `counts` of shards; flushed at a bounded size."""
    names, df, size, n, total = [], [], 0, 0, 0

    def flush():
        t, c = np.concatenate(names), np.concatenate(df).astype(np.int64)
        by = np.argsort(t, kind="stable")  # merges sorted runs
        t = t[by]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(t[first]), pa.array(np.add.reduceat(c[by], first)), pa.array(np.zeros(len(first), np.int64))], names=["t", "n", "len"])

    for b in batches:
        for counts in b.column("counts"):
            terms_, held, whole = (np.frombuffer(x.as_buffer(), k) for x, k in zip(counts, (np.int64, np.int32, np.int64)))
            n, total, size = n + int(whole[0]), total + int(whole[1]), size + len(terms_)
            names.append(terms_)
            df.append(held)
            if size > 10 * FLUSH:
                yield flush()
                names, df, size = [], [], 0
    if size:
        yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["t", "n", "len"])


def _query_terms(batches):
    hashes = TermHashes()
    for b in batches:
        for q, text in zip(b.column("query_id").to_pylist(), b.column("text").to_pylist()):
            t, n = np.unique(hashes.of(text or ""), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(t), pa.int64()), pa.array(t), pa.array(n.astype(np.int64))], names=["query_id", "t", "qtf"])


def alike(term: np.ndarray, sizes: np.ndarray, n_terms: int) -> np.ndarray:
    """A number for each text of sizes[i] different terms: texts with near numbers hold the same of the most frequent ones.

    Texts are halved, and the halves again, by the direction in which they differ most, so texts of one language or template
    come together.
    """
    n = len(sizes)
    top = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[: min(FEATURES, max(8, 4_000_000 // max(n, 1)))]
    column = np.full(n_terms, -1)
    column[top] = np.arange(len(top))
    column = column[term]
    held = np.zeros((n, len(top)), np.float32)
    held[np.repeat(np.arange(n), sizes)[column >= 0], column[column >= 0]] = 1
    held /= np.maximum(np.sqrt(held.sum(1, keepdims=True)), 1)
    part = np.zeros(n, np.int64)
    for _ in range(HALVED):
        part *= 2
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            x = held[mine] - held[mine].mean(0)
            v = x[np.argmax((x * x).sum(1))]
            for _ in range(12):
                v = (x @ v) @ x
                v /= max(float(np.sqrt(v @ v)), 1e-30)
            part[mine] += x @ v > 0
    return part


def _indexed(_mean_length: float | None, block: int):
    """A row for each shard: its index as arrays of bytes, and its terms with their document frequencies, documents and length.

    The mean length is not needed before the index is opened, so texts are read once, for index and statistics.
    """

    def apply(key, shard):
        hashes, parts, counts = TermHashes(), [], []
        for text in shard.column("text"):
            t, c = np.unique(hashes.of(text.as_py() or ""), return_counts=True)
            parts.append(t)
            counts.append(c)
        sizes = np.array([len(p) for p in parts], np.int64)
        names, term = np.unique(np.concatenate(parts), return_inverse=True)
        # alike documents become neighbours: order by the most frequent terms that they hold
        top = np.argsort(-np.bincount(term, minlength=len(names)), kind="stable")[:LIKE]
        bit = np.zeros(len(names), np.int64)
        bit[top] = 1 << np.arange(len(top))[::-1]
        start = np.concatenate([[0], sizes.cumsum()])
        like = np.array([bit[term[a:b]].sum() for a, b in zip(start, start[1:])], np.int64)
        order = np.lexsort((like, alike(term, sizes, len(names))))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, tf, lengths = np.repeat(place, sizes), np.concatenate(counts), np.array([counts[i].sum() for i in order], np.int32)
        # postings by term, then by block: an entry is the run of postings of one term in one block
        blocks = len(order) // block + 1
        cell = term.astype(np.int64) * blocks + doc // block
        by = np.argsort(cell, kind="stable")
        doc, tf, cell = doc[by].astype(np.int32), tf[by].astype(np.int32), cell[by]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        held = cell[first]
        ids = shard.column("doc_id").combine_chunks().take(pa.array(order))
        arrays = [names, np.searchsorted(held // blocks, np.arange(len(names) + 1)), np.append(first, len(doc)), doc, tf, lengths, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids.is_valid())]
        arrays = [x.astype(k) for x, k in zip(arrays, KINDS)]
        df = np.bincount(term, minlength=len(names)).astype(np.int32)
        told = [arrays[0], df, np.array([len(lengths), lengths.sum()], np.int64)]
        as_bytes = lambda parts: pa.array([[x.tobytes() for x in parts]], pa.list_(pa.binary()))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "parts": as_bytes(arrays), "counts": as_bytes(told)})

    return apply


#: A shard holds SHARD_BYTES of text, so positions of its postings fit 32 bits.
KINDS = (np.int64, np.int32, np.int32, np.int32, np.int32, np.int32, np.int64, np.bool_)


def weights(tf, lengths, mean_length: float) -> np.ndarray:
    """BM25 weight of postings."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / mean_length))


@dataclass(frozen=True)
class Block:
    """Queries: hashes of all their terms, sorted; and for each query, from start[i] to start[i + 1], its terms among them and their weights."""

    start: np.ndarray
    names: np.ndarray
    term: np.ndarray
    w: np.ndarray
    cut: dict = field(default_factory=dict)

    @staticmethod
    def of(lengths, terms_: np.ndarray, w: np.ndarray) -> Block:
        names, at = np.unique(terms_, return_inverse=True)
        return Block(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), names, at.astype(np.int32), w)

    @property
    def n(self) -> int:
        return len(self.start) - 1

    def slabs(self, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each `size` queries the query, the term and the weight of their terms, by term: equal lists of postings are then read together."""
        if size not in self.cut:
            self.cut.clear()
            self.cut[size] = out = []
            for at in range(0, self.n, size):
                start = self.start[at : at + size + 1]
                by = np.argsort(self.term[start[0] : start[-1]], kind="stable")
                out.append((np.repeat(np.arange(len(start) - 1), np.diff(start))[by], self.term[start[0] : start[-1]][by], self.w[start[0] : start[-1]][by]))
        return self.cut[size]


class Index:
    """Index of one shard: per term its entries (block, largest weight), per entry its postings (document, weight)."""

    def __init__(self, parts: list[bytes], mean_length: float, block: int = BLOCK):
        self.names, self.term_start, self.entry_start, self.docs, tf, lengths, self.ids, self.known = (np.frombuffer(p, k) for p, k in zip(parts, KINDS))
        self.block, self.n_docs = block, len(lengths)
        self.block_of = self.docs[self.entry_start[:-1]] // block
        self.n_blocks = self.n_docs // block + 1
        self.weight = weights(tf, lengths[self.docs], mean_length)
        self.block_max = np.maximum.reduceat(self.weight, self.entry_start[:-1]) if len(self.docs) else np.zeros(0)
        self.df = self.entry_start[self.term_start[1:]] - self.entry_start[self.term_start[:-1]]
        #: Row in the chunks' matrices of each wide term, -1 for terms that keep their blocks.
        self.row = np.full(len(self.names), -1, np.int32)
        self.wide = self._wide()
        self.row[self.wide] = np.arange(len(self.wide))
        self._chunks()
        #: Postings of queries' terms that were scored, and that lay in skipped blocks.
        self.read = self.skipped = 0

    def _wide(self) -> np.ndarray:
        """Terms that many documents of some block hold."""
        if not len(self.names):
            return np.zeros(0, np.int64)
        most = np.maximum.reduceat(np.diff(self.entry_start), self.term_start[:-1])
        wide = np.flatnonzero((most > DENSE * self.block) & (self.df > LEAST))
        return np.sort(wide[np.argsort(-self.df[wide], kind="stable")[: min(WIDE, MATRIX // (self.n_blocks * self.block))]])

    def _chunks(self) -> None:
        """For each run of blocks the wide terms that occur in it and their weights in its documents; and for all wide terms, by block, the largest weight."""
        self.per = -(-self.n_blocks // CHUNKS)
        n, width = -(-self.n_blocks // self.per), self.per * self.block
        at, k = self._positions(self.entry_start[self.term_start], self.wide)
        row, docs = np.repeat(np.arange(len(self.wide)), k), self.docs[at]
        chunk = docs // width
        #: Postings of a wide term in a chunk.
        self.held = np.bincount(row * n + chunk, minlength=len(self.wide) * n).reshape(-1, n)
        self.highest = np.zeros((len(self.wide), self.n_blocks))
        entries, k = self._positions(self.term_start, self.wide)
        np.maximum.at(self.highest, (np.repeat(np.arange(len(self.wide)), k), self.block_of[entries]), self.block_max[entries])
        self.rows, self.matrices = [np.flatnonzero(h) for h in self.held.T], []
        by = np.argsort(chunk, kind="stable")
        ends = np.searchsorted(chunk[by], np.arange(n + 1))
        for i, rows in enumerate(self.rows):
            mine = by[ends[i] : ends[i + 1]]
            m = np.zeros((len(rows), min(width, self.n_blocks * self.block - i * width)))
            m[np.searchsorted(rows, row[mine]), docs[mine] - i * width] = self.weight[at[mine]]
            self.matrices.append((m.astype(np.float32), m))

    @staticmethod
    def _positions(start, ids):
        """All positions from start[i] to start[i + 1] for some i, and how many there are for each."""
        n = start[ids + 1] - start[ids]
        return np.repeat(start[ids] - n.cumsum() + n, n) + np.arange(n.sum()), n

    def known_terms(self, names: np.ndarray) -> np.ndarray:
        """Term of the shard for each of sorted hashes of terms, -1 for none."""
        if not len(self.names):
            return np.full(len(names), -1)
        ids = np.searchsorted(self.names, names)
        return np.where(self.names[np.minimum(ids, len(self.names) - 1)] == names, ids, -1)

    def answers(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: list[float] | None = None):
        """For each query (hashes of terms, weights) its k best (id, score), ties by id, null ids last; those that cannot
        reach `least` may be left out."""
        if queries:
            yield from self.answers_to(Block.of([len(t) for t, _ in queries], *(np.concatenate(x) for x in zip(*queries))), k, least)

    def answers_to(self, queries: Block, k: int, least: list[float] | None = None):
        """The same for a block of queries. A slab of them is answered at once; best if queries that are alike come together."""
        slab, ids = max(1, min(SLAB, CELLS // (self.n_blocks * self.block))), self.known_terms(queries.names)
        for at, (of, term, w) in zip(range(0, queries.n, slab), queries.slabs(slab)):
            n, mine = min(slab, queries.n - at), ids[term]
            real = np.flatnonzero(mine >= 0)
            yield from self._slab(n, of[real], mine[real], w[real], k, np.array(least[at : at + slab]) if least else np.zeros(n))

    def _short(self, n_queries: int, of: np.ndarray, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What terms that few documents hold give to each document: all postings, by lists of one length."""
        width, n = self.n_blocks * self.block, self.df[ids]
        if not len(ids):
            return np.zeros((n_queries, width))
        by = np.argsort(n.astype(np.int16), kind="stable")
        n, first, base, w = n[by], self.entry_start[self.term_start[ids[by]]].astype(np.int64), of[by] * width, w[by]
        cells, parts, at = np.empty(n.sum(), np.int64), np.empty(n.sum()), 0
        cuts = np.searchsorted(n, np.arange(SHORT + 2))
        for k in range(1, SHORT + 1):
            lo, hi = cuts[k], cuts[k + 1]
            if lo < hi:
                where = first[lo:hi, None] + np.arange(k)
                end = at + where.size
                np.add(self.docs[where], base[lo:hi, None], out=cells[at:end].reshape(-1, k))
                np.multiply(self.weight[where], w[lo:hi, None], out=parts[at:end].reshape(-1, k))
                at = end
        return np.bincount(cells, parts, n_queries * width).reshape(n_queries, width)

    def _slab(self, n_queries: int, of: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int, least: np.ndarray) -> list[list[tuple[int | None, float]]]:
        """Terms `ids` with weights w belong to queries `of`. Terms with short lists are scored at once. Queries without a
        threshold then score the documents of their best blocks by bound and take the k-th best; of the others, all blocks
        that reach the threshold are scored. What wide terms give is first taken in f32; documents that reach the threshold
        by that get it in f64."""
        width, per = self.n_blocks * self.block, self.per * self.block
        row, n = self.row[ids], self.df[ids]
        common = row >= 0
        short = ~common & (n <= SHORT)
        asked = np.zeros((n_queries, len(self.wide)))
        asked[of[common], row[common]] = w[common]
        rough = np.ascontiguousarray(asked.T, np.float32)
        held, seen = int(n.sum()), int(n[short].sum())
        exact = self._short(n_queries, of[short], ids[short], w[short])
        bound = asked @ self.highest + exact.reshape(n_queries, self.n_blocks, self.block).max(2)
        long = ~common & ~short
        if any_long := bool(long.any()):
            entries, n = self._positions(self.term_start, ids[long])
            of, w = np.repeat(of[long], n), np.repeat(w[long], n)
            cell = of * self.n_blocks + self.block_of[entries]
            bound += np.bincount(cell, self.block_max[entries] * w, bound.size).reshape(bound.shape)
        # sums of f32 are off by less than this
        slack = (len(self.wide) + 8) * 2.0**-24 * bound.max(1)
        score, done = [], np.zeros((n_queries, len(self.rows)), bool)  # chunk, queries, f32 sums of wide terms
        postings = (asked != 0) @ self.held.astype(np.float64)

        def scored(chosen):
            """Scores the documents of chosen blocks, wide terms for whole chunks; the number of postings."""
            number = 0
            if any_long and len(open_ := np.flatnonzero(chosen.reshape(-1)[cell])):
                where, n = self._positions(self.entry_start, entries[open_])
                flat = exact.reshape(-1)
                flat += np.bincount(np.repeat(of[open_] * width, n) + self.docs[where], self.weight[where] * np.repeat(w[open_], n), len(flat))
                number = len(where)
            todo = np.logical_or.reduceat(chosen, np.arange(0, self.n_blocks, self.per), axis=1) & ~done
            done[todo] = True
            for i in np.flatnonzero(todo.any(0)):
                mine = np.flatnonzero(todo[:, i])
                terms_ = rough[self.rows[i]]
                score.append((i, mine, (terms_ if len(mine) == n_queries else terms_[:, mine]).T @ self.matrices[i][0]))
            return number + int(postings[todo].sum())

        def sums(i, mine, x):
            return x + (exact[:, i * per : (i + 1) * per] if len(mine) == n_queries else exact[mine, i * per : (i + 1) * per])

        def raise_():
            """New queries get the k-th best of the documents scored so far as their threshold."""
            if len(new) and width >= k:
                have = np.zeros((n_queries, width))
                for i, mine, x in score:
                    have[mine, i * per : (i + 1) * per] = sums(i, mine, x)
                least[new] = np.maximum(np.partition(have[new], -k, axis=1)[:, -k] - slack[new], 0)

        reach = lambda: (bound > 0) & (bound >= (least - slack)[:, None])
        first, new = np.zeros(bound.shape, bool), np.flatnonzero(least <= 0)
        if len(new):
            step = min(self.n_blocks, max(1, 8 * k // self.block))
            first[new[:, None], np.argpartition(-bound[new], step - 1, axis=1)[:, :step]] = True
            first &= reach()
            seen += scored(first)
            raise_()
        seen += scored(reach() & ~first)
        raise_()
        self.read += seen
        self.skipped += held - seen
        found, floor = [], np.maximum(least - slack, 0)[:, None]
        for i, mine, x in score:
            query, docs = np.nonzero(sums(i, mine, x) > floor[mine])
            for j in range(0, len(query), 256):
                q, at = mine[query[j : j + 256]], docs[j : j + 256]
                part = np.einsum("ij,ij->i", asked[np.ix_(q, self.rows[i])], self.matrices[i][1][:, at].T)
                found.append((q, at + i * per, exact[q, at + i * per] + part))
        query, docs, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        score = np.round(score, 9)
        by = np.lexsort((self.ids[docs], ~self.known[docs], -score, query))
        query, docs, score = query[by], docs[by], score[by]
        start = np.searchsorted(query, np.arange(n_queries + 1))
        found = [(i if real else None, x) for i, real, x in zip(self.ids[docs].tolist(), self.known[docs].tolist(), score.tolist())]
        return [found[lo : min(hi, lo + k)] for lo, hi in zip(start[:-1].tolist(), start[1:].tolist())]


def _answered(block, mean_length: float, k: int):
    """Rows of the index table: the best answers of their shards together to a broadcast block of queries."""

    def apply(batches):
        ids, asked = block.value
        best: list[list[tuple[int | None, float]]] = [[] for _ in ids]  # of each query in the shards seen so far
        for b in batches:
            for parts in b.column("parts"):
                # scores are rounded to 9 digits, so a bound from another shard gets that much room
                least = [r[-1][1] - 1e-8 if len(r) >= k else 0.0 for r in best]
                for i, got in enumerate(Index([p.as_buffer() for p in parts], mean_length).answers_to(asked, k, least)):
                    if got:
                        best[i] = sorted(best[i] + got, key=lambda r: (-r[1], r[0] is None, r[0]))[:k] if best[i] else got
        q, d, s = zip(*[(q, d, s) for q, r in zip(ids.tolist(), best) for d, s in r]) if any(best) else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=["query", "doc_id", "score"])

    return apply


def search(docs: DataFrame, queries: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, doc_id, score: the k best rows of docs (doc_id, text) for each row of queries (query_id, text).

    Rows of queries with one id are one query, of all their texts; null is an id like others.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with Stash(spark) as stash:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, math.ceil(size / shard_bytes))
        placed = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")).repartition(shards, "shard")
        index = stash.put(placed.groupBy("shard").applyInArrow(_indexed(None, BLOCK), "shard int, parts array<binary>, counts array<binary>"), maxRecordsPerFile=1)
        stats = stash.put(index.select("counts").coalesce(math.ceil(shards / 8)).mapInArrow(_counted, "t long, n long, len long").groupBy("t").agg(F.sum("n").alias("df"), F.sum("len").alias("len")))
        whole = stats.where("t = 0").first()
        n, length = (whole.df, whole.len) if whole else (0, 0)
        mean = max(1e-9, length / max(n, 1))
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "text").mapInArrow(_query_terms, "query_id long, t long, qtf long")
        idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms_ = asked.join(stats.where("t <> 0").select("t", "df"), "t").groupBy("query_id", "t").agg((F.sum("qtf") * F.first(idf)).alias("w"))
        rows = stash.put(terms_.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("x")).withColumn("query", F.monotonically_increasing_id()))
        # a task answers for several shards and sends on k rows a query, so those rows do not grow with queries times shards
        groups = max(1, min(shards, GROUPS * spark.sparkContext.defaultParallelism))
        total = rows.agg(F.sum(16 * F.size("x"))).first()[0] or 0
        blocks, parts = max(1, math.ceil(total / query_bytes)), []
        for i in range(blocks):
            got = rows.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).select("query", F.col("x.t").alias("t"), F.col("x.w").alias("w")).toArrow()
            flat = lambda c, kind: np.asarray(got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), kind) if got.num_rows else np.zeros(0, kind)  # noqa: E731, B023
            lengths = np.array([len(x) for x in got.column("t")], np.int64)
            at = np.unique(flat("t", np.int64), return_inverse=True)[1]
            got = got.take(pa.array(np.argsort(alike(at, lengths, at.max(initial=0) + 1), kind="stable")))
            lengths = np.array([len(x) for x in got.column("t")], np.int64)
            block = spark.sparkContext.broadcast((got.column("query").to_numpy(), Block.of(lengths, flat("t", np.int64), flat("w", np.float64))))
            parts.append(stash.put(index.select("parts").coalesce(groups).mapInArrow(_answered(block, mean, k), "query long, doc_id long, score double")))
            block.destroy()
        best = parts[0]
        for p in parts[1:]:
            best = best.unionByName(p)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return cut(best.join(rows.select("query", "query_id"), "query").select("query_id", "rank", "doc_id", "score"))


def report(docs: DataFrame) -> DataFrame:
    """Every document whose id divides by 100 is a query, by its whole text, against all documents."""
    return search(docs, docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"))
