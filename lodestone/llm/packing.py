"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule.

Documents become ids, an end id is added, and only what exceeds the capacity is cut (the remainder comes first).
Full pieces fill a sequence alone. For the rest, N(g) counts open sequences with g free places; a piece of length s
goes where sum over g of N(g)^2 becomes smallest; a new sequence opens only where no open one has room, and the longest
pieces go first. With new sequences among the places that compete by the sum (the rule read literally) sf0.1 took 4,511
sequences, this way 4,465, and 4,464 is the least that its ids allow. Only (key, length) pairs are packed: one pass over
the texts makes them, they are materialised, and tasks of about `per_task` pieces pack apart, each with a table of
`capacity` counters. Sequences whose waste exceeds `reopen` of the capacity are taken apart and packed again with those
of other tasks, so that what tasks leave open does not add up. That goes on until one task holds what is open, or until
a turn leaves more than SHRINK of its pieces open; then the next turn closes all its sequences.

Ids are those of the tokenizers library called with add_special_tokens=False, so the strings of added tokens in a text
become their ids. Where the file is a plain byte-level BPE a rank encoder makes the same ids several times faster.

Cases: null text counts as empty and packs as its end id; equal rows are separate documents; ids may be null.
"""
from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_chars
from .chunked import per_process, slices
from .common import cut

CAPACITY, END_ID, PER_TASK, REOPEN, SHRINK = 1024, 2, 120_000, 0.02, 0.9


#: What a tokenizers file must say, besides ids in the order of merges, for a rank encoder to give its ids.
PLAIN = {"truncation": None, "padding": None, "normalizer": None, "post_processor": None}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def rank_encoder(path: str):
    """A rank encoder that gives the ids of a tokenizers file, added tokens included, or None where it might not."""
    import public_tokenizers
    import tiktoken

    with open(path) as f:
        config = json.load(f)
    model = config["model"]
    says = lambda part, plain: part is not None and all(part.get(k, v) == v for k, v in plain.items())
    if not (says(config, PLAIN) and says(model, PLAIN_MODEL) and says(config["pre_tokenizer"], PLAIN_SPLIT) and all(says(t, PLAIN_ADDED) for t in config["added_tokens"])):
        return None
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    chars = byte_chars()
    inverse = {c: b for b, c in enumerate(chars)}
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or sorted(map(vocab.get, chars)) != list(range(256)):
        return None
    ranks = {bytes(map(inverse.__getitem__, t)): i for t, i in vocab.items() if i < 256 + len(merges)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in config["added_tokens"]})
    return lambda text: own.encode_to_numpy(text, allowed_special="all")


class Ids:
    """Ids of a text as unsigned 32-bit numbers, by a tokenizers file of byte-level BPE."""

    def __init__(self, path: str, ranked: bool = True):
        from tokenizers import Tokenizer

        self.encode = rank_encoder(path) if ranked else None
        if self.encode is None:
            tokenizer = Tokenizer.from_file(path)
            self.encode = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def of(self, text: str) -> np.ndarray:
        parts = [self.encode(p) for p in slices(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole, or cut with the remainder first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document."""

    def apply(batches):
        ids = per_process(("ids", tokenizer), lambda: Ids(tokenizer))
        end = np.array([end_id], "<u4")
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                raw = np.concatenate([ids.of(text.as_py() or ""), end]).astype("<u4", copy=False)
                for k, (start, length) in enumerate(pieces_of(len(raw), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(raw[start : start + length])))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, piece int, start long, length long, ids_crc32 long")


class SumOfSquares:
    """Open sequences by free places. Moving one from gap g to g - s changes the sum by 2(N(g-s) - N(g)) + 2."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.open = capacity, np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int | None, int]:
        """(sequence or None for a new one, gap it had) for a piece of that size. A filled sequence is no longer open."""
        n, c = self.counts, self.capacity
        change = 2 * (n[: c + 1 - size] - n[size:]) + 2
        change[0] = 1 - 2 * n[size]
        change[n[size:] == 0] = np.iinfo(np.int64).max
        gap = size + int(change.argmin())
        if not n[gap]:  # nothing open has room
            gap = c
        return (self.open[gap].pop() if gap < c else None), gap

    def put(self, seq, gap: int, size: int) -> None:
        if gap < self.capacity:
            self.counts[gap] -= 1
        if gap > size:
            self.counts[gap - size] += 1
            self.open[gap - size].append(seq)


def packed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, and the fill of each sequence.

    The longest pieces go first: the rule then also packs small sets tightly.
    """
    packer, seq, offset, fill = SumOfSquares(capacity), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at, gap = packer.place(s)
        if at is None:
            at = len(fill)
            fill.append(0)
        packer.put(at, gap, s)
        seq[i], offset[i] = at, fill[at]
        fill[at] += s
    return seq, offset, np.array(fill, np.int64)


def _pack(capacity: int, reopen: float, last: bool, first_id: int):
    def apply(batches):
        from pyspark import TaskContext

        base = (first_id + TaskContext.get().partitionId()) << 32
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        seq, offset, fill = packed(table.column("length").to_numpy(), capacity)
        done = (fill[seq] >= (1 - reopen) * capacity) | last
        out = table.select(["uid", "length"]).append_column("sequence_id", pa.array(np.where(done, base + seq, -1))).append_column("offset", pa.array(np.where(done, offset, 0)))
        yield from out.to_batches(max_chunksize=50_000)

    return apply


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, per_task: int = PER_TASK, reopen: float = REOPEN) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    made = cut(pieces(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()))
    full = made.where(F.col("length") == capacity).select("uid", (-2 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, done, stage, before = made.where(F.col("length") < capacity).select("uid", "length"), [full], 0, None
    while True:
        left = todo.count()
        if before is not None and left > SHRINK * before:
            reopen = 1.0
        before, tasks = left, max(1, math.ceil(left / per_task))
        spread = todo.repartition(tasks) if tasks > 1 else todo.coalesce(1)
        out = cut(spread.mapInArrow(_pack(capacity, reopen, tasks == 1, stage << 24), "uid long, length long, sequence_id long, offset long"))
        done.append(out.where("sequence_id <> -1").select("uid", "sequence_id", "offset"))
        if tasks == 1:
            break
        todo, stage = out.where("sequence_id = -1").select("uid", "length"), stage + 1
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    return made.join(placed, "uid").drop("uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
