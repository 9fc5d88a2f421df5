"""Byte-level BPE through sentencepiece: the model file is written straight from a rank file.

Every byte is one printable character, every token a piece scored minus its rank, and normalisation is the
identity, so sentencepiece merges exactly as a rank-based BPE does. Pre-tokens are matches of `pattern`, each encoded
by itself; recent chunks of text are remembered (see chunked.py). Ids decode by the inverse mapping.

Cases: null text counts as empty; empty texts give no ids; a byte sequence decodes to the very bytes encoded.
"""
from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import Chunked, per_process
from .common import limit_batches, plus, spare

def byte_chars() -> list[str]:
    """One printable character per byte: itself where printable Latin-1, else the next free one above U+00FF."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised ModelProto: pieces in rank order, then the unknown piece; trainer BPE; identity normaliser."""
    chars = byte_chars()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + _varint(kind))
    pieces = [piece("".join(chars[b] for b in t), -float(i), 1) for i, t in enumerate(by_rank)] + [piece("<unk>", 0.0, 2)]
    trainer = _field(2, b"\x18\x02" + b"\xc0\x02" + _varint(len(by_rank)))  # model_type BPE; unk_id
    flag = lambda number: _varint(number << 3) + b"\x00"
    normalizer = _field(3, _field(1, b"identity") + flag(3) + flag(4) + flag(5))  # no dummy prefix, no space removal or escape
    return b"".join(pieces) + trainer + normalizer


class Codec:
    """Encoder and decoder over a rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(ranks_path)
        self.find = regex.compile(pattern).findall
        self.table = {b: c for b, c in enumerate(byte_chars())}
        inverse = {c: b for b, c in self.table.items()}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.tokens = [bytes(map(inverse.__getitem__, piece)) for piece in self.sp.id_to_piece(list(range(len(ranks))))]
        self.texts = [f" {i}" for i in range(len(ranks))]
        self.chunked = Chunked(self._entries)

    def pretokens(self, chunk: str) -> list[str]:
        """Letters alone, after at most one space, are one match of the pattern."""
        return [chunk] if chunk[:1] == " " and chunk[1:].isalpha() and chunk.isascii() else self.find(chunk)

    def encode_many(self, pretokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        return self.sp.encode([p.encode().decode("latin-1").translate(self.table) for p in pretokens], num_threads=1) if pretokens else []

    def encode(self, text: str) -> list[int]:
        return [i for x in self.encode_many(self.find(text)) for i in x]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _entries(self, chunks: list[str]) -> list[tuple[str, bytes]]:
        """The ids as text, a space before each, and their decoding, for each chunk."""
        split = [self.pretokens(c) for c in chunks]
        flat = self.encode_many([p for ps in split for p in ps])
        out, at, text, token = [], 0, self.texts.__getitem__, self.tokens.__getitem__
        for ps in split:
            ids = flat[at] if len(ps) == 1 else [i for x in flat[at : at + len(ps)] for i in x]
            at += len(ps)
            out.append(("".join(map(text, ids)), b"".join(map(token, ids))))
        return out

    def digests(self, texts: list[str]):
        for parts in self.chunked.values(texts):
            ids = "".join([p[0] for p in parts])
            yield ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(b"".join([p[1] for p in parts])).hexdigest()


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs plus ids array<int> (ids_ where docs has such a column); all columns and rows stay. Decode with `decode`."""
    limit_batches(docs.sparkSession)
    names, (out,) = docs.columns, spare(docs, "ids")

    def apply(batches):
        codec = per_process(("bpe", ranks_path, pattern), lambda: Codec(ranks_path, pattern))
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(ids, pa.list_(pa.int32()))], names=[*names, out])

    return docs.mapInArrow(apply, plus(docs, out, "array<int>"))


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with a column of ids plus decoded binary (decoded_ where rows has such a column)."""
    limit_batches(rows.sparkSession)
    names, (name,) = rows.columns, spare(rows, "decoded")

    def apply(batches):
        codec = per_process(("bpe", ranks_path, pattern), lambda: Codec(ranks_path, pattern))
        for b in batches:
            out = [codec.decode(x or []) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, name])

    return rows.mapInArrow(apply, plus(rows, name, "binary"))


def report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    limit_batches(docs.sparkSession)

    def apply(batches):
        codec = per_process(("bpe", ranks_path, pattern), lambda: Codec(ranks_path, pattern))
        for b in batches:
            got = list(codec.digests([t or "" for t in b.column("text").to_pylist()]))
            n, ids, raw = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
