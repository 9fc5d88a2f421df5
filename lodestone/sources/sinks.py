"""Sinks: facts, marks and tiles as Parquet, Arrow and packed exports, manifests with an atomic pointer."""
from __future__ import annotations

import gzip
import json
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import View
from ..functions.tiling import Bbox, deep_index, hilbert
from ..operators.pyramid import TILE
from . import files

ROW_GROUP_BYTES = 64 << 20


def write_sorted(df: DataFrame, path: str, root: Bbox, storage: dict | None = None) -> None:
    """Parquet in Hilbert order, so that row-group statistics prune by place. storage: partitionBy, sortBy, bloom."""
    storage = storage or {}
    key = hilbert(deep_index(root, "x"), deep_index(root, "y"))
    parts = storage.get("partitionBy", [])
    placed = df.withColumn("_key", key).repartitionByRange(*parts, "_key").sortWithinPartitions(*parts, *storage.get("sortBy", ["_key"])).drop("_key")
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in storage.get("bloom", [])} | {"compression": storage.get("compression", "zstd"), "parquet.block.size": str(ROW_GROUP_BYTES)}
    writer = placed.write.mode("overwrite").options(**options)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def write_fold_facts(facts: DataFrame, path: str) -> None:
    """What a fold reads: channels, place and zreal, without shapes, ordered by place."""
    facts.drop("geometry", "part_offsets", "ext", "ix", "iy").repartitionByRange("x", "y").sortWithinPartitions("x", "y").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_tiles(rows: DataFrame, path: str) -> None:
    """One folder per zoom; tiles are clustered inside files rather than split into a file each."""
    rows.repartitionByRange("z", "tx", "ty").sortWithinPartitions("z", "tx", "ty").write.mode("overwrite").partitionBy("z").option("compression", "zstd").parquet(path)


def dictionary(values: list, order: list[str]) -> pa.Array:
    """Canonical codes of the narrowest width; plain text above 65,536 values."""
    if len(order) > 65536:
        return pa.array(values, pa.string())
    width = pa.int8() if len(order) <= 127 else pa.int16() if len(order) <= 32767 else pa.int32()
    at = {v: i for i, v in enumerate(order)}
    return pa.DictionaryArray.from_arrays(pa.array([at.get(v) for v in values], width), pa.array(order, pa.string()))


def tile_bytes(table: pa.Table, orders: dict[str, list[str]] | None = None, meta: dict | None = None) -> bytes:
    """One tile as an Arrow stream of a single batch, dictionaries in canonical order."""
    for c, order in (orders or {}).items():
        if c in table.column_names:
            table = table.set_column(table.column_names.index(c), c, dictionary(table.column(c).to_pylist(), order))
    table = table.combine_chunks().replace_schema_metadata({k: json.dumps(v) for k, v in (meta or {}).items()} or None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def arrow_tiles(rows: DataFrame, orders: dict[str, list[str]] | None = None) -> DataFrame:
    """(z, tx, ty, n_rows, data): every tile as Arrow bytes, made where the tile is. Tiles are bounded by the bake."""
    orders = orders or {}

    def one(table: pa.Table) -> pa.Table:
        key = {k: table.column(k)[0].as_py() for k in TILE}
        data = tile_bytes(table.drop_columns([*TILE]), orders)
        return pa.table({"z": pa.array([key["z"]], pa.int32()), "tx": pa.array([key["tx"]], pa.int64()), "ty": pa.array([key["ty"]], pa.int64()), "n_rows": pa.array([table.num_rows], pa.int64()), "data": pa.array([data], pa.binary())})

    return rows.groupBy(*TILE).applyInArrow(one, "z int, tx long, ty long, n_rows long, data binary")


def packed(tiles: DataFrame, codec: str = "gzip", level: int | None = None, dictionary_: bytes | None = None) -> DataFrame:
    """data compressed per tile: gzip, zstd (with a trained dictionary, if given) or brotli."""

    def run(batches):
        import zstandard

        for b in batches:
            raw = [x for x in b.column("data").to_pylist()]
            if codec == "gzip":
                out = [gzip.compress(x, level or 6, mtime=0) for x in raw]
            elif codec == "zstd":
                c = zstandard.ZstdCompressor(level=level or 19, dict_data=zstandard.ZstdCompressionDict(dictionary_) if dictionary_ else None)
                out = [c.compress(x) for x in raw]
            else:
                c = pa.Codec(codec, compression_level=level)
                out = [c.compress(x, asbytes=True) for x in raw]
            yield b.set_column(b.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))

    return tiles.mapInArrow(run, tiles.schema)


def unpacked(tiles: DataFrame, codec: str = "gzip", largest: int = 1 << 30, dictionary_: bytes | None = None) -> DataFrame:
    """The inverse of packed; a block that would inflate beyond `largest` is refused."""

    def run(batches):
        import zstandard

        for b in batches:
            out = []
            for x in b.column("data").to_pylist():
                if codec == "gzip":
                    raw = zlib.decompressobj(31).decompress(x, largest + 1)
                elif codec == "zstd":
                    raw = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary_) if dictionary_ else None).decompress(x, max_output_size=largest)
                else:
                    raw = pa.CompressedInputStream(pa.BufferReader(x), codec).read(largest + 1)
                if len(raw) > largest:
                    raise ValueError("a block is larger than allowed")
                out.append(raw)
            yield b.set_column(b.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))

    return tiles.mapInArrow(run, tiles.schema)


def tile_rows(tiles: DataFrame, schema: str) -> DataFrame:
    """Rows of Arrow tiles (see arrow_tiles), with z, tx, ty; dictionaries become text. schema: of the rows."""
    columns = [f.name for f in tiles.sparkSession.createDataFrame([], schema).schema]

    def run(batches):
        for b in batches:
            for z, tx, ty, data in zip(*(b.column(c).to_pylist() for c in (*TILE, "data"))):
                t = pa.ipc.open_stream(data).read_all()
                t = pa.table({c: t.column(c).cast(t.schema.field(c).type.value_type) if pa.types.is_dictionary(t.schema.field(c).type) else t.column(c) for c in columns})
                n = t.num_rows
                for part in pa.table([pa.array([z] * n, pa.int32()), pa.array([tx] * n, pa.int64()), pa.array([ty] * n, pa.int64()), *t.columns], names=[*TILE, *columns]).to_batches():
                    yield part

    return tiles.mapInArrow(run, f"z int, tx long, ty long, {schema}")


def packs(tiles: DataFrame, side: int = 16) -> DataFrame:
    """(pack, index, data): blocks of leaf tiles one after the other, in tile order, and where each begins and ends.

    tiles: z, tx, ty, is_leaf, data. A pack holds a square of `side` x `side` tiles of a zoom.
    """

    def one(table):
        t = table.sort_by([("tx", "ascending"), ("ty", "ascending")])
        at, index = 0, []
        for x, y, data in zip(t.column("tx").to_pylist(), t.column("ty").to_pylist(), t.column("data").to_pylist()):
            index.append({"tx": x, "ty": y, "start": at, "end": at + len(data)})
            at += len(data)
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("tx", "ty", "start", "end")]))
        return pa.table({"z": t.column("z").slice(0, 1).cast(pa.int32()), "index": pa.array([index], kind), "data": pa.array([b"".join(t.column("data").to_pylist())], pa.binary())})

    square = [F.floor(F.col(c) / side) for c in ("tx", "ty")]
    return tiles.where("is_leaf").select(*TILE, "data").groupBy("z", *square).applyInArrow(one, "z int, index array<struct<tx:bigint,ty:bigint,start:bigint,end:bigint>>, data binary")


def from_packs(packed_: DataFrame) -> DataFrame:
    """z, tx, ty, data: the blocks of packs, each cut out by its index entry."""
    each = packed_.select("z", "data", F.inline("index"))
    return each.select(*TILE, F.substring("data", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("data"))


def slab_blocks(slabs: DataFrame) -> DataFrame:
    """(z, tx, ty, data): the lists of a tile's slab as one Arrow block. Sparse slabs are told by their cell_ids."""
    names_ = [c for c in slabs.columns if c not in TILE]

    def run(batches):
        for b in batches:
            data = [tile_bytes(pa.Table.from_batches([b.slice(i, 1).select(names_)])) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in TILE), pa.array(data, pa.binary())], names=[*TILE, "data"])

    return slabs.select(*TILE, *names_).mapInArrow(run, "z int, tx long, ty long, data binary")


def read_slabs(blocks: DataFrame, parts: dict[str, str]) -> DataFrame:
    """The inverse of slab_blocks: z, tx, ty, sparse, offsets, cell_ids and the lists of parts (name: type).

    A block without cell_ids holds dense planes and has null offsets and cell_ids.
    """
    kinds = {"offsets": "array<int>", "cell_ids": "array<int>", **{c: f"array<{t}>" for c, t in parts.items()}}
    fields = ", ".join(f"{c} {t}" for c, t in kinds.items())
    arrow = {"int": pa.int32(), "float": pa.float32(), "double": pa.float64()}

    def run(batches):
        for b in batches:
            for z, tx, ty, data in zip(*(b.column(c).to_pylist() for c in (*TILE, "data"))):
                t = pa.ipc.open_stream(data).read_all()
                lists = [t.column(c).combine_chunks().cast(pa.list_(arrow[k[6:-1]])) if c in t.column_names else pa.nulls(1, pa.list_(arrow[k[6:-1]])) for c, k in kinds.items()]
                yield pa.RecordBatch.from_arrays([pa.array([z], pa.int32()), pa.array([tx], pa.int64()), pa.array([ty], pa.int64()), pa.array(["cell_ids" in t.column_names]), *lists], names=[*TILE, "sparse", *kinds])

    return blocks.mapInArrow(run, f"z int, tx long, ty long, sparse boolean, {fields}")


def column_blocks(rows: DataFrame, first: list[str] = ()) -> DataFrame:
    """(z, tx, ty, place, column, data): each column of a tile as a zstd block of its own, in reading order: shape,
    then `first` (see first_paint), then the rest, so that a reader fetches only what it draws."""
    names = [c for c in rows.columns if c not in TILE]
    shape = [c for c in ("x", "y", "geometry", "part_offsets", "triangles") if c in names]
    order = list(dict.fromkeys([*shape, *[c for c in first if c in names], *names]))

    def one(table: pa.Table) -> pa.Table:
        import zstandard

        key = [table.column(k)[0].as_py() for k in TILE]
        blocks = [zstandard.ZstdCompressor(level=9).compress(tile_bytes(table.select([c]))) for c in order]
        n = len(order)
        return pa.table({"z": pa.array([key[0]] * n, pa.int32()), "tx": pa.array([key[1]] * n, pa.int64()), "ty": pa.array([key[2]] * n, pa.int64()), "place": pa.array(range(n), pa.int32()), "column": pa.array(order, pa.string()), "data": pa.array(blocks, pa.binary())})

    return rows.groupBy(*TILE).applyInArrow(one, "z int, tx long, ty long, place int, column string, data binary")


def slab_dictionary(tiles: DataFrame, blocks: int = 4000, largest: int = 32 << 10, size: int = 112 << 10) -> bytes | None:
    """A zstd dictionary from a bounded sample of small blocks, or none below 16 of them."""
    import zstandard

    got = [bytes(r.data) for r in tiles.where(F.length("data") <= largest).orderBy(F.xxhash64(*TILE)).limit(blocks).select("data").collect()]
    return zstandard.train_dictionary(size, got).as_bytes() if len(got) >= 16 else None


def folded_columns(df: DataFrame) -> bytes:
    """The edge form of a fold: rows by tile, run lengths of tiles in the schema's metadata."""
    rows = df.orderBy("z", "tx", "ty", "mki").toArrow()
    runs: dict[str, int] = {}
    for z, x, y in zip(*(rows.column(c).to_pylist() for c in TILE)):
        runs[f"{z}/{x}/{y}"] = runs.get(f"{z}/{x}/{y}", 0) + 1
    return tile_bytes(rows.drop_columns([*TILE, "mki"]), meta={"tiles": [[k, n] for k, n in runs.items()]})


class BakeStore:
    """Immutable versions of a view with a pointer flipped by rename, in any file system that Spark reads."""

    def __init__(self, folder: str):
        self.folder = folder

    def new_version(self, view_id: str) -> str:
        v = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        files.make(self.path(view_id, v))
        return v

    def path(self, view_id: str, version: str, *parts: str) -> str:
        return "/".join([self.folder.rstrip("/"), view_id, version, *parts])

    def publish(self, view_id: str, version: str, manifest: dict) -> None:
        files.write(self.path(view_id, version, "manifest.json"), json.dumps(manifest, indent=1))
        files.write(self.path(view_id, "latest.json"), json.dumps({"version": version}))

    def latest(self, view_id: str) -> tuple[str, dict] | None:
        pointer = files.read(self.path(view_id, "latest.json"))
        if pointer is None:
            return None
        version = json.loads(pointer)["version"]
        return version, json.loads(files.read(self.path(view_id, version, "manifest.json")))


def first_paint(view: View, per_fact: list[str], reduction: str) -> list[str]:
    """Columns to read first: the colour channel, then up to four per-mark dimensions or days."""
    if reduction == "aggregate" and not view.grouped:
        return []
    dims = [c.name for c in view.channels if c.role in ("dimension", "temporal") and c.name not in per_fact]
    return list(dict.fromkeys([*filter(None, [view.color]), *dims[:4]]))
