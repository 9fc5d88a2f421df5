"""Bake and fold of whole views, exports, streaming, viewport, scales, shapes."""
import datetime as dt
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import bake, queries
from lodestone.config import Channel, Geometry, Measure, View
from lodestone.functions import scales
from lodestone.functions.dates import in_range, make_range, parse_range
from lodestone.functions.measures import Partial
from lodestone.functions.tiling import Bbox
from lodestone.operators import geometry_codec, pyramid, triangulate, viewport
from lodestone.plans import planner
from lodestone.sources import sinks
from lodestone.streaming.cube_stream import CubeSink

VIEW = View(
    "coverage", "SELECT * FROM cov", Geometry("quadkey", "k"), mark="polygon",
    channels=(Channel("operator", "operator", "dimension", "dict"), Channel("region", "region", "dimension", "dict"), Channel("quarter", "quarter", "temporal", "date"), Channel("tests", "tests", "measure", "f32"), Channel("mbps", "mbps", "measure", "f32")),
    measures=(Measure("total", "sum(tests)"), Measure("speed", "wavg(mbps, tests)"), Measure("top", "argmax(operator, sum(tests))")), encoding={"color": {"channel": "speed"}},
)


@pytest.fixture(scope="module")
def baked(spark, tmp_path_factory):
    r = random.Random(5)
    keys = ["".join(r.choice("0123") for _ in range(9)) for _ in range(60)]
    rows = [(k, r.choice("ab"), keys.index(k) % 3, dt.date(2025, r.choice((1, 4, 7)), 1), float(r.randint(1, 9)), float(r.randint(10, 90))) for k in keys for _ in range(6)]
    spark.createDataFrame(rows, "k string, operator string, region int, quarter date, tests double, mbps double").createOrReplaceTempView("cov")
    store = sinks.BakeStore(str(tmp_path_factory.mktemp("bakes")))
    return store, bake.bake(spark, VIEW, store), rows


def test_bake_group_view(spark, baked):
    store, manifest, rows = baked
    assert manifest["perFact"] and set(manifest["grain"]) == {"operator", "quarter"} and manifest["route"]["execution"] == "client"
    assert bake.check(spark, VIEW, store) == []
    a = {tuple(r[:6]): (r.total, r.top) for r in bake.fold_view(spark, VIEW, store, ["0/0/0"], ["total", "top"], {"quarter": "2025-04-01..", "operator": ""}).drop("alive").collect()}
    b = {tuple(r[:6]): (r.total, r.top) for r in bake.fold_view(spark, VIEW, store, ["0/0/0"], ["total", "top"], {"quarter": "2025-04-01.."}, from_cube=False).drop("alive").collect()}
    assert b and a == b
    total = sum(r[4] for r in rows if r[3] >= dt.date(2025, 4, 1))
    assert sum(v[0] or 0 for v in b.values()) == total
    with pytest.raises(ValueError):
        bake.fold_view(spark, VIEW, store, ["0/0/0"], ["nope"], {})


def test_bake_row_view(spark, tmp_path):
    r = random.Random(1)
    spark.createDataFrame([(i, r.random(), r.random(), r.choice("xyz"), None if i % 9 == 0 else float(i)) for i in range(500)], "id int, a double, b double, c string, v double").createOrReplaceTempView("pts")
    v = View("points", "SELECT * FROM pts", Geometry("xy", x="a", y="b"), channels=(Channel("id", "id", "identity", "i32"), Channel("c", "c", "dimension", "dict"), Channel("v", "v", "measure", "f32")))
    store = sinks.BakeStore(str(tmp_path))
    m = bake.bake(spark, v, store)
    assert m["plan"]["reduction"] == "rawPassthrough" and m["domains"]["c"]["values"] == ["x", "y", "z"] and bake.check(spark, v, store) == []
    assert bake.check(spark, View("other", "x", Geometry("xy", x="a", y="b")), store) == ["never baked"]


def test_exports(spark, baked):
    store, manifest, _ = baked
    tiles = spark.read.parquet(store.path("coverage", manifest["version"], "tiles.parquet"))
    out = sinks.arrow_tiles(tiles.select("z", "tx", "ty", "x", "y", "total", "top"), {"top": ["a", "b"]})
    rows = out.collect()
    assert sum(r.n_rows for r in rows) == tiles.count()
    t = pa.ipc.open_stream(rows[0].data).read_all()
    assert pa.types.is_dictionary(t.schema.field("top").type) and t.num_rows == rows[0].n_rows
    import zstandard

    z = {tuple(r[:3]): r.data for r in sinks.packed(out, "zstd").collect()}
    assert all(zstandard.decompress(bytes(z[tuple(r[:3])])) == bytes(r.data) for r in rows)
    for codec in ("gzip", "zstd", "brotli"):
        back = {tuple(r[:3]): bytes(r.data) for r in sinks.unpacked(sinks.packed(out, codec), codec).collect()}
        assert back == {tuple(r[:3]): bytes(r.data) for r in rows}
    blocks = sinks.column_blocks(tiles.select("z", "tx", "ty", "total", "top", "x", "y"), ["top"]).where("place < 3").orderBy("z", "tx", "ty", "place").collect()
    assert [b.column for b in blocks[:3]] == ["x", "y", "top"]
    assert pa.ipc.open_stream(zstandard.decompress(bytes(blocks[2].data))).read_all().num_rows > 0
    folded = bake.fold_view(spark, VIEW, store, ["0/0/0"], ["total"], {}).withColumn("mki", F.monotonically_increasing_id())
    s = pa.ipc.open_stream(sinks.folded_columns(folded.select("z", "tx", "ty", "mki", "total")))
    assert json.loads(s.schema.metadata[b"tiles"])[0][0] == "0/0/0"


def test_planner():
    assert [planner.max_zoom(n) for n in (1, 250_000, 300_000_000, 500_000_000_000)] == [5, 5, 11, 16]
    assert planner.reduction(10, 10, "point") == "rawPassthrough" and planner.reduction(10**6, 10**6, "polygon") == "aggregate"
    assert planner.reduction(10**6, 10**5, "point") == "aggregate" and planner.reduction(10**6, 9 * 10**5, "point") == "quadtreeLod"


def test_stream_replay(spark, tmp_path):
    parts = [Partial("sum", "v"), Partial("cnt"), Partial("max", "v")]
    sink = CubeSink(str(tmp_path / "cube"), ["k"], parts)
    one = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "k string, v double")
    sink(one, 0)
    sink(one, 0)
    sink(spark.createDataFrame([("a", 9.0)], "k string, v double"), 1)
    assert sorted(map(tuple, sink.read(spark).collect())) == [("a", 14.0, 3, 9.0), ("b", 2.0, 1, 2.0)]


def test_structured_stream(spark, tmp_path, sf_dir):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value").repartition(3).write.parquet(str(src))
    parts = [Partial("sum", "value"), Partial("cnt")]
    sink = CubeSink(str(tmp_path / "cube"), ["event_type"], parts)
    q = spark.readStream.schema("event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(src)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_type: r.cnt for r in sink.read(spark).collect()}
    assert got == {r.event_type: r["count"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()}


def test_cover_and_prefetch():
    loaded = {(0, 0, 0), (2, 0, 0), (2, 1, 1)}
    assert viewport.cover_tiles([(2, 0, 0)], loaded) == [(2, 0, 0)]
    assert viewport.cover_tiles([(2, 0, 0), (2, 3, 3)], loaded) == [(0, 0, 0)]
    assert viewport.cover_tiles([(1, 0, 0)], {(2, 0, 0), (3, 2, 2), (3, 0, 0)}) == [(2, 0, 0), (3, 2, 2)]
    assert viewport.prefetch([(1, 0, 0)], {(0, 0, 0), (1, 1, 0), (2, 0, 0), (2, 9, 9)}) == [(0, 0, 0), (1, 1, 0), (2, 0, 0)]


def test_scales(spark):
    assert scales.scale_type({"palette": ["#fff"]}) == "categorical" and scales.scale_type({}, {"values": []}) == "categorical" and scales.scale_type({"thresholds": [1]}) == "threshold" and scales.scale_type({}) == "linear"
    assert scales.ramp_at(0.5, [(0, 0, 0), (255, 255, 255)]) == (128, 128, 128)
    assert len(scales.lookup_table("linear")) == 1024 and len(scales.lookup_table("categorical", categories=3)) == 4
    rows = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (10.0,), (99.0,)], "v double").select(scales.quantized(F.col("v"), 0.0, 10.0, 4).alias("b")).collect()
    assert [r.b for r in rows] == [0, 0, 2, 3, 3]
    assert scales.parse_embed(scales.embed_url("http://h/", view="v", f_op="a b")) == {"view": "v", "filters": {"op": "a b"}}
    assert scales.legend("threshold", [1, 2])["items"][0] == "< 1"


def test_dates():
    assert parse_range("2025-01-01") == ("2025-01-01", "2025-01-01") and parse_range("..2025") == (None, "2025") and parse_range("") is None
    assert make_range("a", None) == "a.." and in_range("2025-02-01", "2025-01-01..") and not in_range("2024-02-01", "2025-01-01..")


def test_triangulation_covers_the_area():
    shape = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    for pts in (shape, shape[::-1], [*shape, shape[0]]):
        t = triangulate.clip(pts)
        area = sum(abs(triangulate._cross(pts[a], pts[b], pts[c])) / 2 for a, b, c in zip(t[::3], t[1::3], t[2::3]))
        assert len(t) == 9 and area == pytest.approx(10)
    assert triangulate.clip([(0, 0), (1, 1)]) == [] and len(triangulate.clip([(0, 0), (1, 1), (2, 2), (3, 3)])) == 6


def test_rebased_triangles(spark):
    df = spark.createDataFrame([(0, 0, 0, i, [0.0, 0.0, 1.0, 0.0, 0.0, 1.0], [0, 3]) for i in range(3)], "z int, tx int, ty int, mki int, geometry array<float>, part_offsets array<int>").withColumn("triangles", triangulate.triangles())
    got = {r.mki: sorted(r.triangles) for r in triangulate.rebased(df).collect()}
    assert got == {0: [0, 1, 2], 1: [3, 4, 5], 2: [6, 7, 8]}


@pytest.mark.parametrize("flat,lengths,codec", [
    ([0, 0, 2, 0, 2, 1, 0, 1, 0, 0, 5, 5, 7, 5, 7, 6, 5, 6, 5, 5], [5, 5], geometry_codec.RECT), ([0, 0, 3, 1, 1, 7], [3], geometry_codec.DELTA),
    ([0.25, 0.5, 3.125, -1.75, 1, 7, 9, 9], [3, 1], geometry_codec.DELTA), ([0.1, 0.2, 3.3, 1e-9, 1, 7], [3], geometry_codec.RAW), ([], [], geometry_codec.RAW),
])
def test_codec_is_lossless(flat, lengths, codec):
    data = geometry_codec.encode(flat, lengths)
    back, ls = geometry_codec.decode(data)
    assert data[0] == codec and ls == lengths and np.array_equal(np.asarray(flat, np.float32).view(np.uint32), np.asarray(back, np.float32).view(np.uint32))


def test_codec_rejects_overrun():
    data = bytearray(geometry_codec.encode([0, 0, 3, 1, 1, 7], [3]))
    data[9] = 9
    with pytest.raises(ValueError):
        geometry_codec.decode(bytes(data))


def test_m4_and_root(spark):
    df = spark.createDataFrame([(0.0, 5.0), (1.0, 1.0), (2.0, 9.0), (3.0, 4.0)], "t double, v double")
    r = pyramid.signal_m4(df, "t", "v", 0.0, 4.0, 1).first()
    assert (r["first"], r["last"], r["min"], r["max"], r.n) == (5, 4, 1, 9, 4)
    assert Bbox(0, 0, 2, 1).padded_square().min_y < 0


def test_scan_prunes_and_pushes_down(spark, sf_dir):
    """The fold reads only its columns, and the viewport range reaches the Parquet scan."""
    from lodestone.operators import fold

    path = "/tmp/lodestone-test-facts"
    queries.facts(spark, sf_dir).write.mode("overwrite").parquet(path)
    out = fold.fold(spark.read.parquet(path), queries.ROOT, queries.trees("total"), fold.Context(), [(3, 1, 2)], ["flag"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "PushedFilters: [IsNotNull(x)" in scan and "price" not in scan.split("ReadSchema")[1]


def test_manifest_names_its_sketches(baked):
    assert baked[1]["sketches"] == {"distinctRsd": 0.05, "quantileRankError": 0.0001}
