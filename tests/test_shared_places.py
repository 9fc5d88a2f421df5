"""Parts that share a place, as keys beyond the side of the root do: queries against their SQL, and one mark a place."""
import duckdb
import pytest

from lodestone import bake
from lodestone import queries as Q
from lodestone.functions.measures import Partial
from lodestone.functions.tiling import Bbox
from lodestone.operators import marks, pyramid

from .test_queries import CATALOGUE, plain

NAMES = ("b05_aggregate", "b08_tile_meta", "c03_layout", "c05_dense", "c07_range_difference", "c15_sparse_rows", "g02_marks", "g13_cube", "q06_slab_fold_sparse", "q08_route", "s16_slab_pack", "t04_same_columns", "b10_witness", "c04_sparse", "q01_fold_cube", "q03_mki")


@pytest.fixture(scope="module")
def shared_dir(sf_dir, tmp_path_factory):
    """Every part again one side further, at the same place with another zone and zreal."""
    at = tmp_path_factory.mktemp("shared")
    for n in Q.TABLES:
        more = f" UNION ALL SELECT * REPLACE (l_partkey + {Q.SIDE} AS l_partkey) FROM '{sf_dir}/{n}.parquet'" if n == "lineitem" else ""
        duckdb.sql(f"COPY (SELECT * FROM (SELECT * FROM '{sf_dir}/{n}.parquet'{more}){' ORDER BY l_partkey' if more else ''}) TO '{at}/{n}.parquet'")
    return str(at)


@pytest.fixture(scope="module")
def con(shared_dir):
    """One thread: first() of the SQL is then the first row of the table."""
    c = duckdb.connect(config={"threads": 1})
    for n in Q.TABLES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{shared_dir}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, shared_dir, con, name):
    run, sql = CATALOGUE[name]
    df, rel = run(spark, shared_dir), con.sql(sql)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_place_is_one_mark(spark):
    facts = spark.createDataFrame([(0.5, 0.5, 2, "a", 1.0), (0.5, 0.5, 1, "b", 2.0), (0.25, 0.5, 2, "a", 4.0)], "x double, y double, zreal int, flag string, qty double")
    got = pyramid.cube(facts, Bbox(0.0, 0.0, 1.0, 1.0), ["flag"], [Partial("sum", "qty")]).where("k1 = 0.5 or not real").groupBy("z", "real").sum("sum__qty").collect()
    assert sorted(map(tuple, got)) == [(0, False, 7.0), (1, False, 4.0), (1, True, 3.0)]


def test_group_takes_one_fact(spark):
    facts = spark.createDataFrame([(1.0, 1.0, k, f"z{9 - k}", "R", 1.0, 1.0, 5 - k) for k in (3, 1, 2)], "x double, y double, pk int, zone string, flag string, qty double, w double, zreal int")
    assert [(r.zone, r.zreal) for r in marks.group(facts, Q.SUPPLY, ["zone"], ["pk"]).collect()] == [("z8", 2)]
    assert [r.zone for r in marks.group(facts, Q.SUPPLY, ["zone"]).collect()] == ["z6"]
    assert {r.zreal for r in bake.at_places(facts).collect()} == {2}


@pytest.mark.parametrize("name", ("q06_slab_fold_sparse", "q06_slab_fold_dense", "c14_slab_fold_mixed"))
def test_share_between_two_digits(spark, sf_dir, tmp_path, name):
    """41 of 640 is 0.0640625; its double times a million is less than 64062.5."""
    for n in Q.TABLES:
        duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/{n}.parquet' WHERE {'false' if n == 'lineitem' else 'true'}) TO '{tmp_path}/{n}.parquet'")
    rows = "SELECT unnest([41, 599, 333, 307])::DOUBLE AS l_quantity, unnest(['R', 'N', 'R', 'A']) AS l_returnflag, unnest([1, 1, 2, 2])::BIGINT AS l_partkey, 'O' AS l_linestatus, TIMESTAMP '1996-05-05' AS l_shipdate"
    duckdb.sql(f"COPY (FROM '{sf_dir}/lineitem.parquet' WHERE false UNION ALL BY NAME {rows}) TO '{tmp_path}/lineitem.parquet'")
    run, sql = CATALOGUE[name]
    rel = duckdb.sql(sql.replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet'"))
    at = rel.columns.index("share_r")
    assert sorted(r.share_r for r in run(spark, str(tmp_path)).collect()) == sorted(r[at] for r in rel.fetchall())


def test_first_row_of_the_table(spark, shared_dir, tmp_path):
    """Parts in falling order over two files of several groups: first(zone) is then not the zone of the least part."""
    (tmp_path / "lineitem.parquet").mkdir()
    for n in set(Q.TABLES) - {"lineitem"}:
        (tmp_path / f"{n}.parquet").symlink_to(f"{shared_dir}/{n}.parquet")
    for i in range(2):
        duckdb.sql(f"COPY (SELECT * FROM '{shared_dir}/lineitem.parquet' WHERE least(l_partkey % 3, 1) = {i} ORDER BY l_partkey DESC) TO '{tmp_path}/lineitem.parquet/{i}.parquet' (ROW_GROUP_SIZE 2048)")
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    run, sql = CATALOGUE["g02_marks"]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = {(r.x, r.y): r.zone for r in run(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    rel = c.sql(sql)
    x, y, zone = (rel.columns.index(n) for n in ("x", "y", "zone"))
    assert got == {(r[x], r[y]): r[zone] for r in rel.fetchall()}


def test_first_row_is_in_the_pyramid(spark, shared_dir, tmp_path):
    """The same for b05_aggregate: parts in falling order, so that a place's first row is not of its least part."""
    for n in set(Q.TABLES) - {"lineitem"}:
        (tmp_path / f"{n}.parquet").symlink_to(f"{shared_dir}/{n}.parquet")
    duckdb.sql(f"COPY (SELECT * FROM '{shared_dir}/lineitem.parquet' ORDER BY l_partkey DESC) TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    run, sql = CATALOGUE["b05_aggregate"]
    df, rel = run(spark, str(tmp_path)), c.sql(sql)
    at = [rel.columns.index(n) for n in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
