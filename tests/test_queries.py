"""Every query against its SQL in an independent engine."""
import math

import duckdb
import pytest

from lodestone import queries as Q

CATALOGUE = Q.catalogue()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for n in Q.TABLES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)[:10] if hasattr(v, "isoformat") else str(v)
    return repr(float(v))


@pytest.mark.parametrize("name", CATALOGUE)
def test_query(spark, sf_dir, con, name):
    run, sql = CATALOGUE[name]
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert len(rel.columns) == len(cols)
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
