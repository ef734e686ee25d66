"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from kvloom.plans import registry

DIR = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_is_its_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DIR)
    cursor = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(map(norm, r)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(map(norm, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == want


def test_sizes_of_large_keys_are_their_sql(spark, tmp_path):
    """Keys of larger tables, whose sizes pass 1 GB."""
    keys = [0, 1, 682, 683, 698600, 698601, 698602, 1199999, 10**9]
    spark.createDataFrame([(k, k % 50) for k in keys], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["fn_22_sizes"](spark, str(tmp_path)).orderBy("p_partkey").collect()
    sql = registry.ORACLES["fn_22_sizes"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet' ORDER BY p_partkey")
    assert [tuple(r) for r in got] == duckdb.sql(sql).fetchall()
