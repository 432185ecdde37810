"""Queries of the training-data operators that have SQL, against it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("PASSAGEWORK_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op2_decontaminate_fm", "op9_chat_format"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.select(*[f'"{n}"' for n in names]).fetchall(), key=repr)
