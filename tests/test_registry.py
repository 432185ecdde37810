"""Registered queries against their SQL: one of every id, and with PASSAGEWORK_ALL_QUERIES=1 all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("PASSAGEWORK_SF_DIR", "/root/testdata/sf0.001")
#: One query of every id of the inventory; those of the training-data operators have tests of their own.
BY_ID = {}
for _name in sorted(n for n in entry.queries() if n[0] in "abcdefghijk"):
    BY_ID.setdefault(_name.split("_")[0], _name)
NAMES = list(entry.queries()) if os.environ.get("PASSAGEWORK_ALL_QUERIES") else list(BY_ID.values())


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    sql = entry.oracle_sql().get(name)
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    assert got
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == cols
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in res.fetchall()), key=repr)


def test_every_query_has_a_name_of_the_inventory():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    families = {n[0] for n in entry.queries() if n != "pipeline" and not n.startswith("op")}
    assert families == set("abcdefghijk")
