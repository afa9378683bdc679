"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quarrymap.plans import ask, desk, records, runtime, search

DATA = "/root/testdata/sf0.001"
ORACLES = ask.ORACLES | desk.ORACLES | search.ORACLES | records.ORACLES | runtime.ORACLES
QUERIES = ask.QUERIES | desk.QUERIES | search.QUERIES | records.QUERIES | runtime.QUERIES


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    result = con.execute(ORACLES[name])
    heads = [d[0] for d in result.description]
    assert sorted(heads) == columns
    assert got == sorted([plain(r[heads.index(c)]) for c in columns] for r in result.fetchall())
