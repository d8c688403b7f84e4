"""Every governed query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from palisade.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*[f"`{n}`" for n in names]).collect()) == plain(cur.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
