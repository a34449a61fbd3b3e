"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from gaugeframe.plans import queries, sources, tools  # noqa: F401

TABLES = "/root/testdata/sf0.001"
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in NAMES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    return out


def shown(row):
    return tuple("" if x is None else f"{x + 0.0:.5f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, TABLES)
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in got.columns) + f" FROM ({queries.SQL[name]})").fetchall()
    assert sorted(shown(r) for r in got.collect()) == sorted(shown(r) for r in want)
