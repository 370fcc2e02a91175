"""Each query of the library's own operators against its SQL, on whole small tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from geostrata.plans import catalog, formats, pixels, relational, spatial  # noqa: F401

SF_DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return str(x) if x is not None and not isinstance(x, int | str | bool) else x


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF_DIR))
    got = sorted_rows(df.collect(), df.columns)
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert got == sorted_rows(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(SF_DIR)).collect() is not None


def test_branches_of_every_order(spark, duck):
    found = {r.o for r in catalog.QUERIES["branch_split"](spark, str(SF_DIR)).collect()}
    assert found == {o for (o,) in duck.execute("SELECT DISTINCT l_orderkey FROM lineitem").fetchall()}
