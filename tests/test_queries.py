"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lethe.plans import flows, registry, rules, stores  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def shown(x):
    return str(round(float(x), 5)) if hasattr(x, "as_integer_ratio") and not isinstance(x, bool) else repr(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    run, sql = registry.QUERIES[name]
    df = run(spark, SF)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(shown(dict(zip(columns, row, strict=True))[c]) for c in sorted(columns)) for row in found.fetchall())
    assert got == want
