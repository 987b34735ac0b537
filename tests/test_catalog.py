"""Every registered query of the engine against its SQL at the smallest size."""

from pathlib import Path

import duckdb
import pytest

from tidewater.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else (int(v) if type(v).__name__ == "Decimal" else v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    rel = con.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
