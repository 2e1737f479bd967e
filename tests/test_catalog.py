"""Every registered query against its SQL twin over a small scale factor, where the tables are there."""

import os

import pandas as pd
import pytest

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def _entry():
    import __spark_entry__

    return __spark_entry__


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    if hasattr(v, "item"):
        v = v.item()
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def _rows(pdf):
    return sorted(tuple(map(_value, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def _own():
    from chronoweave.plans import catalog, catalog_io, catalog_rows  # noqa: F401

    return sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", _own())
def test_query(spark, con, name):
    entry = _entry()
    got = entry.queries()[name](spark, DIR).toPandas()
    if name in entry.oracle_sql():
        want = con.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)
    else:
        assert len(got.columns)


def test_flagship(spark):
    assert _entry().entry(spark).count() > 0
