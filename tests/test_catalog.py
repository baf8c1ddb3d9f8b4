"""Every registered query against its SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

import noticeframe.literal_cases  # noqa: F401  (registers its queries)
import noticeframe.notice_queries  # noqa: F401
import noticeframe.source_queries  # noqa: F401
import noticeframe.workspace_queries  # noqa: F401
from noticeframe.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return "NULL"
    if "bool" in str(type(v)):
        return str(bool(v))
    if isinstance(v, int | float) or (hasattr(v, "dtype") and v.dtype.kind in "iuf"):
        return f"{float(v):.6g}"
    return str(v)[:19] if hasattr(v, "year") else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert list(got.columns)
        return
    want = tables.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_without_the_optional_parts():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
