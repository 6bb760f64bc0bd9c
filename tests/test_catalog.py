"""The registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from scholium.plans import catalog

SF, LARGER = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


def connected(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list) else str(v)


def agrees(spark, duck, name, sf):
    found = catalog.QUERIES[name](spark, str(sf))
    columns = sorted(found.columns)
    rows = sorted(tuple(map(plain, r)) for r in found.select(columns).collect())
    result = duck.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    agrees(spark, duck, name, SF)


@pytest.mark.parametrize("name", ["section_drafts", "covered_sections", "reviewed_drafts"])
def test_query_over_letters_that_the_smallest_tables_lack(spark, name):
    agrees(spark, connected(LARGER), name, LARGER)


def test_entry(spark):
    assert entry.entry(spark).count() == len(catalog.harness.OUTLINE)
    assert set(entry.oracle_sql()) <= set(entry.queries())
