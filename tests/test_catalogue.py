"""Every registered query of the engine against its SQL counterpart, on the smallest tables."""

import collections
import os

import duckdb
import pytest

from meshlight import catalogue, catalogue_code, catalogue_index, catalogue_more, catalogue_rest, catalogue_rules, catalogue_upkeep, catalogue_walks
from meshlight.sources.views import TABLES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no fixture tables")
QUERIES = catalogue.QUERIES | catalogue_more.QUERIES | catalogue_rules.QUERIES | catalogue_code.QUERIES | catalogue_upkeep.QUERIES | catalogue_index.QUERIES | catalogue_walks.QUERIES | catalogue_rest.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | catalogue_more.ORACLE_SQL | catalogue_rules.ORACLE_SQL | catalogue_code.ORACLE_SQL | catalogue_upkeep.ORACLE_SQL | catalogue_index.ORACLE_SQL | catalogue_walks.ORACLE_SQL | catalogue_rest.ORACLE_SQL


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    r = oracle.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == collections.Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_has_rows(spark, name):
    assert not QUERIES[name](spark, DIR).isEmpty()
