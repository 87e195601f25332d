import math
import os

import duckdb
import pytest

from gridhaul.plans import field_queries, later_queries  # noqa: F401  register more queries
from gridhaul.plans import queries as plans


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 9)
    return x


SLOW = {"geocode_cascade", "geocode_cached", "route_dijkstra", "distance_matrix_documents"}  # the driver compares these


@pytest.mark.parametrize("name", sorted(set(plans.ORACLE) - SLOW))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    r = con.execute(plans.ORACLE[name])
    at = {d[0]: k for k, d in enumerate(r.description)}
    want = sorted(str([plain(x[at[c]]) for c in cols]) for x in r.fetchall())
    got = sorted(str([plain(x[c]) for c in cols]) for x in df.collect())
    assert sorted(at) == cols and got == want


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
