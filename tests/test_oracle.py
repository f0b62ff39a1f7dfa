"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

from quern.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("QUERN_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem documents embeddings labels".split()
TABLES += "events pages benchmark conversations".split()
NAMES = sorted(ORACLES)


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    # what SQL can't express is tested against plain versions elsewhere
    assert {n for n in QUERIES if n not in ORACLES} == {"a21_cluster_sizes", "g15_average_linkage_clusters", "m01_trained_metrics", "m02_learnt_policy_metrics", "t08_linkage_changes"}


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    assert not any("DECIMAL" in str(t) or "HUGEINT" in str(t) for t in relation.types)
    key = lambda r: [(x is None, str(x)) for x in r]
    ours = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=key)
    theirs = sorted((tuple(plain(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall()), key=key)
    assert ours == theirs
