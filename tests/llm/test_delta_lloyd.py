"""Clustering by differences against Lloyd's rounds in plain Python."""

import hashlib
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quern.llm import delta_lloyd as dl

COLUMNS = [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]


def expected(rows, k=16, rounds=3, size=64):
    rows = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in rows)
    cs = [x for _, x in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(x, c), n) for n, c in enumerate(cs)) for _, x in rows]
    for _ in range(rounds):
        own = assign()
        for n in range(len(cs)):
            mine = [x for (_, x), (_, c) in zip(rows, own, strict=True) if c == n]
            if mine:
                cs[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = assign()
    inertia = [sum(d for d, c in own if c == n) for n in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(rows, own, strict=True)), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors():
    rng = np.random.default_rng(8)
    out = [(i, (rng.normal(0, 0.3, 64) + 0.2 * (i % 5)).tolist()) for i in range(150)]
    out += [(200 + i, out[3][1]) for i in range(40)]  # a common vector
    return [*out, (5, out[7][1]), (5, out[5][1]), (None, out[9][1]), (300, None), (301, []), (302, [1.0] * 63), (303, [float("nan")] * 64), (304, [float("inf")] * 64), (305, [None] * 64), (306, [0.0] * 65), (307, [500.0] * 64), (308, [-3.0] * 64)]


def test_equals_rounds_from_scratch(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(5)
    got = dl.cluster(df)
    assert got.dtypes == COLUMNS
    assert collected(got) == expected(rows)
    for k, rounds in ((1, 2), (3, 6), (400, 2)):
        assert collected(dl.cluster(df, k, rounds)) == expected(rows, k, rounds)


def test_differences_equal_all_comparisons_and_are_fewer():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-9, 9, (500, 4)), rng.integers(-9, 9, (8, 4))
    owner, distance, n = dl.nearest(x, np.full(500, -1), np.zeros(500, np.int64), c, np.ones(8, bool))
    assert n == 4000
    for _ in range(5):
        new = c.copy()
        new[rng.integers(0, 8, 2)] += rng.integers(-2, 3, (2, 4))
        owner, distance, n = dl.nearest(x, owner, distance, new, (new != c).any(1))
        d = ((x[:, None] - new[None]) ** 2).sum(2)
        assert (owner == d.argmin(1)).all() and (distance == d.min(1)).all() and n < 4000
        c = new


def test_exact_for_very_large_components(spark):
    rows = [(i, [s * 3e38 * (j % 2 or -1) for j in range(64)]) for i, s in enumerate((1, -1, 0.5, -0.5))] + [(9, [2.0**20 + i for i in range(64)])]
    got = dl.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).collect()
    assert len(got) == 5 and all(r.distance >= 0 for r in got)
    assert dl.distances(np.full((1, 64), dl.LARGEST), np.full((1, 64), -dl.LARGEST)).tolist() == [[64 * (2 * dl.LARGEST) ** 2]]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert dl.cluster(none).collect() == [] and dl.cluster(none).dtypes == COLUMNS
    assert dl.cluster(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_one_vector_and_equal_ones(spark):
    rows = [(1, [0.25] * 64)] * 5
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert collected(dl.cluster(df)) == expected(rows)
    assert {r.cluster for r in dl.cluster(df).collect()} == {0}


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view embeddings as select * from '{d}/embeddings.parquet'")
    want = duckdb.sql(dl.SQL)
    got = dl.op13_centroid_clustering(spark, d)
    assert want.columns == got.columns
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in got.collect())
    read = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()
    assert collected(got) == expected([tuple(r) for r in read])
