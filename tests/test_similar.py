"""Nearest entities by signatures: the bounded search against all pairs."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators import similarity as sm


def brute(queries, facts, k):
    sig, having = defaultdict(set), defaultdict(set)
    for h, r, _ in facts:
        sig[h].add(r)
        having[r].add(h)
    out = set()
    for h, r in queries:
        if h not in sig:
            continue
        sims = [(round(len(sig[h] & sig[e]) / math.sqrt(len(sig[h]) * len(sig[e])), 9), e) for e in having[r] if e != h and sig[h] & sig[e]]
        for place, (s, e) in enumerate(sorted(sims, key=lambda x: (-x[0], x[1]))[:k]):
            out.add((h, r, e, s, place + 1))
    return out


@pytest.mark.parametrize("k", [1, 4, 30])
def test_neighbours_equal_all_pairs(spark, k):
    rng = random.Random(k)
    facts = sorted({(f"e{rng.randrange(60)}", f"r{min(rng.randrange(12), rng.randrange(12))}", "t") for _ in range(260)})
    queries = sorted({(f"e{rng.randrange(65)}", f"r{rng.randrange(12)}") for _ in range(120)})
    got = sm.neighbours(spark.createDataFrame(queries, "h string, r string"), spark.createDataFrame(facts, "h string, r string, t string"), k).collect()
    assert {(r.h, r.r, r.e, round(r.sim, 9), r.place) for r in got} == brute(queries, facts, k)
    assert len(got) == len({(r.h, r.r, r.e) for r in got})


def test_few_pairs_of_many_signatures(spark):
    rng = random.Random(9)
    sigs = set()
    while len(sigs) < 50_000:
        sigs.add(tuple(sorted(rng.sample(range(300), rng.randrange(4, 10)))))
    rows = [(",".join(f"r{x}" for x in s), f"r{x}") for s in sorted(sigs) for x in s]
    every = sm.indexed(spark.createDataFrame(rows, "sig string, r string")).cache()
    some = every.filter(F.xxhash64("sig") % 100 == 0).cache()
    n = some.count()
    shared = some.select("sig", F.explode("rs").alias("r")).join(every.select(F.col("sig").alias("b"), F.explode("rs").alias("r")), "r").select("sig", "b").distinct().count()
    for least, part in ((0.85, 0.1), (0.7, 0.3)):
        formed = sm.candidates(some, every, least)
        assert n < formed.count() < part * shared
        pairs = {(r.a, r.b): r.sim for r in sm.similar(some, every, least).collect()}
        of = [set(x.split(",")) for x, in some.select("sig").limit(25).collect()]
        for a in of:
            for s in sigs:
                b = {f"r{x}" for x in s}
                sim = len(a & b) / math.sqrt(len(a) * len(b))
                name = lambda x: ",".join(sorted(x, key=lambda r: int(r[1:])))
                assert ((name(a), name(b)) in pairs) == (sim >= least - 1e-9)
    every.unpersist()
    some.unpersist()
