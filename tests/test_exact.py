"""Draws among what isn't known, and scoring in blocks, against plain versions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import cluster as cl
from quern.operators import negatives as ng
from quern.operators import scoring as sc
from quern.operators import vocab as vo


def test_the_nth_unknown_id(spark):
    rng = np.random.default_rng(1)
    n, known = 40, {g: sorted(rng.choice(40, size, replace=False).tolist()) for g, size in (("a", 0), ("b", 1), ("c", 17), ("d", 39), ("e", 25))}
    want = {(g, j): x for g, k in known.items() for j, x in enumerate(i for i in range(n) if i not in k)}
    draws = spark.createDataFrame([(g, j, f"{g}{j}") for g, j in want] * 2, "g string, j long, more string").repartition(3)
    have = spark.createDataFrame([(g, i) for g, k in known.items() for i in k] * 2, "g string, id long")
    got = ng.nth_unknown(draws, have, ["g"]).collect()
    assert len(got) == 2 * len(want)
    assert all(r.id == want[r.g, r.j] and r.more == f"{r.g}{r.j}" for r in got)


def facts(spark):
    # a hub whose tails are nearly all known, and one that has them all
    rows = [("hub", "r", f"e{i}") for i in range(28)] + [("a", "r", "e1"), ("a", "s", "e2"), ("b", "s", "e0")] + [("all", "q", x) for x in [*(f"e{i}" for i in range(28)), "hub", "a", "b", "all"]]
    return spark.createDataFrame(rows, "h string, r string, t string")


def test_every_fact_is_corrupted_if_any_alternative_is_unknown(spark):
    g = facts(spark)
    names, relations = vo.lexical_vocab(g), vo.numbered(g.select(F.col("r").alias("name")).distinct(), [F.asc("name")])
    known = {tuple(r) for r in g.collect()}
    seen = defaultdict(Counter)
    for seed in map(str, range(5)):
        for side in ("head", "tail", "relation"):
            got = ng.corrupted_exactly(g.withColumn("side", F.lit(side)), names, relations, g, seed).collect()
            assert not {(r.ch, r.cr, r.ct) for r in got} & known
            assert all((r.ch != r.h, r.cr != r.r, r.ct != r.t) == (side == "head", side == "relation", side == "tail") for r in got)
            # all tails of one head are known, so its facts have no other tail; everything else has an alternative
            assert len(got) == len(known) - (32 if side == "tail" else 0)
            for r in got:
                if side == "tail" and r.h == "hub":
                    seen["hub"][r.ct] += 1
    assert set(seen["hub"]) == {"hub", "a", "b", "all"}
    n = sum(seen["hub"].values())
    assert sum((v - n / 4) ** 2 / (n / 4) for v in seen["hub"].values()) < 16.3  # three degrees of freedom


def test_negatives_fill_up_and_are_drawn_alike(spark):
    g = facts(spark)
    names = vo.lexical_vocab(g)
    answers = defaultdict(set)
    for h, r, t in g.collect():
        answers[h, r].add(t)
    seen = Counter()
    for seed in map(str, range(15)):
        got = defaultdict(list)
        for r in ng.negative_entities_exactly(g, names, 30, seed).collect():
            got[r.h, r.r].append((r.e, r.positive))
        for q, own in answers.items():
            assert {e for e, p in got[q] if p} == own
            assert len(got[q]) == len(dict(got[q])) == max(30, len(own)) if len(own) < 32 else 32
        seen.update(e for e, p in got["hub", "r"] if not p)
    # two of four are drawn each time
    assert sum(seen.values()) == 30 and sum((v - 7.5) ** 2 / 3.75 for v in seen.values()) < 20
    assert ng.negative_entities_exactly(g, names, 1).filter("positive = 0").count() == 0
    every = ng.negative_entities_exactly(g.filter("h = 'a'"), names, 1000).collect()
    assert Counter(r.r for r in every) == {"r": 32, "s": 32}


def test_a_block_is_written_before_the_next_one_comes(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    e = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "e long, t array<double>")
    q = spark.createDataFrame([(i, v[i].tolist(), v[i].tolist()) for i in range(25)], "q long, h array<double>, r array<double>")
    one, many = sc.best_tails(q, e, sc.distmult, 5, 1000), sc.best_tails(q, e, sc.distmult, 5, 4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert "Broadcast" not in many._jdf.queryExecution().toString()
    asked = spark.createDataFrame([(i, "r", v[i].tolist(), v[i].tolist()) for i in range(25)], "h long, r string, hv array<double>, rv array<double>")
    ents, known = e.withColumnRenamed("t", "v"), asked.select("h", "r")
    a, b = (ng.mined(asked, ents, sc.distmult, 0.6, known, block=n) for n in (1000, 4))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and "Broadcast" not in b._jdf.queryExecution().toString()


@pytest.mark.parametrize("cut", [0.3, 0.99, 1.0, 2.0])
def test_any_cut_gives_the_same_clusters_on_either_way(spark, monkeypatch, cut):
    g = spark.createDataFrame([("a", "x", "t"), ("b", "y", "t"), ("c", "x", "t"), ("c", "y", "t"), ("d", "z", "t"), ("e", "w", "t"), ("e", "z", "t")], "h string, r string, t string")
    once = {(r.e, r.c) for r in cl.clusters(g, cut).collect()}
    monkeypatch.setattr(cl, "MOST", 0)
    assert {(r.e, r.c) for r in cl.clusters(g, cut).collect()} == once
    if cut >= 1:
        assert len({c for _, c in once}) == 1


def test_best_by_products_equals_sorting_all(spark):
    rng = np.random.default_rng(6)
    v, q = np.round(rng.normal(size=(300, 3)), 1), np.round(rng.normal(size=(17, 3)), 1)
    v[50:80] = v[20]  # ties
    b = np.round(rng.normal(size=300), 1)
    e = spark.createDataFrame([(i, v[i].tolist(), float(b[i])) for i in range(300)], "e long, v array<double>, b double").repartition(7)
    asked = spark.createDataFrame([(f"q{i}", q[i].tolist()) for i in range(17)], "q string, vec array<double>")
    for bias in (False, True):
        s = np.round(q @ v.T + (b if bias else 0), 9)
        want = sorted((f"q{i}", j, pytest.approx(s[i, j]), n + 1) for i in range(17) for n, j in enumerate(sorted(range(300), key=lambda j: (-s[i, j], j))[:12]))
        for block in (1000, 5):
            got = sc.best_by_products(asked, e, 12, block, bias)
            assert sorted(map(tuple, got.collect())) == want
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    assert sc.best_by_products(asked.filter("false"), e).collect() == [] and sc.best_by_products(asked, e.filter("false")).collect() == []


@pytest.mark.parametrize("name, columns", [
    ("transe_l1", sc.transe_l1), ("transe_l2", sc.transe_l2), ("distmult", sc.distmult), ("complex", lambda h, r, t: sc.complex_(h, r, t, 4)),
    ("rotate", lambda h, r, t: sc.rotate(h, r, t, 4)), ("ensemble", lambda h, r, t: (sc.distmult(h, r, t) + sc.transe_l2(h, r, t)) / 2),
])
def test_scores_by_matrices_equal_those_by_columns(spark, name, columns):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 8))
    v[200:260] = v[17]  # ties
    rows = [(i, v[i].tolist()) for i in range(400)]
    # what no matrix holds
    rows += [(400, [*v[1][:7].tolist(), None]), (401, v[1][:3].tolist()), (402, None), (403, [math.inf, *v[2][1:].tolist()])]
    e = spark.createDataFrame(rows, "e long, t array<double>")
    q = e.filter("e % 20 = 0").select(F.col("e").alias("q"), F.col("t").alias("h"), F.transform("t", lambda x: x / 2).alias("r"))
    of = lambda df: sorted((r.q, r.place, r.e, None if r.score is None else round(r.score, 9)) for r in df.collect())
    want = of(sc.best_tails(q, e, columns, 12))
    assert of(sc.best_tails(q, e, columns, 12, 1 if name == "rotate" else 1000, sc.TABLES[name], 8)) == want
    regular = sc.best_tails(q.filter("q < 400"), e.filter("e < 400"), columns, 12, 1000, sc.TABLES[name], 8)
    plan = regular._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "BroadcastNestedLoopJoin" not in plan


def test_facts_mined_by_matrices_equal_those_by_columns(spark):
    v = np.random.default_rng(9).normal(size=(90, 4))
    e = spark.createDataFrame([(i, v[i].tolist()) for i in range(90)] + [(90, v[0][:2].tolist())], "e long, v array<double>")
    for one in "ht":
        asked = e.filter("e % 10 = 0").select(F.col("e").alias(one), F.lit("r").alias("r"), F.col("v").alias(f"{one}v"), F.col("v").alias("rv"))
        known = spark.createDataFrame([(20, "r"), (21, "r")], "h long, r string")
        of = lambda **more: sorted((r.h, r.r, r.t, round(r.score, 9)) for r in ng.mined(asked, e, sc.distmult, 0.6, known, one == "t", **more).collect())  # noqa: B023, E731
        assert of() == of(table=sc.TABLES["distmult"], dim=4)
