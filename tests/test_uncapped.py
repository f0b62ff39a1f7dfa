"""Answers from cases count all walks of all programs."""

import pytest
from pyspark.sql import functions as F

from quern.operators import cases, paths
from quern.plans import cases as plans
from quern.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_all_successors_and_programs_count_unless_limited(spark):
    g = spark.range(1200).select(F.lit("x").alias("h"), F.lit("p").alias("r"), F.concat(F.lit("y"), "id").alias("t"))
    ranked = spark.createDataFrame([("x", "g", "p", 1.0, 1)], "h string, r string, program string, score double, place long")
    assert cases.executed(ranked, g).count() == 1200
    found, of = ranked.select("h", "r", "program", F.lit(1).cast("long").alias("n")), spark.createDataFrame([("x", "c")], "e string, c string")
    facts = g.union(spark.createDataFrame([("x", "g", "y7")], "h string, r string, t string"))
    assert [r.score for r in cases.statistics(found, facts, of).overall.collect()] == [pytest.approx(1 / 1200)]


def test_registered_answers_run_every_program(spark):
    ends = plans._Parts(spark, DATA, limited=False).ends()[2]
    assert ends.agg(F.max("nth")).first()[0] > plans.MOST
    p = plans._Parts(spark, DATA)
    every = paths.walk(ends.select("h", "r", "program").distinct(), p.train, hidden=p.test)
    assert QUERIES["g10_answers_from_cases"](spark, DATA).count() == every.select("h", "r", "end").distinct().count()
    for name in ("g10_answers_from_cases", "m09_metrics_from_cases", "m10_answered_metrics_by_relation", "k06_scores_of_relations"):
        assert "nth <=" not in ORACLES[name] and "as k from train" not in ORACLES[name]
