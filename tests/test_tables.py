"""Written tables leave no shuffle files behind."""

import os

from pyspark.sql import functions as F

from quern.functions import tables
from quern.operators import policy


def _shuffled(spark) -> set[str]:
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in top for r, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_deleted(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = _shuffled(spark)
    made = tables.materialize(df)
    assert not _shuffled(spark) - before
    assert made.count() == 7 and tables.materialize(df).agg(F.sum("n")).first()[0] == 1000
    assert spark.conf.get(tables._CLEAN) == "false"


def test_walks_write_the_edges_to_entities_seen_before_they_join_by_number(spark, monkeypatch):
    made = []
    write = policy.materialize
    monkeypatch.setattr(policy, "materialize", lambda df, tag="table": made.append(tag) or write(df, tag))
    g = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("a", "r", "a")], "h string, r string, t string")
    got = policy.walks(spark.createDataFrame([("a",)], "e string"), policy.space(g), 2, 2)
    assert made == ["addressed", "actions", "blocked", "walks", "blocked", "walks"]
    assert sorted((r.walk, r.hop, r.end) for r in got.collect()) == [(1, 1, "b"), (1, 2, "c"), (2, 1, "b"), (2, 2, "c")]
