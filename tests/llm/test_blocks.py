"""Blocks of test items are written one after the other, and give what one block gives."""

import numpy as np
from pyspark.sql import functions as F

from quern.llm import decontaminate as dc


def test_one_block_of_items_at_a_time(spark):
    rng = np.random.default_rng(2)
    item = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 30))
    items = [(i, item()) for i in range(40)]
    rows = [(i if i % 7 else None, f"before {items[i % 40][1]} after {items[(i * 3) % 40][1]}" if i % 3 else item(), "x", i) for i in range(60)] + [(1, None, "x", 0), (1, "", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, uid int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc._count(bench, 700) > 5
    key = lambda df: sorted(map(str, df.collect()))
    one, many = dc.contaminated(docs, bench), dc.contaminated(docs, bench, block=700)
    assert key(one) == key(many) and one.count() > 60
    assert "MapInArrow" in one._jdf.queryExecution().toString() and "MapInArrow" not in many._jdf.queryExecution().toString()
    whole, parts = dc.matched(docs, bench), dc.matched(docs, bench, block=700)
    assert "MapInArrow" not in parts._jdf.queryExecution().toString()
    assert whole.columns == parts.columns and whole.count() == parts.count() == len(rows)
    same = lambda df: key(df.select("doc_id", "text", "found", "uid", F.sort_array("matches").alias("matches")))
    assert same(whole) == same(parts)
    assert dc.matched(docs.filter("false"), bench, block=700).collect() == []
