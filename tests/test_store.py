"""The state of steps as deltas, and clusters that are kept up to date, against counting and clustering everything at once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import cluster as cl
from quern.operators import paths as pt
from quern.operators import similarity as sm
from quern.plans import stream
from quern.streaming import state as st


def graph(spark, last_edges=3):
    """300 entities with few edges each; the last step has as many edges as said."""
    rng = random.Random(5)
    facts = sorted({(f"e{rng.randrange(300)}", f"r{rng.randrange(5)}", f"e{rng.randrange(300)}") for _ in range(700)})
    rng.shuffle(facts)
    cut = len(facts) - last_edges
    return spark.createDataFrame([(h, r, t, 2 if i >= cut else i % 2) for i, (h, r, t) in enumerate(facts)], "h string, r string, t string, step int")


def at_once(g):
    found = pt.programs(pt.enumerate_paths(g.select(F.col("h").alias("e")).distinct(), g), g)
    tries = pt.precision_partials(pt.execute(g, found, g), g)
    clusters = st.clusters_of(g)
    return {"edges": g, "clusters": clusters, "found": found, "tries": tries, "sums": st.partial_sums(found, tries, clusters).filter("uses != 0 or total != 0")}


def same(state, tables):
    for name, want in tables.items():
        got = getattr(state, name)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())), name


def written(spark, folder):
    return {name: spark.read.parquet(f"{folder}/{name}").count() for name in os.listdir(folder) if name != "done"}


def test_a_small_step_writes_little_and_merging_gives_the_whole(spark, tmp_path):
    g = graph(spark)
    state = st.run(g, str(tmp_path), 2)
    tables = at_once(g.select("h", "r", "t"))
    same(state, tables)
    first, last = written(spark, f"{tmp_path}/step=0"), written(spark, f"{tmp_path}/step=2")
    assert last["edges"] == 3 and last["clusters"] <= 3
    stale = st.touched(g.select("h", "r", "t"), g.filter("step = 2").select("h", "r", "t")).count()
    assert last["found_void"] == last["tries_void"] == stale < 30
    whole = {name: table.count() for name, table in tables.items()}
    assert all(last[name] < whole[name] / 4 for name in ("edges", "clusters", "found"))
    assert sum(last.values()) < sum(first.values()) / 2


def test_a_step_that_was_cut_off_is_run_again(spark, tmp_path, monkeypatch):
    g = graph(spark)
    st.run(g, str(tmp_path), 0)
    finish = st._finish
    monkeypatch.setattr(st, "_finish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        st.run(g, str(tmp_path), 1)
    assert os.path.isdir(f"{tmp_path}/step=1/sums") and st.load(spark, str(tmp_path), 1) is None
    monkeypatch.setattr(st, "_finish", finish)
    seen = []
    same(st.run(g, str(tmp_path), 2, lambda _, k: seen.append(k)), at_once(g.select("h", "r", "t")))
    assert seen == [1, 2]


def test_compacted_states_are_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "COMPACT", 2)
    g = graph(spark, 40)
    state = st.run(g, str(tmp_path), 2)
    assert sorted(x for x in os.listdir(tmp_path) if x.startswith("base")) == ["base=1"]
    same(state, at_once(g.select("h", "r", "t")))
    same(st.load(spark, str(tmp_path), 1), at_once(g.filter("step < 2").select("h", "r", "t")))
    assert st.load(spark, str(tmp_path), 3) is None


def sizes(spark, rows):
    return spark.createDataFrame(rows, "sig string, n long")


def test_clusters_after_changes_equal_clustering_anew(spark):
    rng = random.Random(2)
    make = lambda: ",".join(sorted(rng.sample([f"r{i}" for i in range(14)], rng.randrange(1, 4))))
    now = {make(): rng.randrange(1, 9) for _ in range(30)}
    cut, merges, splits = 0.45, 0, 0
    state = cl.linkage(sizes(spark, list(now.items())), cut)
    total = again = 0
    for _ in range(6):
        before = {r.sig: r.c for r in state.clusters.collect()}
        for sig in rng.sample(sorted(now), 3):
            if rng.random() < 0.5:
                del now[sig]
            else:
                now[sig] += rng.randrange(1, 40)
        for _ in range(2):
            now[make()] = rng.randrange(1, 9)
        df = sizes(spark, list(now.items()))
        state, some = cl.relinked(state, df, cut)
        fresh = cl.linkage(df, cut)
        same_rows = lambda a, b: sorted(map(tuple, a.select("sig", b.columns[1]).collect())) == sorted(map(tuple, b.collect()))
        assert same_rows(state.clusters, fresh.clusters) and same_rows(state.components, fresh.components)
        total, again = total + len(now), again + some.count()
        after = {r.sig: r.c for r in state.clusters.collect()}
        both = [s for s in before if s in after]
        merges += any(before[a] != before[b] and after[a] == after[b] for a in both for b in both)
        splits += any(before[a] == before[b] and after[a] != after[b] for a in both for b in both)
    assert merges and splits and again < total


def test_unchanged_signatures_are_not_clustered_again(spark):
    rows = [("a,b", 3), ("a,b,c", 2), ("x,y", 5), ("x,y,z", 1), ("q", 4)]
    state = cl.linkage(sizes(spark, rows), 0.4)
    assert {r.sig: r.k for r in state.components.collect()} == {"a,b": "a,b", "a,b,c": "a,b", "x,y": "x,y", "x,y,z": "x,y", "q": "q"}
    assert cl.relinked(state, sizes(spark, rows), 0.4)[1].collect() == []
    _, some = cl.relinked(state, sizes(spark, [*rows[:-1], ("q", 9), ("x,y,w", 1)]), 0.4)
    assert {r.sig for r in some.collect()} == {"x,y", "x,y,z", "x,y,w", "q"}
    one, some = cl.relinked(cl.linkage(sizes(spark, rows), 1.0), sizes(spark, rows[1:]), 1.0)
    assert {r.c for r in one.clusters.collect()} == {"a,b,c"} and some.count() == 4
    gone, _ = cl.relinked(state, sizes(spark, []), 0.4)
    assert gone.clusters.collect() == [] and gone.components.collect() == []


def test_query_of_changes_equals_clustering_both_steps_anew(spark):
    d = "/root/testdata/sf0.001"
    of = lambda step: {r.e: r.c for r in cl.clusters(stream._train(spark, d, step)).collect()}
    a, b = of(stream.AT - 1), of(stream.AT)
    got = {(r.e, r.old, r.new) for r in stream.t08_linkage(spark, d).collect()}
    assert got == {(e, a.get(e), b.get(e)) for e in {*a, *b} if a.get(e) != b.get(e)} and got
    assert sm.groups(sm.signatures(stream._train(spark, d, 0)))[0].count() > 0
