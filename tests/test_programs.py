"""Programs counted from the middle against a walk over every path, and names that hold the marks by which texts are joined."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import cases as cs
from quern.operators import cluster as cl
from quern.operators import evaluate as ev
from quern.operators import paths as pt
from quern.operators import similarity as sm
from quern.operators import vocab as vo


def every_program(edges, facts, hops):
    """{(h, r, program): n} by walking every simple path."""
    out = {}
    for h, r, t in edges:
        out.setdefault(h, []).append((r, t))
    found = Counter()
    ends = {}
    for h, r, t in facts:
        ends.setdefault((h, t), []).append(r)

    def walk(start, nodes, program):
        for r in ends.get((start, nodes[-1]), []) if program else []:
            if "/".join(program) != r:
                found[start, r, "/".join(program)] += 1
        if len(program) < hops:
            for r, t in out.get(nodes[-1], []):
                if t not in nodes:
                    walk(start, [*nodes, t], [*program, r])

    for h in {f[0] for f in facts}:
        walk(h, [h], [])
    return dict(found)


def collected(df):
    return {(r.h, r.r, r.program): r.n for r in df.collect()}


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_programs_from_the_middle_equal_every_path(spark, hops):
    rng = np.random.default_rng(hops)
    for n, m in ((6, 40), (25, 120)):
        edges = {(f"e{a}", f"r{b}", f"e{c}") for a, b, c in zip(rng.integers(0, n, m), rng.integers(0, 3, m), rng.integers(0, n, m), strict=True)}
        edges |= {(f"e{k}", "hub", "e0") for k in range(n)} | {("e0", "of", f"e{k}") for k in range(0, n, 2)} | {("e1", "r0", "e1")}
        rows = sorted(edges)
        g = spark.createDataFrame(rows, "h string, r string, t string")
        assert collected(pt.found_programs(g, g, hops)) == every_program(rows, rows, hops)
        some = rows[::3]
        assert collected(pt.found_programs(g, spark.createDataFrame(some, "h string, r string, t string"), hops)) == every_program(rows, some, hops)


def test_equal_edges_count_each_and_no_edges_give_no_programs(spark):
    rows = [("a", "x", "b"), ("a", "x", "b"), ("b", "y", "c"), ("a", "z", "c")]
    g = spark.createDataFrame(rows, "h string, r string, t string")
    assert collected(pt.found_programs(g, g, 3)) == {("a", "z", "x/y"): 2}
    assert pt.found_programs(g.filter("false"), g.filter("false"), 3).collect() == []
    with pytest.raises(ValueError):
        pt.found_programs(g, g, 4)


def test_three_hops_form_no_row_for_a_path(spark):
    # 300 heads and 300 tails that meet in one middle: 300 * 300 walks of three hops, but a fact each
    rows = [(f"h{k}", "a", "m") for k in range(300)] + [("m", "b", "n")] + [("n", "c", f"t{k}") for k in range(300)]
    facts = [(f"h{k}", "q", f"t{k}") for k in range(300)]
    make = lambda x: spark.createDataFrame(x, "h string, r string, t string")
    assert collected(pt.found_programs(make(rows), make(facts), 3)) == {(f"h{k}", "q", "a/b/c"): 1 for k in range(300)}


NAMES = {"x": "/p/x", "y": "/p/y.z", "z": "q|r,s", "w": "50%/2", "v": "a b:c%2F"}


@pytest.fixture
def odd(spark):
    rows = [("a", "x", "b"), ("b", "y", "c"), ("a", "z", "c"), ("d", "x", "e"), ("e", "y", "f"), ("d", "z", "f"), ("c", "w", "g"), ("b", "v", "g"), ("f", "w", "i")]
    return spark.createDataFrame([(h, NAMES[r], t) for h, r, t in rows], "h string, r string, t string")


def test_programs_of_names_with_slashes_are_found_and_run(odd):
    found = pt.programs(pt.enumerate_paths(odd.select(F.col("h").alias("e")).distinct(), odd), odd)
    assert collected(found) == collected(pt.found_programs(odd, odd))
    program = "%2Fp%2Fx/%2Fp%2Fy.z"
    assert collected(found)["a", NAMES["z"], program] == 1
    ends = pt.execute(odd.filter(F.col("r") == NAMES["z"]), found, odd)
    assert {(r.h, r.program, r.end) for r in ends.collect() if r.program == program} == {("a", program, "c"), ("d", program, "f")}
    assert {r.precision for r in pt.precision(found, odd, odd).collect() if r.program == program} == {1.0}
    assert {r.prior for r in pt.prior(found).filter(F.col("program") == program).collect()} == {1.0}
    # the walk by the relation itself is hidden, whatever its name
    assert pt.walk(odd.select("h", "r", pt.step_name("r").alias("program")), odd, hidden=odd).collect() == []
    assert cs.ranked_programs(found.select("h", "r", F.lit("x").alias("program"), "n").limit(0), cs.statistics(found, odd, odd.select(F.col("h").alias("e"), F.lit("k").alias("c")).distinct())).collect() == []


def test_paths_of_such_names_are_printed_and_sampled(odd):
    paths = pt.enumerate_paths(odd.filter("h = 'a'").select(F.col("h").alias("e")).distinct(), odd).filter("n = 2 and end = 'c'")
    assert [r[0] for r in paths.select(ev.printed_path()).collect()] == ["a -/p/x-> b -/p/y.z-> c"]
    walks = pt.sample_walks(odd.select(F.col("h").alias("e")).distinct(), odd, walks=5, hops=2)
    assert ("d", "%2Fp%2Fx/%2Fp%2Fy.z", "f") in {tuple(r) for r in walks.collect()}


def test_signatures_of_names_with_commas_stay_apart(spark):
    g = spark.createDataFrame([("one", "x,y", "t"), ("two", "x", "t"), ("two", "y", "t"), ("three", "x,y", "u"), ("four", "x%2Cy", "u")], "h string, r string, t string")
    of, long = sm.groups(sm.signatures(g))
    sig = {r.e: r.sig for r in of.collect()}
    assert sig["one"] == sig["three"] and len({sig["one"], sig["two"], sig["four"]}) == 3
    assert {r.r for r in long.collect()} == {"x,y", "x", "y", "x%2Cy"}
    assert len({r.c for r in cl.clusters(g, 0.3).collect()}) == 3


def test_keys_of_names_with_bars_differ(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a%7Cb", "c")], "h string, r string")
    assert len({r[0] for r in df.select(vo.key("h", "r")).collect()}) == 3
    back = df.select(vo.plain(vo.coded("h", "|"), "|").alias("b"), "h").collect()
    assert all(r.b == r.h for r in back)


def test_three_hops_over_a_hub_make_no_pairs_of_its_neighbours(spark, monkeypatch):
    rows = [(f"c{k}", "in", "n") for k in range(200)] + [(f"c{k}", "of", "x") for k in range(200)] + [("n", "in_inv", f"c{k}") for k in range(200)] + [("n", "at", "x")] + [(f"c{k}", "p", f"o{k}") for k in range(200)]
    g = spark.createDataFrame(rows, "h string, r string, t string")
    halves, sizes = pt._halves, []

    def counted(e, pairs):
        out = halves(e, pairs)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(pt, "_halves", counted)
    got = collected(pt.found_programs(g, g, 3))
    assert sum(sizes) < 3000
    # to the others of the hub and on to x
    assert all(got[f"c{k}", "of", "in/in_inv/of"] == 199 and got[f"c{k}", "of", "in/at"] == 1 for k in range(200))
    assert got == every_program(rows, rows, 3)


def test_a_hubs_paths_are_made_by_many_tasks(spark):
    rows = [(f"c{k}", "in", "n") for k in range(60)] + [("n", "in_inv", f"c{k}") for k in range(60)]
    g = spark.createDataFrame(rows, "h string, r string, t string")
    starts = g.select(F.col("h").alias("e")).distinct()
    of = lambda df: sorted((r.start, r.program, r.end, tuple(r.nodes), r.n) for r in df.collect())
    dealt = pt.enumerate_paths(starts, g, 2, most=5)
    assert of(dealt) == of(pt.enumerate_paths(starts, g, 2))
    assert dealt.filter("n = 2").select(F.spark_partition_id()).distinct().count() > 4
