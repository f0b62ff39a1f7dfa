"""What the shared steps shuffle: edges of relations that no program has, and known facts that no program could use, stay where they are."""

import pytest
from test_growth import shuffled

from quern.operators import cases, paths, similarity
from quern.plans import cases as plans


def edges(spark, n=2000):
    """n edges of each of three relations; a program can only use the first two."""
    rows = [(f"a{i % 50}", "p", f"b{i}") for i in range(n)] + [(f"b{i}", "q", f"c{i % 70}") for i in range(n)] + [(f"b{i}", "other", f"d{i}") for i in range(n)]
    return spark.createDataFrame(rows, "h string, r string, t string").repartition(2).localCheckpoint()


@pytest.fixture
def sorted_joins(spark):
    """No join is broadcast for its size, so that what a plan shuffles doesn't depend on these small tables."""
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    yield
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(name)


def test_walks_shuffle_only_edges_that_a_program_has(spark, sorted_joins):
    g = edges(spark)
    table = spark.createDataFrame([("g", "p/q")], "r string, program string")
    starts = spark.createDataFrame([("a1", "g", "p/q")], "h string, r string, program string")
    run = lambda table: shuffled(spark, lambda: paths.walk(starts, g, hops=2, table=table).collect())
    assert run(table) + 2000 <= run(None)
    of = lambda df: sorted(map(tuple, df.collect()))
    for branch in (None, 1):
        assert of(paths.walk(starts, g, branch, table=table)) == of(paths.walk(starts, g, branch))


def test_hidden_facts_are_joined_only_where_a_program_could_use_them(spark, sorted_joins):
    g = edges(spark)
    hidden = spark.createDataFrame([(f"x{i}", "g", f"y{i}") for i in range(3000)], "h string, r string, t string").localCheckpoint()
    start = lambda *programs: spark.createDataFrame([("a1", "g", p) for p in programs], "h string, r string, program string")
    run = lambda s: shuffled(spark, lambda: paths.walk(s, g, hidden=hidden, table=s.select("r", "program")).collect())
    assert run(start("p/q")) + 3000 <= run(start("p/q", "g_inv"))
    own = spark.createDataFrame([("x", "g", "y"), ("y", "g_inv", "x"), ("x", "p", "m"), ("m", "g", "y")], "h string, r string, t string")
    s = spark.createDataFrame([("x", "g", p) for p in ("g", "p/g", "p/g/g_inv/p")], "h string, r string, program string")
    got = paths.walk(s, own, hidden=own.filter("h = 'x' and r = 'g'"), table=s.select("r", "program"))
    assert [(r.program, r.end) for r in got.collect()] == [("p/g", "y")]


def test_programs_of_all_facts_of_distinct_edges_are_counted_without_grouping_them(spark, sorted_joins):
    g = edges(spark).unionByName(spark.createDataFrame([("a1", "g", "c1"), ("a1", "p2", "b1"), ("a2", "g", "a2")], "h string, r string, t string")).localCheckpoint()
    plain = shuffled(spark, lambda: paths.found_programs(g, g))
    quick = shuffled(spark, lambda: paths.found_programs(g, g, distinct=True))
    assert quick + 6000 <= plain
    of = lambda df: sorted(map(tuple, df.collect()))
    assert of(paths.found_programs(g, g, distinct=True)) == of(paths.found_programs(g, g)) != []


def test_neighbours_shuffle_the_edges_once(spark, sorted_joins):
    # each entity has its three relations once, so that no aggregation within a task makes them fewer
    rows = [(f"e{i}", r, "t") for i in range(1500) for r in ("x", "y", "z")]
    g = spark.createDataFrame(rows, "h string, r string, t string").repartition(2).localCheckpoint()
    asked = spark.createDataFrame([("e1", "x")], "h string, r string")
    rows = shuffled(spark, lambda: similarity.neighbours(asked, g).collect())
    # distinct pairs, then those by entity
    assert rows < 3 * 4500


def test_answers_of_queries_are_made_once(spark, monkeypatch):
    made = []
    write = plans.materialize
    monkeypatch.setattr(plans, "materialize", lambda df, tag="table": made.append(tag) or write(df, tag))
    assert plans.m10_cases(spark, "/root/testdata/sf0.001").count()
    assert "answers" in made


def test_diagnostics_read_written_ends(spark, monkeypatch):
    made = []
    write = cases.materialize
    monkeypatch.setattr(cases, "materialize", lambda df, tag="table": made.append(tag) or write(df, tag))
    make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    ends = make([("a", "g", "p", "x")], "h r program end")
    got = cases.diagnostics(make([("a", "g", "x")], "h r t"), make([("a", "g", "b")], "h r e"), make([("a", "g", "p")], "h r program"), ends).first()
    assert made == ["ends"] and got.loose_accuracy == 1 and got.failed == 0
