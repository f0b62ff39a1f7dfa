"""Small fixtures with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quern.operators import cluster, graph, paths, ranking, scoring, search, similarity, vocab
from quern.sources import io
from quern.streaming import arrivals


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split()) for e in text.split(",")], "h string, r string, t string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def scores(spark, **values):
    return spark.createDataFrame([("q", e, float(s)) for e, s in values.items()], "q string, e string, score double")


def pair(spark, *names):
    return spark.createDataFrame([("q", n) for n in names], "q string, e string")


def test_ranks_of_ties(spark):
    s, t = scores(spark, a=3, b=2, c=2, d=1), pair(spark, "b")
    assert ranking.tie_aware(s, t).first()["rank"] == 2.5
    assert ranking.optimistic(s, t).first()["rank"] == 2
    assert rows(ranking.ordinal(s), "e", "rank") == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    kept = ranking.filtered(s, pair(spark, "a", "b"), t)
    assert ranking.tie_aware(kept, t).first()["rank"] == 1.5 and ranking.optimistic(kept, t).first()["rank"] == 1
    assert ranking.tie_aware(scores(spark, a=1, b=1, c=1, d=1, e=1), pair(spark, "c")).first()["rank"] == 3.0


def test_metrics(spark):
    r = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "rank double")
    m = ranking.metrics(r).first()
    assert (m.mrr, m.hits1, m.hits3) == (0.583333, 0.333333, 0.666667)
    assert ranking.metrics(spark.createDataFrame([(1.0,), (None,)], "rank double")).first().mrr == 0.5


def test_average_precision(spark):
    x = spark.createDataFrame([("q", "a", 3.0, 1), ("q", "b", 2.0, 0), ("q", "c", 1.0, 1)], "q string, e string, score double, label int")
    assert ranking.average_precision(x).first().ap == pytest.approx((1 + 2 / 3) / 2)


def test_diamond(spark):
    g = edges(spark, "x p m1,x p m2,m1 q y,m2 q y,x g y")
    facts = g.filter("r = 'g'")
    found = paths.programs(paths.enumerate_paths(facts.select(F.col("h").alias("e")), g), facts)
    assert rows(found, "r", "program", "n") == [("g", "p/q", 2)]
    assert rows(paths.execute(facts, found, g), "program", "end", "n") == [("p/q", "y", 2)]
    assert paths.precision(found, g, facts).first()["precision"] == 1.0
    ends = paths.execute(facts, found, g)
    assert rows(paths.answer_scores(ends, spark.createDataFrame([("g", "p/q", 0.5)], "r string, program string, score double")), "e", "score") == [("y", 0.5)]


def test_prior_and_fallback(spark):
    found = spark.createDataFrame([("a", "g", "p/q", 2), ("a", "g", "s/t", 1)], "h string, r string, program string, n long")
    assert rows(paths.prior(found).withColumn("prior", F.round("prior", 4)), "program", "prior") == [("p/q", 0.6667), ("s/t", 0.3333)]
    none = spark.createDataFrame([], "c string, r string, program string, prior double")
    asked = spark.createDataFrame([("c", "g", "p/q"), ("c", "g", "z")], "c string, r string, program string")
    overall = spark.createDataFrame([("g", "p/q", 0.5)], "r string, program string, prior double")
    assert rows(paths.with_fallback(asked, none, overall, "prior"), "program", "prior") == [("p/q", 0.5), ("z", 0.0)]


def test_bandwidth(spark):
    g = edges(spark, ",".join(f"a r t{i}" for i in range(5)) + "," + ",".join(f"b r t{i}" for i in range(3)))
    none = spark.createDataFrame([], "e string, score double")
    n = {r.h: r.n_actions for r in graph.pruned_actions(g, none, bandwidth=4).collect()}
    assert n == {"a": 5, "b": 4}


def test_inverse(spark):
    g = edges(spark, "a g b,b g_inv a")
    assert rows(g.select(vocab.inverse(vocab.inverse("r")).alias("r")), "r") == [("g",), ("g_inv",)]
    assert rows(vocab.with_inverses(g), "h", "r", "t") == [("a", "g", "b"), ("a", "g", "b"), ("b", "g_inv", "a"), ("b", "g_inv", "a")]


def test_vocabularies_are_dense(spark):
    g = edges(spark, ",".join(f"e{i} r e{i % 7}" for i in range(200)))
    v = vocab.frequency_vocab(g).collect()
    assert sorted(r.id for r in v) == list(range(2, len(v) + 2))
    by = sorted(v, key=lambda r: r.id)
    assert [(-r.freq, r.name) for r in by] == sorted((-r.freq, r.name) for r in by)


def test_stream_steps(spark):
    g = edges(spark, "x r y,y r z")
    steps = spark.createDataFrame([("x", 0), ("y", 0), ("z", 1)], "e string, step long")
    assert rows(arrivals.edge_steps(g, steps), "h", "t", "step") == [("x", "y", 0), ("y", "z", 1)]
    assert rows(arrivals.coverage(arrivals.edge_steps(g, steps)), "step", "new_edges", "all_edges") == [(0, 1, 1), (1, 1, 2)]


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "e string, c int")
    new = spark.createDataFrame([("b", 2), ("d", 3)], "e string, c int")
    assert rows(arrivals.upsert(old, new, ["e"]), "e", "c") == [("a", 1), ("b", 2), ("d", 3)]
    assert {(r.e, r.old, r.new) for r in cluster.changes(old, new).collect()} == {("a", 1, None), ("b", 1, 2), ("d", None, 3)}


def test_stream_of_files(spark, tmp_path):
    for k, text in enumerate(("a r b", "b r d")):
        edges(spark, text).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    seen = []
    q = arrivals.run_stream(spark.readStream.schema("h string, r string, t string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in seen) == [("a", "r", "b"), ("b", "r", "d")]


def test_beam_keeps_best_path_per_entity(spark):
    g = edges(spark, "a r y,a s y,a r z").withColumn("log_p", F.when(F.col("t") == "z", F.lit(-1.5)).when(F.col("r") == "r", F.lit(-1.0)).otherwise(F.lit(-2.0)))
    q = spark.createDataFrame([("q", "a", "x", "w")], "q string, h string, r string, t string")
    assert rows(search.beam(q, g, 1, 2), "e", "score") == [("y", -1.0), ("z", -1.5)]


def test_neighbours(spark):
    g = edges(spark, "a p x,a q x,b p x,b q x,c p x,d z x")
    q = spark.createDataFrame([("a", "p")], "h string, r string")
    assert rows(similarity.neighbours(q, g, 2).withColumn("sim", F.round("sim", 4)), "place", "e", "sim") == [(1, "b", 1.0), (2, "c", 0.7071)]


def test_clusters(spark):
    c = {r.e: r.c for r in cluster.clusters(edges(spark, "a p x,a q x,b p x,b q x,c p x,d z x"), 0.7).collect()}
    assert c["a"] == c["b"] == c["c"] != c["d"]


def test_scorers(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, 0.0], [1.0, 1.0])], "h array<double>, r array<double>, t array<double>")
    one = lambda c: df.select(c).first()[0]
    h, r, t = F.col("h"), F.col("r"), F.col("t")
    assert one(scoring.transe_l1(h, r, t, 10.0)) == 10 - 1.5
    assert one(scoring.distmult(h, r, t)) == pytest.approx(1 / (1 + math.exp(-0.5)))
    assert one(scoring.complex_(h, r, t, 1)) == pytest.approx(1 / (1 + math.exp(-(0.5 + 1.0))))
    assert one(scoring.correlate(h, r, 2)) == [0.5, 1.0]
    assert one(scoring.label_smoothing(F.lit(1.0), 4)) == pytest.approx(1.15) and one(scoring.label_smoothing(F.lit(1.0), 4, spread=True)) == pytest.approx(0.925)


def test_readers(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    t = io.read_triples(spark, file("t", "A\tB\tr\nshort\tline\nC\tD\tSIM_x\textra\n"), order="htr", lower=True, without="sim")
    assert rows(t, "h", "r", "t") == [("a", "r", "b")]
    assert rows(io.read_labelled(spark, file("l", "a,b: +\nc,d: -\nbad\n")), "h", "t", "label") == [("a", "b", 1), ("c", "d", 0)]
    assert rows(io.read_scores(spark, file("s", "x   :0.5\ny:bad\nz\n")), "e", "score") == [("x", 0.5)]
    assert [tuple(r) for r in io.read_rules(spark, file("r", "h :- a, b\n")).collect()] == [("h", ["a", "b"])]
    assert rows(io.read_names(spark, file("n", "1\tone\n1\tuno\nbad\n")), "id", "name") == [("1", "one")]
    assert rows(io.read_index(spark, file("i", "x\t5\ny\t3\n")), "id", "name", "freq") == [(0, "x", 5), (1, "y", 3)]
    assert rows(io.read_fuzzy(spark, file("f", "a b r 0.9\na c r 0.1\n")), "h", "r", "t", "score") == [("a", "r", "b", 0.9)]
    logs = io.read_results(spark, file("log", "test]: MRR: 0.1\nnoise\ntest]: MRR: 0.2\n"), r"test\]: MRR: ([0-9.]+)", ["mrr"])
    assert rows(logs, "mrr") == [("0.2",)]
    assert io.parse_options('a="3"\n# note\nb="true"\n', {"a": 1, "b": False}) == {"a": 3, "b": True}
    with pytest.raises(KeyError):
        io.parse_options("z=1", {"a": 1})


def test_writers(spark, tmp_path):
    g = edges(spark, "a r b")
    io.write_triples(g, str(tmp_path / "out"), order="htr", inverses=True)
    assert rows(io.read_triples(spark, str(tmp_path / "out"), order="htr"), "h", "r", "t") == [("a", "r", "b"), ("b", "r_inv", "a")]
    built = []
    for _ in range(2):
        io.cached(spark, str(tmp_path / "c"), lambda: built.append(1) or g)
    assert built == [1]


def test_entry_lists_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
