"""Answering from cases and its state, on fixtures worked out by hand and against counting everything at once."""

import pytest
from pyspark.sql import functions as F

from quern.operators import cases, evaluate, negatives, paths, ranking, scoring, search, vocab
from quern.streaming import arrivals, state


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split()) for e in text.split(",")], "h string, r string, t string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_scores_fall_back_as_a_whole(spark):
    # the cluster has a prior of the program but no precision: both factors come from all entities
    sums = table(spark, [("c", "g", "p/q", 9, 0, 0), (None, "g", "p/q", 0, 2, 5), (None, "g", "s/t", 9, 0, 5)], "c string, r string, program string, uses long, good long, total long")
    overall = sums.groupBy("r", "program").agg(*(F.sum(n).alias(n) for n in ("uses", "good", "total")))
    by_cluster, every = paths.scores_of(sums.filter("c is not null"), ["c", "r"]), paths.scores_of(overall, ["r"])
    asked = table(spark, [("c", "g", "p/q"), ("c", "g", "none")], "c string, r string, program string")
    assert rows(paths.with_fallback(asked, by_cluster, every, "score"), "program", "score") == [("none", 0.0), ("p/q", pytest.approx(0.2))]


def _statistics(spark, scores):
    none = table(spark, [], "c string, r string, program string, score double")
    return cases.Statistics(none, table(spark, scores, "r string, program string, score double"), table(spark, [("x", "c")], "e string, c string"))


def test_first_programs_that_run(spark):
    g = edges(spark, "x b y,x c z,m a n")
    pool = table(spark, [("x", "g", p, 1) for p in ("a", "b", "c", "g")], "h string, r string, program string, n long")
    ranked = cases.ranked_programs(pool, _statistics(spark, [("g", "a", 0.9), ("g", "b", 0.5), ("g", "c", 0.4)]))
    assert rows(ranked, "program", "place") == [("a", 1), ("b", 2), ("c", 3)]  # the relation itself isn't ranked
    ends = cases.executed(ranked, g, most=1)
    assert rows(ends, "program", "end", "nth") == [("b", "y", 1)]  # a has no ends and doesn't count
    assert rows(cases.answers(cases.executed(ranked, g)), "e", "score") == [("y", 0.5), ("z", 0.4)]


def test_pool_of_neighbours_and_an_answer_scored_once(spark):
    g = edges(spark, "e p m,e q m2,m s y,m2 s y,e g y,x p n,x q n2,n s z,n2 s z")
    found = paths.programs(paths.enumerate_paths(g.select(F.col("h").alias("e")).distinct(), g), g)
    near = table(spark, [("x", "g", "e")], "h string, r string, e string")
    pool = cases.program_pool(near, found)
    assert rows(pool, "program", "n") == [("p/s", 1), ("q/s", 1)]
    got = cases.answer(near.select("h", "r"), near, found, g, _statistics(spark, [("g", "p/s", 0.5), ("g", "q/s", 0.25)]))
    assert rows(got, "e", "score") == [("z", 0.75)]


def test_walks_hide_the_asked_fact(spark):
    g = edges(spark, "x g y,y g_inv x,x p m,m g y,y q z")
    start = table(spark, [("x", "g", p) for p in ("g", "p/g", "g/q", "p/g/g_inv/p")], "h string, r string, program string")
    hidden = edges(spark, "x g y")
    assert rows(paths.walk(start, g), "program", "end") == [("g", "y"), ("g/q", "z"), ("p/g", "y"), ("p/g/g_inv/p", "m")]
    assert rows(paths.walk(start, g, hidden=hidden), "program", "end") == [("p/g", "y")]


def test_branch_cap_takes_the_smallest_md5(spark):
    import hashlib

    g = edges(spark, ",".join(f"x p m{i}" for i in range(6)))
    got = rows(paths.walk(table(spark, [("x", "g", "p")], "h string, r string, program string"), g, branch=2), "end")
    assert got == sorted((t,) for t in sorted((f"m{i}" for i in range(6)), key=lambda t: hashlib.md5(f"0|x|p|{t}".encode()).hexdigest())[:2])


def test_ranks_among_known_answers(spark):
    data = [("q", "a", 3.0, True), ("q", "b", 2.0, True), ("q", "c", 2.0, False), ("q", "d", 2.0, False), ("q", "e", 1.0, True), ("q", "f", 5.0, False)]
    got = ranking.among(table(spark, data, "q string, e string, score double, known boolean"))
    assert {r.e: (r.place, r.optimistic, r.tie_aware) for r in got.collect() if r.known} == {"a": (2, 2, 2.0), "b": (2, 2, 3.0), "e": (4, 4, 4.0)}


def test_top_positions_count_nothing_beyond(spark):
    s = table(spark, [("q", e, float(x)) for e, x in (("a", 3), ("b", 2), ("c", 1))], "q string, e string, score double")
    at = lambda e, k: ranking.top_k(s, table(spark, [("q", e)], "q string, e string"), k).first().position
    assert (at("a", 2), at("b", 2), at("c", 2), at("c", 3), at("z", 3)) == (0, 1, None, 2, None)
    m = ranking.top_k_metrics(table(spark, [(0,), (2,), (None,)], "position long")).first()
    assert (m.hits1, m.hits3, m.mrr) == (0.333333, 0.666667, 0.444444)  # the first place counts as a hit


def test_beam_keeps_the_best_path_of_an_entity(spark):
    policy = table(spark, [("x", "a", "y", -1.0), ("x", "b", "y", -2.0), ("x", "c", "z", -1.5), ("x", "d", "w", -3.0)], "h string, r string, t string, log_p double")
    q = table(spark, [("1", "x", "g", "none")], "q string, h string, r string, t string")
    assert rows(search.beam(q, policy, 1, 2), "e", "score", "rank") == [("y", -1.0, 1), ("z", -1.5, 2)]


def test_corruption_is_drawn_again_while_known(spark):
    g = edges(spark, "a r b,a r c,a r d,b r a")
    names = vocab.lexical_vocab(g)
    rel = vocab.numbered(g.select(F.col("r").alias("name")).distinct(), [F.asc("name")])
    got = negatives.corrupted(negatives.heads_or_tails(g), names, rel, g, tries=40).collect()
    known = {tuple(r) for r in g.collect()}
    assert len(got) == 4 and not {(r.ch, r.cr, r.ct) for r in got} & known
    assert all((r.side == "head") == (r.ch != r.h) and (r.side == "tail") == (r.ct != r.t) for r in got)
    none = negatives.corrupted(g.withColumn("side", F.lit("relation")), names, rel, g, tries=3)
    assert none.count() == 0  # there is one relation, so every draw is known


def test_negative_entities_fill_up(spark):
    g = edges(spark, "a r b,a r c,x s b")
    names = vocab.lexical_vocab(g)
    got = negatives.negative_entities(g, names, 3).collect()
    of = lambda h: [(r.e, r.positive) for r in got if r.h == h]
    assert sum(p for _, p in of("a")) == 2 and len(of("a")) == 3 and len({e for e, _ in of("a")}) == 3
    assert sum(p for _, p in of("x")) == 1 and len({e for e, _ in of("x")}) == len(of("x")) == 3


def test_error_overlap_of_all_sets(spark):
    a, b = edges(spark, "1 r x,2 r x,3 r x"), edges(spark, "2 r x,3 r x,4 r x")
    assert rows(evaluate.error_overlap({"a": a, "b": b}), "names", "facts") == [("a", 3), ("a,b", 2), ("b", 3)]


def test_losses(spark):
    r = table(spark, [(0.25, 1.0)], "p double, y double").select(scoring.cross_entropy(F.col("p"), F.col("y")).alias("bce"), scoring.margin_loss(F.lit(2.0), F.lit(1.5), 1.0).alias("margin"), scoring.discounted(F.lit(2.0), 3, 0.5).alias("back")).first()
    assert (round(r.bce, 6), r.margin, r.back) == (1.386294, 0.5, [0.5, 1.0, 2.0])


def test_steps_of_three_entities(spark):
    g = edges(spark, "x r y,y r z")
    steps = table(spark, [("x", 0), ("y", 0), ("z", 1)], "e string, step long")
    stepped = arrivals.edge_steps(g, steps)
    assert rows(stepped, "h", "t", "step") == [("x", "y", 0), ("y", "z", 1)]
    seen = state.visible(stepped.withColumn("split", F.lit("train")), 1)
    assert rows(seen, "h", "r", "t", "new") == [("x", "r", "y", False), ("y", "r", "z", True), ("y", "r_inv", "x", False), ("z", "r_inv", "y", True)]


def test_affected_entities(spark):
    g = edges(spark, "e a u,u b v,e q v,e q w")
    paths_ = paths.enumerate_paths(table(spark, [("e",)], "e string"), g)
    new = table(spark, [("e",)], "e string")
    assert rows(arrivals.affected(paths_, g, new), "e") == [("u",), ("v",)]  # w is reached by the asked edge alone


def test_signatures_and_clusters_that_change(spark):
    before, after = edges(spark, "a r x,b r x,c r x"), edges(spark, "a r x,b r x,b s x,d r x")
    from quern.operators.similarity import signatures

    assert rows(state.changed_signatures(signatures(before), signatures(after)), "e", "change") == [("b", "modified"), ("c", "gone"), ("d", "new")]
    got = state.cluster_changes(state.clusters_of(before), state.clusters_of(after), table(spark, [("a",)], "e string"))
    assert rows(got, "c", "adds", "e") == [("r", False, "a"), ("r", False, "b"), ("r", False, "c"), ("r", True, "a"), ("r", True, "d"), ("r,s", True, "b")]


def _random_graph(spark):
    import random

    rng = random.Random(3)
    facts = sorted({(f"e{rng.randrange(25)}", f"r{rng.randrange(4)}", f"e{rng.randrange(25)}") for _ in range(140)})
    return table(spark, [(h, r, t, rng.randrange(3)) for h, r, t in facts], "h string, r string, t string, step int")


def _at_once(g):
    found = paths.programs(paths.enumerate_paths(g.select(F.col("h").alias("e")).distinct(), g), g)
    tries = paths.precision_partials(paths.execute(g, found, g), g)
    return found, tries, state.partial_sums(found, tries, state.clusters_of(g)).filter("uses != 0 or total != 0")


def test_state_of_steps_equals_counting_at_once_and_resumes(spark, tmp_path):
    g = _random_graph(spark)
    seen = []
    state.run(g, str(tmp_path), 1, lambda s, k: seen.append(k))
    got = state.run(g, str(tmp_path), 2, lambda s, k: seen.append(k))
    assert seen == [0, 1, 2]  # the first two steps were there already
    found, tries, sums = _at_once(g.select("h", "r", "t"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(got.found, found) and same(got.tries, tries) and same(got.sums, sums) and got.sums.count() > 20


def test_state_of_streamed_files_equals_counting_at_once(spark, tmp_path):
    g = _random_graph(spark)
    for k in range(2):
        g.filter(F.col("step") % 2 == k).select("h", "r", "t").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("h string, r string, t string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    state.run_files(source, f"{tmp_path}/state", f"{tmp_path}/checkpoint").awaitTermination()
    got = state.load(spark, f"{tmp_path}/state", 1)
    assert got is not None and state.load(spark, f"{tmp_path}/state", 2) is None
    sums = _at_once(g.select("h", "r", "t"))[2]
    assert sorted(map(str, got.sums.collect())) == sorted(map(str, sums.select(*got.sums.columns).collect()))
