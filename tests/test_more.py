import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import decoders, evaluate
from quern.operators.tree import Tree


def test_tree_clusters_and_deletes():
    rng = np.random.default_rng(0)
    centres = np.eye(3)
    tree = Tree()
    points = {i: centres[i % 3] + rng.normal(0, 0.05, 3) for i in range(30)}
    for i, p in points.items():
        tree.insert(i, p)
    flat = tree.flat(0.8)
    assert len(set(flat.values())) == 3 and all(flat[i] == flat[i % 3] for i in points)
    assert tree.root.n == 30 and np.allclose(tree.root.total, sum(points.values()))
    for i in range(0, 30, 3):
        tree.delete(i)
    assert len(set(tree.flat(0.8).values())) == 2 and tree.root.n == 20
    tree.insert(1, centres[0])
    assert tree.root.n == 20 and len(tree.flat(0.8)) == 20
    assert sum(label is not None for *_, label in tree.rows()) == 20 and len(tree.rows()) == 39


def test_decoders(spark):
    rng = np.random.default_rng(1)
    h, r, t = rng.normal(size=(3, 4, 8))
    core = rng.normal(size=(8, 8, 8))
    df = spark.createDataFrame([(i, *(x[i].tolist() for x in (h, r, t))) for i in range(4)], "i int, h array<double>, r array<double>, t array<double>")
    model = decoders.TuckER(core)
    got = [x.s for x in decoders.query_vectors(df, model).select("i", decoders.answer(F.col("vec"), F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-sum(h[i, a] * r[i, b] * core[b, a, c] * t[i, c] for a in range(8) for b in range(8) for c in range(8)))) for i in range(4)])
    filters, dense = rng.normal(size=(2, 3, 3)), rng.normal(size=(2 * 2 * 2, 8))
    conv = decoders.ConvE(2, filters, np.zeros(2), dense, np.zeros(8))
    image = np.vstack([h[0].reshape(2, 4), r[0].reshape(2, 4)])
    flat = [max(0, (image[i : i + 3, j : j + 3] * filters[n]).sum()) for n in range(2) for i in range(2) for j in range(2)]
    assert np.allclose(conv.vectors(h[:1], r[:1])[0], np.maximum(np.array(flat) @ dense, 0))


def test_bidirectional(spark):
    facts = spark.createDataFrame([("a", "r", "b")], "h string, r string, t string")
    asked = evaluate.both_directions(facts)
    scores = asked.select("q").crossJoin(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "e string, score double"))
    got = {r.dir: r.mrr for r in evaluate.bidirectional(scores, asked, facts).collect()}
    assert got == {"tail": 1.0, "head": pytest.approx(1 / 2.5, abs=1e-6), None: pytest.approx(0.7, abs=1e-6)}
    cases = evaluate.error_cases(scores, asked).collect()
    assert [(c.h, c.t, c["rank"], c.top1) for c in cases] == [("b", "a", 2, "b")]


def test_reports(spark):
    full = spark.createDataFrame([("d", 0.5)], "dataset string, mrr double")
    other = spark.createDataFrame([("d", "x", 0.4)], "dataset string, variant string, mrr double")
    assert evaluate.ablation(full, other).first().change == -20
    assert tuple(evaluate.seed_study(spark.createDataFrame([(1.0,), (3.0,)], "mrr double"), ["mrr"]).first()) == (2.0, 1.0)
    p = spark.createDataFrame([(["a", "b", "c"], "r/s_inv")], "nodes array<string>, program string")
    assert p.select(evaluate.printed_path()).first()[0] == "a -r-> b <-s- c"


def test_leaderboard(spark):
    rows = spark.createDataFrame([("a", 1, 0.2), ("b", 2, 0.9), ("c", 3, 0.2)], "name string, size int, mrr double")
    assert [r.name for r in evaluate.leaderboard(rows).collect()] == ["b", "a", "c"]


def test_two_hops_are_formed_once_for_a_head(spark):
    # random multigraph with loops and inverses, so that queries mask edges of either hop; no row of a query is shuffled before its best entities are known
    import math
    import random

    from quern.operators.search import beam, relation_first

    rng = random.Random(5)
    edges = {(f"a{rng.randrange(9)}", rng.choice(["x", "x_inv", "y", "z"]), f"a{rng.randrange(9)}") for _ in range(120)}
    asked = rng.sample(sorted(edges), 60) + [("a0", "y", "a0"), ("nobody", "y", "a1")]
    log_p = {}
    for h, r, t in edges:
        log_p[h, r, t] = -math.log(len({b for a, b, _ in edges if a == h})) - math.log(sum((a, b) == (h, r) for a, b, _ in edges))
    expect, width = set(), 4
    for h, r, t in asked:
        inverse = r[:-4] if r.endswith("_inv") else r + "_inv"
        open_edges = {k: v for k, v in log_p.items() if k not in ((h, r, t), (t, inverse, h))}
        first = sorted((-round(v, 9), f"{k[1]}:{k[2]}", k[2], v) for k, v in open_edges.items() if k[0] == h)[:width]
        best = {}
        for _, path, e, v in first:
            for k, w in open_edges.items():
                if k[0] == e:
                    best[k[2]] = min(best.get(k[2], (9.0, "")), (-round(v + w, 9), f"{path}/{k[1]}:{k[2]}"))
        expect |= {(f"{h}|{r}|{t}", e, path, round(-s, 6), i) for i, (s, e, path) in enumerate(sorted((s, e, p) for e, (s, p) in best.items())[:width], 1)}
    q = spark.createDataFrame([(f"{h}|{r}|{t}", h, r, t) for h, r, t in asked], "q string, h string, r string, t string")
    got = beam(q, relation_first(spark.createDataFrame(sorted(edges), "h string, r string, t string")), 2, width)
    assert {(x.q, x.e, x.path, round(x.score, 6), x["rank"]) for x in got.collect()} == expect and len(expect) > 150
    assert "hashpartitioning(q" not in got._jdf.queryExecution().executedPlan().toString()


def test_only_facts_whose_first_draw_is_known_take_more_tries(spark, monkeypatch):
    from hashlib import md5

    from quern.operators import negatives as ng

    sizes = []
    plain = ng.materialize
    monkeypatch.setattr(ng, "materialize", lambda df, tag="table": (out := plain(df, tag), sizes.append(out.count()))[0])
    known = [(f"e{i}", f"r{j}", f"e{k}") for i in range(5) for j in range(3) for k in range(5) if (i + 2 * j + k) % 4]
    facts = [(*f, ("head", "tail", "relation")[n % 3]) for n, f in enumerate(known)]
    names, relations = [(f"e{i}", i) for i in range(5)], [(f"r{i}", i) for i in range(3)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = ng.corrupted(frame(facts + facts[:9], "h string, r string, t string, side string"), frame(names, "name string, id long"), frame(relations, "name string, id long"), frame(known + known[:9], "h string, r string, t string")).collect()
    expect = set()
    for h, r, t, side in facts:
        for k in range(1, 6):
            i = int(md5(f"neg|{k}|{h}|{r}|{t}".encode()).hexdigest()[:12], 16) % (3 if side == "relation" else 5)
            new = (f"e{i}" if side == "head" else h, f"r{i}" if side == "relation" else r, f"e{i}" if side == "tail" else t)
            if new not in known:
                expect.add((h, r, t, side, *new))
                break
    assert sorted(map(tuple, got)) == sorted(expect) and 0 < len(expect) < len(facts)
    assert sizes == [len(facts)]
