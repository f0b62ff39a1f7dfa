"""Queries over whole tables against brute force, on small star-schema tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.plans import testgraph
from quern.plans.queries import WIDTH, _leak_free
from quern.plans.registry import QUERIES


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("star"))
    rng = np.random.default_rng(5)
    at = lambda n: int(rng.integers(1, n + 1))
    tables = {
        "nation": ("n_nationkey long, n_regionkey long", [(i, i % 3) for i in range(1, 7)]),
        "customer": ("c_custkey long, c_nationkey long", [(i, at(6)) for i in range(1, 25)]),
        "supplier": ("s_suppkey long, s_nationkey long", [(i, at(6)) for i in range(1, 25)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderpriority string", [(i, at(24), "%d-P" % (i % 2)) for i in range(1, 40)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string", [(at(39), at(12), at(24), "AN"[i % 2]) for i in range(120)]),
        "embeddings": ("vec_id long, label int, embedding array<float>", [(i, i % 4, rng.normal(size=64).tolist()) for i in [*range(12), 100]]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def facts(spark, d, typed=False):
    out = defaultdict(list)
    for r in testgraph.graph(spark, d, typed).collect():
        out[r.split].append((r.h, r.r, r.t))
    assert len({r for _, r, _ in out["test"]}) > 4
    return out


def both(rows):
    return [*rows, *((t, f"{r}_inv", h) for h, r, t in rows)]


def popularity(f):
    pop = defaultdict(Counter)
    for _, r, t in both(f["train"]):
        pop[r][t] += 1
    known = set(both([x for split in f.values() for x in split]))
    ranks = {}
    for h, r, t in both(f["test"]):
        live = [s for e, s in pop[r].items() if e == t or (h, r, e) not in known]
        s = pop[r].get(t)
        ranks[h, r, t] = None if s is None else sum(x > s for x in live) + (sum(x == s for x in live) + 1) / 2
    return pop, ranks


def metrics(ranks):
    found = [x for x in ranks if x is not None]
    return len(ranks), round(sum(1 / x for x in found) / len(ranks), 6), round(sum(found) / len(found), 6) if found else None, *(round(sum(x <= k for x in found) / len(ranks), 6) for k in (1, 3, 10))


def test_metrics_of_all_relations(spark, data):
    f = facts(spark, data)
    _, ranks = popularity(f)
    judged = lambda name, key: {r[key]: pytest.approx(tuple(r[c] for c in ("n", "mrr", "mean_rank", "hits1", "hits3", "hits10")), abs=2e-6) for r in QUERIES[name](spark, data).collect()}
    groups = {None: list(ranks.values()), "tail": [x for k, x in ranks.items() if not k[1].endswith("_inv")], "head": [x for k, x in ranks.items() if k[1].endswith("_inv")]}
    assert judged("m01_bidirectional_metrics", "dir") == {k: metrics(v) for k, v in groups.items()}
    seen = {(h, r) for h, r, _ in both(f["train"])}
    strata = {s: [x for k, x in ranks.items() if (k[:2] in seen) == (s == "seen")] for s in ("seen", "unseen")}
    assert judged("m05_seen_and_unseen_metrics", "stratum") == {k: metrics(v) for k, v in strata.items() if v}


def test_error_cases_of_all_relations(spark, data):
    f = facts(spark, data)
    pop, ranks = popularity(f)
    expect = set()
    for h, r, t in ranks:
        order = sorted(pop[r].items(), key=lambda x: (-x[1], x[0]))
        if t in pop[r] and (better := sum(s > pop[r][t] for s in pop[r].values())):
            expect.add((f"{h}|{r}|{t}", h, r, t, better + 1, pop[r][t], *order[0], ";".join(e for e, _ in order[:10])))
    got = [tuple(r) for r in QUERIES["k05_error_cases"](spark, data).collect()]
    assert set(got) == expect and len(got) == len(expect) > 20


def test_leak_free_of_all_relations(spark, data):
    f = facts(spark, data)
    edges = [*f["train"], *f["test"]]
    expect = Counter(("|".join(q), *e) for q in f["test"] for e in edges for at in {q[0], q[2]} if e[0] == at and e != q and e != (q[2], f"{q[1]}_inv", q[0]))
    assert Counter(tuple(r) for r in _leak_free(spark, data).select("q", "h", "r", "t").collect()) == expect


def test_neighbours_of_all_relations(spark, data):
    f = facts(spark, data, typed=True)
    sig = defaultdict(set)
    for h, r, _ in f["train"]:
        sig[h].add(r)
    expect = set()
    for h, r in {x[:2] for x in f["test"]}:
        near = sorted((-round(len(sig[h] & sig[e]) / math.sqrt(len(sig[h]) * len(sig[e])), 9), e) for e in sig if h in sig and e != h and r in sig[e] and sig[h] & sig[e])
        expect |= {(h, r, e, round(-s, 6), k) for k, (s, e) in enumerate(near[:5], 1)}
    assert {tuple(r) for r in QUERIES["r08_neighbours"](spark, data).collect()} == expect and len({x[1] for x in expect}) > 4


def test_beam_search_of_all_relations(spark, data):
    f = facts(spark, data)
    out = defaultdict(list)
    for split in f.values():
        for h, r, t in split:
            out[h].append((r, t))
    expect = set()
    for h, r, t in f["test"]:
        hide = lambda a, s, b: (a, s, b) in ((h, r, t), (t, f"{r}_inv", h))  # noqa: E731,B023
        now = [(0.0, "", h)]
        for step in range(2):
            now = [(s - math.log(len(out[e])), f"{p}/{x}:{y}" if p else f"{x}:{y}", y) for s, p, e in now for x, y in out[e] if not hide(e, x, y)]
            now = now if step else sorted(now, key=lambda x: (-round(x[0], 9), x[1]))[:WIDTH]
        best = {}
        for s, p, e in now:
            best[e] = min(best.get(e, (9e9, "")), (-round(s, 9), p))
        for k, (s, e, p) in enumerate(sorted((s, e, p) for e, (s, p) in best.items())[:WIDTH], 1):
            expect.add(("|".join((h, r, t)), e, p, round(-s, 6), k))
    got = {tuple(r) for r in QUERIES["g11_beam_search"](spark, data).collect()}
    assert {x[:3] + x[4:] for x in got} == {x[:3] + x[4:] for x in expect} and len(expect) > 20
    score = {x[:2]: x[3] for x in expect}
    assert all(x[3] == pytest.approx(score[x[:2]], abs=2e-6) for x in got)


@pytest.mark.parametrize("name", ["e01_transe_l1", "e02_transe_l2", "e03_distmult", "e04_complex", "e05_rotate", "e09_ensemble"])
def test_scorers_of_all_labels(spark, data, name):
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    z = lambda x: x[:32] + 1j * x[32:]

    def rotate(h, r, t):
        x = z(h) * np.exp(1j * r[:32] / (11 / 32 / np.pi)) - z(t)
        return 9 - np.sum(np.abs(x.real) + np.abs(x.imag))

    l2, dist = lambda h, r, t: sigmoid(-np.linalg.norm(h + r - t)), lambda h, r, t: sigmoid(np.sum(h * r * t))
    by = {
        "e01": lambda h, r, t: 40 - np.sum(np.abs(h + r - t)), "e02": l2, "e03": dist, "e04": lambda h, r, t: sigmoid(np.sum((z(h) * z(r) * z(t).conj()).real)),
        "e05": rotate, "e09": lambda h, r, t: (l2(h, r, t) + dist(h, r, t)) / 2,
    }
    got = {(r.q, r.e): r.score for r in QUERIES[name](spark, data).collect()}
    best = {a: sorted((-round(by[name[:3]](v[a], v[a] / 2, x), 9), b) for b, x in v.items())[:10] for a in v if a % 100 == 0}
    assert got == {(a, b): pytest.approx(-s, abs=2e-6) for a, x in best.items() for s, b in x} and len(got) == 20


def test_circular_correlation_of_whole_vectors(spark, data):
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in QUERIES["e13_circular_correlation"](spark, data).orderBy("vec_id", "k").collect():
        got[r.vec_id].append(r.value)
    assert got == {k: pytest.approx([float(np.dot(x, np.roll(x, -i))) for i in range(64)], abs=2e-6) for k, x in v.items()}
