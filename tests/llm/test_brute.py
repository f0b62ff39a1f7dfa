"""Operators for training text against plain versions of the same definitions."""

import hashlib
import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontaminate, fingerprint, lm, packing, quality, secrets, toxicity
from quern.llm import text as tx

SEP = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(21)
    vocabulary = ["word%d" % i for i in range(80)] + ["Été.", "naïve!", "don't", "a.b?", "x1y2", "!!", "end.\n"]
    out = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 90)))) for _ in range(40)]
    return [*out, None, "", "  \n ", "one", "long " * 20_000, out[0], out[1] + " tail"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s%d" % (i % 4)) for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)


def test_toxicity_is_the_noisy_or_of_sentences(docs, texts):
    bits = 12
    rng = np.random.default_rng(1)
    model = toxicity.Model(bits, rng.normal(0, 0.5, 1 << bits).astype(np.float32), -2.0)

    def bucket(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return int(tx.Words(data, np.array([0, len(data)]), np.zeros(256, bool)).hashes[0] >> np.uint64(64 - bits))

    def sentences(text):
        # words are runs of letters, digits and what isn't ASCII; . ! ? and line ends close a sentence, as do LONGEST words
        out, now = [], []
        for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+|[.!?\n]", text or ""):
            if m[0] in ".!?\n":
                out.append(now)
                now = []
            else:
                now.append(m[0])
        return [s[k : k + toxicity.LONGEST] for s in [*out, now] for k in range(0, len(s), toxicity.LONGEST)]

    for r in toxicity.score(docs, model).collect():
        p = [1 / (1 + math.exp(-(sum(float(model.weights[bucket(w)]) for w in s) + model.bias))) for s in sentences(texts[r.doc_id])]
        none = math.prod(1 - min(x, 1 - 1e-12) for x in p)
        assert r.score == pytest.approx(1 - none, abs=1e-6)
        assert len(r.sentences) == sum(x >= 0.5 for x in p)


def test_toxicity_is_trained_by_the_likelihood_of_documents():
    # the same steps word by word, with the derivative of each document's log-likelihood taken numerically
    docs = [(1, [[3], [5, 5], [7]]), (0, [[5], [7, 2]]), (1, [[3, 7]]), (0, [[2], [5]])]
    size, rate, sparse, shrink = 16, 2.0, 0.1, 0.1
    rows = []
    for y, bag in docs:
        words = [w for s in bag for w in s]
        distinct = sorted(set(words))
        rows.append((y, np.array(distinct, np.int32).tobytes(), np.array([distinct.index(w) for w in words], np.uint16).tobytes(), np.array([len(s) for s in bag], np.uint8).tobytes()))
    model = toxicity.train(rows, 4, epochs=5, rate=rate, sparse=sparse, shrink=shrink, rare=1)

    def likelihood(logits, y):
        none = math.prod(1 - 1 / (1 + math.exp(-x)) for x in logits)
        return math.log(1 - none if y else none)

    rng = np.random.default_rng(7)
    w, z, n, bias, seen = [0.0] * size, [0.0] * size, [0.0] * size, -6.0, 1.0
    for _ in range(5):
        for i in rng.permutation(4):
            y, bag = docs[i]
            logits = [sum(w[x] for x in s) + bias for s in bag]
            up = []
            for k in range(len(bag)):
                lift = lambda d, k=k: [x + (d if j == k else 0) for j, x in enumerate(logits)]
                up.append((likelihood(lift(1e-5), y) - likelihood(lift(-1e-5), y)) / 2e-5)
            for f in {x for s in bag for x in s}:
                g = -sum(u * s.count(f) for u, s in zip(up, bag, strict=True))
                more = n[f] + g * g
                z[f] += g - (math.sqrt(more) - math.sqrt(n[f])) / rate * w[f]
                n[f] = more
                w[f] = 0.0 if abs(z[f]) <= sparse else -(z[f] - math.copysign(sparse, z[f])) / ((1 + math.sqrt(more)) / rate + shrink)
            seen += sum(up) ** 2
            bias += 0.05 * sum(up) / math.sqrt(seen)
    assert model.weights.tolist() == pytest.approx(w, abs=1e-3) and model.bias == pytest.approx(bias, abs=1e-3) and max(map(abs, w)) > 0.3


def test_quality_is_the_softmax_of_averaged_vectors(docs, texts):
    bits = 10
    rng = np.random.default_rng(2)
    model = quality.Model(bits, rng.normal(0, 3, 1 << bits).astype(np.float32), 0.3)

    def features(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        out = [int(h >> np.uint64(64 - bits)) for h in tx.Words(raw, np.array([0, len(raw)])).hashes] if len(raw) else []
        return out + [int(g) for n in quality.SIZES for k in range(len(raw) - n + 1) for g in quality._grams(raw[k : k + n], n, bits)]

    for r in quality.score(docs.filter("length(text) < 2000 or text is null"), model).collect():
        f = features(texts[r.doc_id])
        z = (sum(float(model.gain[x]) for x in f) / len(f) if f else 0) + model.bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_quality_learns_what_is_held_out(spark):
    rng = np.random.default_rng(6)
    good, bad = ["plain", "clear", "steady", "measured"], ["zzq", "xkcdx", "qqq!", "###"]
    text = lambda y: " ".join(rng.choice((good if y else bad) + ["the", "of", "and"], 30))
    data = [(i, text(i % 2), i % 2) for i in range(400)]
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    import zlib

    held = [r for r in quality.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([(r.score >= 0.7) == bool(r.doc_id % 2) for r in held]) >= 0.98


def _marginal(v, weights, word):
    """All segmentations of a word, one by one: the sum of the products of their pieces' weights."""
    by_key = dict(zip(v.keys.tolist(), weights.tolist(), strict=True))
    s = np.frombuffer(bytes([lm._MARK]) + word.encode(), np.uint8)
    piece = {(i, j): by_key.get(int(lm._spans(s, np.array([i]), np.array([j]))[0])) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}

    def every(i):
        if i == len(s):
            yield []
        for j in range(i + 1, len(s) + 1):
            if piece[i, j] is not None:
                for rest in every(j):
                    yield [piece[i, j], *rest]

    return sum(math.exp(sum(x)) * (1 - lm.STOP) ** (len(x) - 1) * lm.STOP for x in every(0))


def test_documents_are_scored_by_all_their_segmentations(spark):
    rows = [(0, "the cat Sat"), (1, "naïve ox"), (2, None), (3, ""), (4, "the the zq"), (5, "x\tthe")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    train = F.col("doc_id") < 4
    got = {r.doc_id: r for r in lm.score(docs, train).collect()}
    v = lm.pieces(lm.vocabulary_path())
    words = lambda t: re.findall(SEP, (t or "").translate(LOWER))
    counts, n = np.zeros(len(v.prior)), 0
    for i, t in rows[:4]:
        n += len(words(t)) + 1
        for w in words(t):
            for k in v.model.encode(w):
                counts[k] += 1
    p = 0.5 * v.prior + 0.5 * counts / counts.sum()
    weights = np.log(np.maximum(p, 1e-12))[v.ids]
    stop = (4 + 1) / (n + 2)
    for i, t in rows:
        expect = math.log10(stop) + sum(math.log10(_marginal(v, weights, w)) + math.log10(1 - stop) for w in words(t))
        assert got[i].score == pytest.approx(expect, abs=1e-6) and got[i].train_tokens == n


def test_training_words_are_pieces_too(spark):
    # with words a training word is one edge more of its lattice, whether its count is broadcast or joined; scores stay near the base's
    rows = [(0, "thrwok the Sat thrwok"), (1, "the zlarbix ox"), (2, None), (3, ""), (4, "the thrwok zq"), (5, "x\tthe " + "thrwok zlarbix " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    train = F.col("doc_id") < 4
    words = lambda t: re.findall(SEP, (t or "").translate(LOWER))
    seen = Counter(w for _, t in rows[:4] for w in words(t))
    v = lm.pieces(lm.vocabulary_path())
    counts = np.zeros(len(v.prior))
    for w, c in seen.items():
        for k in v.model.encode(w):
            counts[k] += c
    weights = v.placed(counts)
    assert np.exp(weights)[v.begins].sum() == pytest.approx(1) and np.exp(weights)[~v.begins].sum() == pytest.approx(1)
    n, once, twice = sum(seen.values()), sum(c == 1 for c in seen.values()), sum(c == 2 for c in seen.values())
    less, stop = once / (once + 2 * twice), (4 + 1) / (n + 4 + 2)
    p = {w: max(seen[w] - less, 0) / n + less * len(seen) / n * _marginal(v, weights, w) for _, t in rows for w in words(t)}
    got = {r.doc_id: r for r in lm.score(docs, train, words=True).collect()}
    for i, t in rows:
        assert got[i].score == pytest.approx(math.log10(stop) + sum(math.log10(p[w]) + math.log10(1 - stop) for w in words(t)), abs=1e-6)
    assert got[5].score > lm.score(docs, train).filter("doc_id = 5").first().score + 10
    assert abs(got[0].score - got[0].base_score) < 3
    joined = {r.doc_id: r.score for r in lm.score(docs, train, frequent=1, words=True).collect()}
    assert joined == pytest.approx({i: r.score for i, r in got.items()})
    assert lm.score(docs, F.lit(False), words=True).filter("score < 0 and not isnan(score) and score > -1e6").count() == len(rows)


def test_rare_words_are_joined(spark, docs, texts):
    # with next to no counts broadcast, all others come by the join; results are the same
    train = F.col("doc_id") % 3 != 0
    key = lambda rows: sorted((r.doc_id, r.n_known, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    assert key(lm.score(docs, train, frequent=2).collect()) == key(lm.score(docs, train).collect())


def _anchors(text, k=fingerprint.K, s=fingerprint.S):
    """Closed syncmers by definition, with the engine's 64-bit hash of UTF-32 bytes."""
    raw = text.encode("utf-32-be")
    raw = raw if text else b""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = lambda b, seed=42: signed(xxhash.xxh64(b, seed=seed).intdigest())
    if not text:
        return []
    if len(text) < k:
        return [(0, h(raw))]
    out = []
    for i in range(len(text) - k + 1):
        inner = [h(raw[4 * (i + j) : 4 * (i + j + s)]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            first = h(struct.pack("<q", inner[0]))
            out.append((i, h(struct.pack("<q", inner[-1]), first % (1 << 64))))
    return out


def test_fingerprints_by_definition(spark, tmp_path, texts):
    rows = [(i * 7, t) for i, t in enumerate(texts) if t is None or len(t) < 1500] + [(2, "ﬀ😀 é" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op9_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, other, then = _anchors(t), _anchors(edited), _anchors(after)
        r = got[i]
        assert list(zip(r.fingerprint.pos, r.fingerprint.hash, strict=True)) == own
        assert list(zip(r.edited_fingerprint.pos, r.edited_fingerprint.hash, strict=True)) == other
        hashes = [{h for _, h in x} for x in (own, other, then)]
        assert r.near_edited == pytest.approx(alike(hashes[0], hashes[1])) and r.near_next == pytest.approx(alike(hashes[0], hashes[2]))


@pytest.mark.parametrize("step", [1, 1000, 10**12])
def test_next_documents_of_sparse_ids(spark, step):
    ids = [int(x) * step for x in np.random.default_rng(8).permutation(150)] + [None]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, ["text"], width=4, most=10).collect()}
    order = [None, *sorted(i for i in ids if i is not None)]
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_equal_plain_expressions(spark, tmp_path):
    rng = np.random.default_rng(17)
    bits = ["token", "Password", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGH1234", "0123456789ab", "deadbeefdeadbeef", "é", "😀", "\n", "x", "secret", "abc123", "/+.-"]
    rows = [(i, "".join(rng.choice(bits, int(rng.integers(0, 60))))) for i in range(800)] + [(900, None), (901, ""), (902, "token=abcdef " * 700 + "é")]
    spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secrets.op10_secrets(spark, str(tmp_path)).collect()}
    for i, t in rows:
        base = _base(t or "")
        n = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (i, t)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (n["assign"], n["access"], n["hex"])
    assert got[902].n_assign == 700


def test_places_of_many_parts(spark):
    rng = np.random.default_rng(3)
    data = [[int(x) for x in rng.integers(0, 9, n)] for n in (1, 2, 127, 128, 129, 1000, 20_000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x array<int>").select("i", secrets._places(F.col("x")).alias("p")).collect()
    assert {r.i: r.p for r in got} == {i: [0, *np.cumsum(x)[:-1].tolist()] for i, x in enumerate(data)}


@pytest.mark.parametrize(("share", "least"), [(0.1, 0.99), (0.2, 0.97), (0.3, 0.9)])
def test_recall_of_edited_items(spark, share, least):
    rng = np.random.default_rng(int(share * 100))
    vocabulary = ["b%d" % i for i in range(3000)]
    items = [" ".join(rng.choice(vocabulary, int(rng.integers(15, 45)))) for _ in range(200)]
    edited = [" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in t.split()) for t in items]
    other = lambda: " ".join(rng.choice(vocabulary, 60))
    docs = spark.createDataFrame([(i, f"{other()} {t} {other()}") for i, t in enumerate(edited)] + [(1000 + i, other()) for i in range(200)], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len([1 for i in range(200) if (i, i) in got]) >= least * 200 and all(d == i for d, i in got)


def test_items_in_blocks_of_bytes(spark, docs, texts):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t and len(t) < 900] + [(None, texts[3])], "item_id long, text string")
    key = lambda df: sorted(map(str, df.collect()))
    whole = decontaminate.contaminated(docs, bench)
    assert key(decontaminate.contaminated(docs, bench, block=2000)) == key(whole) and whole.filter("item_id is null").count() >= 1
    rows = decontaminate.matched(docs.withColumn("matches", F.lit("x")).withColumn("matches_0", F.lit("y")), bench, block=2000)
    assert rows.columns == ["doc_id", "text", "source", "matches_0", "matches"] and rows.count() == len(texts)
    assert rows.agg(F.sum(F.size("matches"))).first()[0] == whole.count()


def test_packing_keeps_columns_of_any_name(spark):
    parts = spark.createDataFrame([(i, 0, 1 + i % 7, "a%d" % i, 9, 8, 7, 6) for i in range(60)], "doc_id long, piece int, length long, rank string, salt int, before int, at int, part int")
    got = packing.pack(parts, 8).collect()
    assert {(r.doc_id, r.rank, r.salt, r.before, r.at, r.part) for r in got} == {(i, "a%d" % i, 9, 8, 7, 6) for i in range(60)}
    assert sum(r.length for r in got) <= 8 * len({r.sequence_id for r in got})


def test_document_capacity_binds_without_more_sequences():
    counts = Counter(np.random.default_rng(5).integers(1, 64, 3000).tolist())
    steps, most = packing.tightest(counts, 64, 64 * 64, packing.WEIGHTS, "norm")
    free = packing.plan(counts, 64, 64, 64 * 64, (1.0, 0.0, 0.0), "norm")
    assert packing.sequences(steps, counts) == packing.sequences(packing.plan(counts, 64, 64, 64 * 64, packing.WEIGHTS, "norm"), counts) <= packing.sequences(free, counts) + 1
    assert most < 64 and steps.tolist() != free.tolist()
