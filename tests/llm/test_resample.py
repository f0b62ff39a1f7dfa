"""Importance resampling against its definition, one text and one feature at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quern.llm import resample as rs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text, buckets):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected(docs, target, percent, least, buckets):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text)."""
    per = [Counter(buckets_of(t, buckets)) for _, t in docs]
    s, t = sum(per, Counter()), sum((Counter(buckets_of(x, buckets)) for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets)))) for b in s}
    out = []
    for (i, text), c in zip(docs, per, strict=True):
        weight = sum(gain[b] * n for b, n in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["the", "of", "Été", "naïve", "x1", "a-b", "don't", "日本語", "UPPER", "İ", *(f"w{i}" for i in range(300))]
    out = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 120)))) for _ in range(60)]
    long = " ".join(rng.choice(vocabulary, 40_000))
    return [*out, None, "", "  \n--", "one", "two words", "z" * 5000 + " next " + "y" * 70 + " q", long, out[0], out[0]]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_features_are_checksums_of_runs_of_words():
    some = [t or "" for t in texts()]
    raw = [t.encode() for t in some]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    crc, of, n = rs.features(np.frombuffer(b"".join(raw), np.uint8), off)
    for k, t in enumerate(some):
        w = words_of(t)
        assert n[k] == len(w)
        assert sorted(crc[of == k].tolist()) == sorted(zlib.crc32(" ".join(w[i : i + m]).encode()) for m in (1, 2, 3) for i in range(len(w) - m + 1))


def test_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(rs, "TASKS_A_SALT", 1)  # several salts
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts())] + [(3, texts()[3])]
    target = ["the of w1 w2 w3 w4", "日本語 Été of the w1 w2", None, "", "w7 " * 200]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, uid string, range int").repartition(5)
    for percent in (5, 40):
        got = rs.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
        assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
        assert collected(got) == expected(rows, target, percent, 20, 10_000)


def test_few_buckets_and_equal_scores(spark):
    rows = [(5, "a b c " * 10)] * 4 + [(6, "a b")]
    got = rs.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string"), percent=50, buckets=7)
    assert collected(got) == expected(rows, ["a b"], 50, 20, 7)


def test_no_documents_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    aim = spark.createDataFrame([("a b c",)], "text string")
    assert rs.resample(none, aim).collect() == []
    rows = [(i, t) for i, t in enumerate(texts()[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(rs.resample(docs, aim.filter("false"), percent=20)) == expected(rows, [], 20, 20, 10_000)


def test_query_over_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{d}/benchmark.parquet").select("text").collect()]
    got = rs.op11_importance_resampling(spark, d)
    assert collected(got) == expected(docs, target, 5, 20, 10_000)
    assert got.filter(F.col("rank").isNotNull()).count() == 5 * sum(len(words_of(t)) >= 20 for _, t in docs) // 100
