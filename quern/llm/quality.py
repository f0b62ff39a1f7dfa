"""Operator 5: quality by supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character n-grams, followed by a linear
layer and a softmax over two classes; both are trained by stochastic gradient descent in numpy. Averaging and
the layer are linear, so for scoring each vector is reduced to one number beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import text as tx
from quern.llm.labelled import collected, fold, numbers, sample, smallest
from quern.llm.labelled import weights as shares
from quern.llm.shared import documents

#: Random multipliers of bytes: case is kept, unlike in word hashes elsewhere.
_C = np.random.default_rng(5).integers(1, 2**32, 8, dtype=np.uint32) | np.uint32(1)
SIZES = (2, 3, 4)


@dataclass
class Model:
    bits: int
    gain: np.ndarray  # by bucket: difference of the two classes' logits
    bias: float


def _grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n bytes from each byte; the last n - 1 have none."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    h = np.full(len(data) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h += data[i : len(data) - n + 1 + i] * _C[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def _all(data: np.ndarray, off: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature: buckets in order of place, and for each text the first of its own (with the end as last entry). Character n-grams don't cross texts."""
    w = tx.Words(data, off)
    yield (w.hashes >> np.uint64(64 - bits)).astype(np.int64), w.first
    for n in SIZES:
        g = _grams(data, n, bits)
        # those that start in a text's last n - 1 bytes would reach into the next one
        inside = np.ones(len(g), bool)
        for k in range(1, n):
            at = off[1:] - k
            inside[at[(at >= 0) & (at < len(g))]] = False
        count = np.concatenate([[0], np.cumsum(inside)])
        yield g[inside], count[np.minimum(off, len(g))]


def _features(docs: DataFrame, bits: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lo, hi, data, off in tx.chunks(batch.column(1)):
                kinds = list(_all(data, off, bits))
                flat, counts = [], []
                for i in range(hi - lo):
                    f, c = np.unique(np.concatenate([g[e[i] : e[i + 1]] for g, e in kinds]), return_counts=True)
                    flat.append(f.astype(np.int32).tobytes())
                    counts.append(smallest(c))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, hi - lo), batch.column(2).slice(at, hi - lo), pa.array(flat, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "label", "buckets", "counts"])
                at += hi - lo

    return docs.select("doc_id", "text", "label").mapInArrow(rows, "doc_id long, label int, buckets binary, counts binary")


def train(rows: list[tuple[int, memoryview, memoryview]], bits: int, dim: int = 8, epochs: int = 12, rate: float = 1.0, weigh: tuple[float, float] = (1.0, 1.0)) -> Model:
    """rows: (label, distinct buckets, their counts) by document, as _features has them; weigh: what documents of labels 0 and 1 weigh."""
    rng = np.random.default_rng(11)
    positive = sum(r[0] for r in rows)
    if not rows or positive in (0, len(rows)):
        return Model(bits, np.zeros(1 << bits, np.float32), (8.0 if positive else -8.0) if rows else 0.0)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, f, c = rows[i]
            lr = rate * (1 - steps / total)
            steps += 1
            if not len(f):
                continue
            f = np.frombuffer(f, np.int32)
            c = numbers(c, len(f)).astype(np.float32)
            share = c / c.sum()
            mean = share @ vectors[f]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= np.float32(weigh[label])
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            vectors[f] -= lr * 50 * np.outer(share, back)
    return Model(bits, (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, most: tuple[int, int] = (1500, 3000), bits: int = 18) -> Model:
    """Learns from whole texts of at most `most` documents of either label outside the held-out fold, weighted for the classes' shares among all of them.

    Without two classes the model answers the one it saw, or even odds. Null and empty texts teach nothing; repeated rows count each.
    """
    weigh = shares(labels, label, parts, held, most)
    with collected(_features(sample(docs, labels, label, parts, held, most), bits)) as rows:
        return train(rows, bits, weigh=weigh)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score, the softmax's second class for the whole text, however long. A null or empty text has the bias alone.

    Repeated rows get equal scores, no rows give no rows. Other columns stay; one named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]
    place = keep.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = 0
            for lo, hi, data, off in tx.chunks(batch.column(place)):
                total, count = np.zeros(hi - lo), np.zeros(hi - lo)
                for g, first in _all(data, off, m.bits):
                    run = np.concatenate([[0], np.cumsum(m.gain[g], dtype=np.float64)])
                    total += run[first[1:]] - run[first[:-1]]
                    count += np.diff(first)
                z = np.clip(total / np.maximum(count, 1) + m.bias, -30, 30)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, hi - lo) for c in batch.columns), pa.array(np.round(1 / (1 + np.exp(-z)), 9))], [*keep, "score"])
                at += hi - lo

    return docs.select(*keep).mapInArrow(rows, docs.select(*keep).schema.add("score", "double"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
