"""Operator 3: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its hashed words; a document's is the
noisy-or of its sentences' scores. Only documents are labelled: the gradient of the noisy-or decides which
sentences take the blame, and the same sentence scores then locate what is offending.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import text as tx
from quern.llm.labelled import collected, fold, numbers, sample, smallest
from quern.llm.labelled import weights as shares
from quern.llm.shared import documents

_APART = np.zeros(256, bool)
_APART[:128] = [not chr(i).isalnum() for i in range(128)]
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
#: Words of a sentence; longer ones count as several.
LONGEST = 24


@dataclass
class Model:
    bits: int
    weights: np.ndarray
    bias: float


class Sentences:
    """Of a chunk of texts: each word's bucket and sentence; each sentence's first byte, last byte and text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, bits: int):
        w = tx.Words(data, off, _APART)
        self.buckets = (w.hashes >> np.uint64(64 - bits)).astype(np.int64)
        stop = np.concatenate([[0], np.cumsum(_STOP[data])])
        doc = np.repeat(np.arange(len(off) - 1), np.diff(w.first))
        key = stop[w.starts] + doc  # more after every end of a sentence or text
        new = np.diff(key, prepend=-1) != 0 if len(key) else np.zeros(0, bool)
        run = np.flatnonzero(new)
        new |= (np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))) % LONGEST == 0
        self.of = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.doc = doc[at]
        self.first = w.starts[at]
        self.last = w.ends[np.append(at[1:], len(key)) - 1] if len(at) else w.starts[:0]
        self.starts = at


def _features(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, label and, as bytes, the document's distinct buckets (32 bits), each word's number among them (labelled.smallest) and each sentence's number of words (8 bits)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lo, hi, data, off in tx.chunks(batch.column(1)):
                s = Sentences(data, off, bits)
                length = np.diff(np.append(s.starts, len(s.of))).astype(np.uint8)
                word_doc = s.doc[s.of] if len(s.of) else s.of
                ends = np.searchsorted(word_doc, np.arange(hi - lo + 1))
                first = np.searchsorted(s.doc, np.arange(hi - lo + 1))
                lists: list[list[bytes]] = [[], [], []]
                for i in range(hi - lo):
                    distinct, back = np.unique(s.buckets[ends[i] : ends[i + 1]], return_inverse=True)
                    for x, v in zip(lists, (distinct.astype(np.int32).tobytes(), smallest(back), length[first[i] : first[i + 1]].tobytes()), strict=True):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, hi - lo), batch.column(2).slice(at, hi - lo), *(pa.array(x, pa.binary()) for x in lists)], ["doc_id", "label", "buckets", "words", "lengths"])
                at += hi - lo

    return docs.select("doc_id", "text", "label").mapInArrow(rows, "doc_id long, label int, buckets binary, words binary, lengths binary")


def train(rows: list[tuple[int, memoryview, memoryview, memoryview]], bits: int, epochs: int = 12, rate: float = 2.0, sparse: float = 1.0, shrink: float = 0.1, rare: int = 4, weigh: tuple[float, float] = (1.0, 1.0)) -> Model:
    """rows: (label, distinct buckets, words, sentences' lengths) by document, as _features has them; weigh: what documents of labels 0 and 1 weigh.

    Proximal stochastic gradient steps with a sparsity penalty (FTRL): words that few documents have, or that say little, weigh nothing.
    Besides the rows, memory is four arrays of 2**bits.
    """
    rng = np.random.default_rng(7)
    size = 1 << bits
    positive = sum(r[0] for r in rows)
    if positive in (0, len(rows)):
        return Model(bits, np.zeros(size, np.float32), 20.0 if positive else -20.0)
    weights, z, n, often = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size, np.int32)
    some = [r for r in rows if len(r[1])]
    for r in some:
        often[np.frombuffer(r[1], np.int32)] += 1
    bias, seen = -6.0, 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(some)):
            label, f, back, length = some[i]
            f, length = np.frombuffer(f, np.int32), np.frombuffer(length, np.uint8).astype(np.int64)
            back = numbers(back, int(length.sum()))
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[f][back], np.cumsum(length) - length) + bias, -30, 30)))
            none = np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
            up = p * (none / max(1 - none, 1e-6)) if label else -p  # derivative of the log-likelihood by each sentence's logit
            up = up * weigh[label]
            grad = -np.bincount(back, np.repeat(up, length)) * (often[f] >= rare)
            more = n[f] + grad * grad
            z[f] += grad - (np.sqrt(more) - np.sqrt(n[f])) / rate * weights[f]
            n[f] = more
            weights[f] = np.where(np.abs(z[f]) <= sparse, 0, -(z[f] - np.sign(z[f]) * sparse) / ((1 + np.sqrt(more)) / rate + shrink))
            total = up.sum()
            seen += total * total
            bias += 0.05 * total / np.sqrt(seen)
    return Model(bits, weights.astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0, most: tuple[int, int] = (6000, 3000), bits: int = 20) -> Model:
    """Learns from whole texts of at most `most` documents of labels 0 and 1 outside the held-out fold, weighted for the classes' shares among all of them.

    With one class or none the model answers that, or no. Null and empty texts teach nothing; repeated rows count each. A sentence ends at . ! ? or a
    line's end, and after LONGEST words.
    """
    weigh = shares(labels, label, parts, held, most)
    with collected(_features(sample(docs, labels, label, parts, held, most), bits)) as rows:
        return train(rows, bits, weigh=weigh)


def score(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """Adds score (noisy-or over the whole text's sentences) and sentences, those of a score of `offending` or more: start, end (code points), score.

    Texts of any length are scored whole. A null or empty text, or one without words, has score 0 and no sentences. Repeated rows get equal
    scores, no rows give no rows; other columns stay, but for ones named score or sentences, which are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("score", "sentences")]
    schema = docs.select(*keep).schema.add("score", "double").add("sentences", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("score", "double")))
    place = keep.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            at = 0
            for lo, hi, data, off in tx.chunks(batch.column(place)):
                s = Sentences(data, off, m.bits)
                n = hi - lo
                z = np.add.reduceat(m.weights[s.buckets].astype(np.float64), s.starts) + m.bias if len(s.starts) else np.zeros(0)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                total = -np.expm1(np.bincount(s.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)[:n]) if len(p) else np.zeros(n)
                bad = np.flatnonzero(p >= offending)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = points[off[s.doc[bad]]]
                spans = pa.StructArray.from_arrays([pa.array(points[s.first[bad]] - base, pa.int32()), pa.array(points[s.last[bad]] - base, pa.int32()), pa.array(p[bad])], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(s.doc[bad], np.arange(n + 1)), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in batch.columns), pa.array(np.clip(total, 0, 1)), lists], [*keep, "score", "sentences"])
                at += n

    return docs.select(*keep).mapInArrow(rows, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").cast("long").alias("n_offending"), F.transform("sentences", lambda s: F.concat_ws(":", s["start"], s["end"])).alias("offending"),
    )
