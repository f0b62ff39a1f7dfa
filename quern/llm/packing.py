"""Operator 2: best-fit packing of token sequences under several capacities.

Pieces with the same length are interchangeable, so the packing is planned on the histogram of lengths (at
most `size` rows) and on classes of bins with equal residuals: a step puts equal pieces into all bins of a
class at once. Each length leaves at most three more classes, so the plan's state is bounded by the sequence
size, whatever the corpus is. Pieces then find their place by length and rank, computed in parallel.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import text as tx
from quern.llm.shared import documents, materialize

CACHED = 1_500_000  # pieces of text whose ids a worker remembers


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ASCII classes: 0 white space, 1 digit, 2 letter, 3 other ASCII, 4 apostrophe and what isn't ASCII
_CLASS = np.full(256, 4, np.uint8)
_CLASS[:128] = 3
_CLASS[ord("'")] = 4
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[48:58] = 1
_CLASS[65:91] = _CLASS[97:123] = 2


class Encoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    The tokenizer never joins across white space, around an ASCII digit, or between an ASCII letter and ASCII
    punctuation (apostrophes apart), so a text is cut there and each distinct part is encoded once and remembered
    by its 64-bit hash. Texts that hold the start of a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # the same model on text that is lower-case ASCII already: no normalizer or splitting by pattern is needed
        self.plain = Tokenizer(models.BPE(vocab=vocab, merges=[tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]], end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.zero = vocab["0</w>"]
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, parts: list[bytes], kinds: np.ndarray) -> None:
        """kinds: 0 lower-case or punctuation only, 1 digit, 2 other."""
        n = np.zeros(len(parts), np.int64)
        flat = np.zeros(0, np.uint32)
        order = []
        for kind in (0, 1, 2):
            which = np.flatnonzero(kinds == kind)
            if not len(which):
                continue
            mine = [parts[i] for i in which.tolist()]
            if kind == 1:
                got = [np.array(e.ids, np.uint32) for e in self.full.encode_batch([p.decode() for p in mine], add_special_tokens=False)]
                counts, ids = np.array([len(x) for x in got]), np.concatenate(got)
            elif kind == 0:
                e = self.plain.encode_batch_fast([b" ".join(mine[i : i + 1000]).lower().decode() for i in range(0, len(mine), 1000)], add_special_tokens=False)
                ids = np.concatenate([np.array(x.ids, np.uint32) for x in e])
                ends = np.flatnonzero(self.last[ids]) + 1
                counts = np.diff(ends, prepend=0)
            else:
                e = self.full.encode_batch_fast([b" 0 ".join([*mine[i : i + 1000], b""]).decode() for i in range(0, len(mine), 1000)], add_special_tokens=False)
                ids = np.concatenate([np.array(x.ids, np.uint32) for x in e])
                stop = np.flatnonzero(ids == self.zero)
                counts = np.diff(stop, prepend=-1) - 1
                ids = ids[ids != self.zero]
            assert len(counts) == len(which)
            n[which] = counts
            order.append(which)
            flat = np.concatenate([flat, ids])
        order = np.concatenate(order)
        at = np.zeros(len(parts), np.int64)
        at[order] = np.concatenate([[0], np.cumsum(n[order])[:-1]])
        at += len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.n, where, n)

    def encode(self, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """For each text of a chunk (bytes and offsets), its ids."""
        kind = _CLASS[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        if len(data) > 1:
            a, b = kind[:-1], kind[1:]
            cut[1:-1] |= (a == 0) | (b == 0) | (a == 1) | (b == 1) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2))
        edges = np.flatnonzero(cut[:-1])
        keep = kind[edges] != 0 if len(edges) else np.zeros(0, bool)
        starts = edges[keep]
        ends = np.append(edges[1:], len(data))[keep] if len(edges) else starts
        first = np.searchsorted(starts, off)
        special = np.zeros(len(off) - 1, bool)
        bar = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if len(data) > 1 else np.zeros(0, np.int64)
        special[np.searchsorted(off, bar, "right") - 1] = True
        if len(starts):
            p, inverse = tx.powers(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(tx._VALUE[data] * p[: len(data)], out=total[1:])
            keys = tx.mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
            distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
            if len(self.keys) > CACHED:
                self.forget()
            at = np.searchsorted(self.keys, distinct)
            found = np.zeros(len(distinct), bool)
            if len(self.keys):
                found = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
            new = np.flatnonzero(~found)
            if len(new):
                s, e = starts[where[new]], ends[where[new]]
                raw = data.tobytes()
                parts = [raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                odd = np.concatenate([[0], np.cumsum((kind == 4) | (data < 0x20) | (data == 0x7F))])
                self._learn(distinct[new], parts, np.where(kind[s] == 1, 1, np.where(odd[e] > odd[s], 2, 0)))
            index = np.searchsorted(self.keys, distinct)[back]
            n = self.n[index]
            ends_of = np.cumsum(n)
            take = np.arange(ends_of[-1]) + np.repeat(self.at[index] - (ends_of - n), n)
            ids = self.flat[take]
            bounds = np.concatenate([[0], ends_of])[first]
        else:
            ids, bounds = np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        for i in range(len(off) - 1):
            if special[i]:
                yield np.array(self.full.encode(data[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[bounds[i] : bounds[i + 1]]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _Nth:
    """For lengths as they come in a task: how many of each it had before."""

    def __init__(self):
        self.seen: dict[int, int] = defaultdict(int)

    def of(self, length: np.ndarray) -> np.ndarray:
        order = np.argsort(length, kind="stable")
        distinct, first, n = np.unique(length[order], return_index=True, return_counts=True)
        nth = np.empty(len(length), np.int64)
        nth[order] = np.arange(len(length)) - np.repeat(first - np.array([self.seen[x] for x in distinct.tolist()], np.int64), n)
        for x, k in zip(distinct.tolist(), n.tolist(), strict=True):
            self.seen[x] += k
        return nth


def pieces(docs: DataFrame, size: int, path: str, end_id: int) -> DataFrame:
    """A row per piece: the text's ids and end_id, cut every `size` tokens; with the task that made it (part) and how many of its length that had before (nth)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, nth, part = encoder(path), _Nth(), TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            for _, _, data, off in tx.chunks(batch.column(1)):
                out: list[list] = [[], [], [], [], []]
                for ids in e.encode(data, off):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), size)):
                        piece = ids[start : start + size]
                        for x, v in zip(out, (at, k, start, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            x.append(v)
                    at += 1
                many = [pa.array(np.full(len(out[0]), part)), pa.array(nth.of(np.array(out[3], np.int64)))]
                yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:]), *many], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


def plan(counts: dict[int, int], size: int, max_docs: int, max_attention: int, weights: tuple[float, float, float], select: str) -> np.ndarray:
    """Rows (length, rank, bin, pieces a bin, offset): from that rank on, pieces of that length go to bins from that number, so many into each, at that offset.

    Longest first. Of the bins in which a piece fits under every capacity, "norm" takes the one whose residual vector,
    each part divided by its capacity, has the smallest weighted norm afterwards; "dot" the one with the largest weighted product
    of residual and piece. A bin is opened if none fits.
    """
    caps = (size, max_docs, max_attention)
    levels: dict[int, dict[tuple[int, int], list[list[int]]]] = defaultdict(dict)
    some = bytearray(size + 1)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(tokens: int, docs: int, attention: int, ranges: list[list[int]]) -> None:
        levels[tokens].setdefault((docs, attention), []).extend(ranges)
        some[tokens] = 1

    def best(length: int) -> tuple[int, int, int] | None:
        cost, found = None, None
        level = some.find(1, length)
        while level >= 0:
            free = (level - length) / size
            if select == "norm" and cost is not None and weights[0] * free * free > cost:
                break
            for docs, attention in levels[level]:
                if docs < 1 or attention < length * length:
                    continue
                if select == "norm":
                    c = sum(w * x * x for w, x in zip(weights, (free, (docs - 1) / max_docs, (attention - length * length) / max_attention), strict=True))
                else:
                    c = -sum(w * x * y / z / z for w, x, y, z in zip(weights, (level, docs, attention), (length, 1, length * length), caps, strict=True))
                if cost is None or c < cost:
                    cost, found = c, (level, docs, attention)
            level = some.find(1, level + 1)
        return found

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        while n:
            found = best(length)
            tokens, docs, attention = found or caps
            fit = min(tokens // length, docs, attention // (length * length))
            if not fit:
                raise ValueError(f"a piece of {length} tokens exceeds a capacity")
            if found:
                ranges = levels[tokens].pop((docs, attention))
                if not levels[tokens]:
                    some[tokens] = 0
                if select == "dot":
                    fit = 1
            else:
                ranges = [[bins, -(-n // fit)]]
                bins += ranges[0][1]
            left = []
            while ranges and n:
                first, many = ranges.pop()
                each = min(fit, n)
                used = min(many, n // each)
                out.append((length, rank, first, each, size - tokens))
                rank += used * each
                n -= used * each
                put(tokens - each * length, docs - each, attention - each * length * length, [[first, used]])
                if used < many:
                    left.append([first + used, many - used])
                    if n:
                        ranges.append(left.pop())
            if ranges or left:
                put(tokens, docs, attention, ranges + left)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _numbered(parts: DataFrame) -> DataFrame:
    """(row: the columns of parts, length, part, nth): the task that read a row, and how many rows of that length it had before."""
    rows = parts.select(F.struct(*(parts[c] for c in parts.columns)).alias("row"), parts["length"].cast("long").alias("length"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, part = _Nth(), TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(nth.of(batch.column(1).to_numpy()))], ["row", "length", "part", "nth"])

    return rows.mapInArrow(number, T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("nth", T.LongType())]))


def sequences(steps: np.ndarray, counts: dict[int, int]) -> int:
    """How many bins a plan fills."""
    if not len(steps):
        return 0
    until = np.append(steps[1:, 1], 0)
    last = np.append(steps[1:, 0] != steps[:-1, 0], True)
    until[last] = [counts[x] for x in steps[last, 0].tolist()]
    return int((steps[:, 2] + (until - steps[:, 1] - 1) // steps[:, 3]).max()) + 1


def tightest(counts: dict[int, int], size: int, max_attention: int, weights: tuple[float, float, float], select: str) -> tuple[np.ndarray, int]:
    """The plan under the smallest document capacity, doubled from the mean, that takes no more sequences than none would; and that capacity."""
    steps = plan(counts, size, size, max_attention, weights, select)
    fewest = sequences(steps, counts)
    most = -(-sum(counts.values()) // max(fewest, 1))
    while 0 < most < size:
        tried = plan(counts, size, most, max_attention, weights, select)
        if sequences(tried, counts) <= fewest:
            return tried, most
        most *= 2
    return steps, size


#: Weights of the residual tokens, documents and attention cost.
WEIGHTS = (1.0, 0.2, 0.2)


def pack(parts: DataFrame, size: int = 4096, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, select: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, length, ...): as few sequences of at most `size` tokens as best-fit finds.

    max_docs bounds the pieces of a sequence (default: as tightly as it can without a sequence more, see tightest) and max_attention the sum of their
    squared lengths (default: that of one piece of `size` tokens). Lengths are from 1 to size. Equal rows are packed each; no rows give no rows. Other columns stay, whatever their names, but for
    ones named sequence_id or offset, which are replaced.

    Pieces are numbered by length and the task that reads them, so there is no sort of a frequent length's rows, only of its tasks.
    """
    keep = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    return _packed(_numbered(parts.select(*keep)), size, max_docs, max_attention, weights, select)


def _packed(numbered: DataFrame, size: int, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, select: str = "norm") -> DataFrame:
    spark = numbered.sparkSession
    table = materialize(numbered, "pieces")
    cells = materialize(table.groupBy("length", "part").agg(F.count("*").alias("rows")), "cells")
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("rows")).collect()}  # at most `size` rows
    attention = max_attention or size * size
    steps = plan(counts, size, max_docs, attention, weights, select) if max_docs else tightest(counts, size, attention, weights, select)[0]
    key = spark.sparkContext.broadcast(((steps[:, 0] << 44) | steps[:, 1], steps))
    before = cells.select("length", "part", (F.sum("rows").over(Window.partitionBy("length").orderBy("part")) - F.col("rows")).alias("before"))
    ranked = table.join(before.hint("shuffle_merge"), ["length", "part"]).select("row", "length", (F.col("nth") + F.col("before")).alias("rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, steps = key.value
        x, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        s = steps[np.searchsorted(keys, (x << 44) | r, "right") - 1] if len(x) else steps[:0]
        k = r - s[:, 1]
        return pd.DataFrame({"sequence_id": s[:, 2] + k // s[:, 3], "offset": s[:, 4] + k % s[:, 3] * x})

    return ranked.select("row", place("length", "rank").alias("at")).select("row.*", "at.sequence_id", "at.offset")


def best_fit_pack(docs: DataFrame, size: int = 4096, path: str | None = None, end_id: int = 1, **options) -> DataFrame:
    """Documents (doc_id, text; more columns are ignored) to pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone, a null doc_id stays null. Texts of any length are encoded whole; those longer than `size` tokens are cut every `size`.
    Repeated rows are packed each. No rows: no rows.
    """
    made = pieces(docs, size, path or tokenizer_path(), end_id)
    row = F.struct(*(c for c in made.columns if c not in ("part", "nth"))).alias("row")
    return _packed(made.select(row, "length", "part", "nth"), size, **options)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir))
