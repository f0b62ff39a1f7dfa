"""Operator 12: shortest-pack-first packing over the histogram of lengths.

Lengths are placed longest first, each into the pack that has least in it. Packs are planned as patterns with counts: a run of packs that hold the same is
one entry, and a step puts a piece into each of them at once, so the plan's size depends on the sequence size alone. There are exactly as many packs as the tokens fill:
a piece that doesn't fit into the shortest pack is cut where that pack is full, and its rest goes back to the histogram as a shorter length. Pieces then find their steps by length and rank, in parallel.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.packing import _Nth
from quern.llm.shared import documents, materialize

#: Fixed value: the pattern by which byte-level tokenizers cut a text into parts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts whose pieces leave a task together, in tokens.
BATCH = 1 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteEncoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids of a byte-level BPE.

    Texts are encoded by the same vocabulary and order of merges in tiktoken, which takes a quarter of the time; those that hold a special token, or that it can't
    take (megabytes of white space), go to the tokenizer itself, as do all if the merges aren't in the order of their ids.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab = made["model"]["vocab"]
        self.special = [x["content"] for x in made["added_tokens"]]
        merges = [vocab["".join(x.split(" ") if isinstance(x, str) else x)] for x in made["model"]["merges"]]
        # byte-level vocabularies write a printable Latin-1 character as itself and other bytes, in order, from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.fast = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if merges == sorted(set(merges)) else None
        self._full = None

    @property
    def full(self):
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.path)
        return self._full

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # too long a run for its pattern
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part long, nth long"


def pieces(docs: DataFrame, size: int, path: str, end_id: int) -> DataFrame:
    """A row for each `size` tokens of a text's ids and end_id, and for what is left; ids of those that are shorter, since they may be cut; the task (part) and how many of its length that had before (nth)."""
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, nth, part = encoder(path), _Nth(), TaskContext.get().partitionId()

        def batch_of(own: list, out: list[list]) -> pa.RecordBatch:
            columns = [pa.array(own, pa.int64()), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(own), part)), pa.array(nth.of(np.array(out[1], np.int64)))], names)

        for batch in batches:
            own: list = []
            out: list[list] = [[], [], [], [], []]
            tokens = 0
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = np.append(e.encode(batch.column(1)[k].as_py() or ""), np.uint32(end_id)).astype("<u4")
                small = np.uint16 if ids.max() < 1 << 16 else np.uint32
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    own.append(doc_id)
                    for x, v in zip(out, (start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype(small).tobytes() if len(piece) < size else None), strict=True):
                        x.append(v)
                tokens += len(ids)
                if tokens > BATCH:
                    yield batch_of(own, out)
                    own, out, tokens = [], [[], [], [], [], []], 0
            if own:
                yield batch_of(own, out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, _PIECES)


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Rows (length, rank, pack, packs, offset, taken, rest): pieces of that length from that rank on go to so many packs from that number, one each, at that offset, with `taken` of their tokens;
    where that isn't all, what is left of them are pieces of the shorter length, from rank `rest` on.

    There are as many packs of `size` tokens as the tokens fill, and one for each power of two in what remains, so every pack is full and none needs padding. Longest first, a piece goes to the shortest
    pack; one that doesn't fit is cut there.
    """
    left = dict(counts)
    total = sum(length * n for length, n in counts.items())
    runs: dict[int, list[tuple[int, int, int]]] = {}  # room: (first pack, packs, capacity) of the patterns that leave it
    some = bytearray(size + 1)

    def put(room: int, run: tuple[int, int, int]) -> None:
        if room:
            runs.setdefault(room, []).append(run)
            some[room] = 1

    full, rest = divmod(total, size)
    if full:
        put(size, (0, full, size))
    for bit in range(rest.bit_length()):
        if rest >> bit & 1:
            put(1 << bit, (full, 1, 1 << bit))
            full += 1
    out: list[tuple[int, ...]] = []
    for length in range(size, 0, -1):
        rank, n = 0, left.get(length, 0)
        while rank < n:
            room = some.rfind(1)
            taken = min(room, length)
            done: list[tuple[int, tuple[int, int, int]]] = []
            while rank < n and runs[room]:
                first, many, capacity = runs[room].pop()
                used = min(many, n - rank)
                behind = length - taken
                at = left.get(behind, 0) if behind else 0
                out.append((length, rank, first, used, capacity - room, taken, at))
                if behind:
                    left[behind] = at + used
                rank += used
                done.append((room - taken, (first, used, capacity)))
                if used < many:
                    runs[room].append((first + used, many - used, capacity))
            if not runs[room]:
                del runs[room]
                some[room] = 0
            for to, run in done:
                put(to, run)
    return np.array(out, np.int64).reshape(-1, 7)


def _small(raw: bytes, length: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * length else np.uint32)


def pack_patterns(docs: DataFrame, size: int = 1024, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Documents (doc_id, text; more columns are ignored) to pieces in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold `size` tokens or, the last few, a power of two; none is padded. Documents longer than `size` are cut every `size` tokens, others only where a sequence would not be full
    otherwise, at most one cut a sequence. A null or empty text is the end id alone; a null doc_id stays null; texts of any length are encoded whole; repeated rows are packed each. No rows: no rows.
    """
    table = materialize(pieces(docs, size, path or tokenizer_path(), end_id), "pieces")
    spark = table.sparkSession
    cells = materialize(table.groupBy("length", "part").agg(F.count("*").alias("rows")), "cells")
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("rows")).collect()}  # at most `size` rows
    steps = plan(counts, size)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    shared = spark.sparkContext.broadcast(steps[order])
    before = cells.select("length", "part", (F.sum("rows").over(Window.partitionBy("length").orderBy("part")) - F.col("rows")).alias("before"))
    ranked = table.join(before.hint("shuffle_hash"), ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("nth") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        keys = (steps[:, 0] << 44) | steps[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            start, whole, crc, rank = (batch.column(c).to_numpy() for c in (1, 2, 3, 6))
            row, length, done = np.arange(len(whole)), whole, np.zeros(len(whole), np.int64)
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            while len(row):
                s = steps[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
                taken, k = s[:, 5], rank - s[:, 1]
                sums = crc[row].copy()
                for i in np.flatnonzero(taken < whole[row]).tolist():
                    ids = _small(batch.column(5)[int(row[i])].as_py(), int(whole[row[i]]))
                    sums[i] = _crc(ids[done[i] : done[i] + taken[i]])
                for x, v in zip(out, (row, start[row] + done, taken, sums, s[:, 2] + k, s[:, 4]), strict=True):
                    x.append(v)
                more = taken < length
                row, done, rank, length = row[more], (done + taken)[more], (s[:, 6] + k)[more], (length - taken)[more]
            row, *rest = (np.concatenate(x) for x in out)
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), of), *(pa.array(x) for x in rest[:3]), pc.take(batch.column(4), of), *(pa.array(x) for x in rest[3:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_patterns(documents(spark, sf_dir))
