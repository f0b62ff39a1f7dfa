"""Operator 8: benchmark decontamination.

All n-grams of the test items are seeds, however often the corpus has them: a limit of rarity would lose edited copies
that are spread widely. Seeds join passages to items, and Smith-Waterman alignment of the passage's words with the
item's scores each, so edited and paraphrased copies count too. Passages that can't reach the least similarity are left
out before, by an upper bound of the score. Items are broadcast in blocks of bounded bytes, hence texts are never
shuffled: each row is searched and aligned where it is read.
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
from quern.llm.shared import documents, materialize
from quern.llm.toxicity import _APART

MATCH, MISMATCH, GAP = 2, -1, -1
#: Seeds' hits that are handled at once, at document boundaries; a document with more is handled alone.
HITS = 1 << 20
#: Bytes of items' texts that are broadcast at once, as arrays of some twenty times that; a longer item is a block of its own size.
BLOCK = 4_000_000
#: Least score of an alignment, as a share of the item's with itself. An item with 30 % of its words replaced has 0.55 on average.
SIMILARITY = 0.4


@dataclass
class Items:
    """A block of test items: ids, their words' hashes, and all (n-gram, item, place) sorted by n-gram.

    singles and pairs: sorted distinct hashes of words and of two words; single and pair: for each word of all items its number in
    singles, and in pairs that of it and the word before (-1 for an item's first); first: each item's first word.
    """

    ids: list[int | None]
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    singles: np.ndarray
    single: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    first: np.ndarray


def _hashes(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, off in tx.chunks(texts):
        w = tx.Words(data, off, _APART)
        h = w.hashes
        out += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def _items(rows: list[tuple[int | None, str]], n: int) -> Items:
    words = _hashes(pa.array([t for _, t in rows], pa.large_string()))
    grams = [tx.ngrams(w, n) for w in words]
    flat = np.concatenate([np.zeros(0, np.uint64), *grams])
    item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    every = np.concatenate([np.zeros(0, np.uint64), *words])
    first = np.cumsum([0, *map(len, words)]).astype(np.int64)
    singles, single = np.unique(every, return_inverse=True)
    inner = np.ones(len(every), bool)
    inner[first[:-1][first[:-1] < len(every)]] = False
    before = np.concatenate([np.zeros(min(1, len(every)), np.uint64), tx.ngrams(every, 2)])
    pairs, which = np.unique(before[inner], return_inverse=True)
    pair = np.full(len(every), -1, np.int64)
    pair[inner] = which
    return Items([i for i, _ in rows], words, flat[order], item[order], place[order], singles, single.astype(np.int64), pairs, pair, first)


def align(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: the best local score, and the first word of x and the word after the last of the alignment."""
    h = np.zeros(len(x) + 1, np.int64)
    begin = np.arange(len(x) + 1)
    steps = np.arange(len(x) + 1) * -GAP
    best = (0, 0, 0)
    for w in y:
        diagonal = h[:-1] + np.where(x == w, MATCH, MISMATCH)
        up = h[1:] + GAP
        new = np.maximum(np.maximum(diagonal, up), 0)
        first = np.where(new == 0, np.arange(1, len(x) + 1), np.where(diagonal >= up, begin[:-1], begin[1:]))
        # gaps in y: the best of all cells to the left, less a gap for each step
        lifted = new + steps[1:]
        top = np.maximum.accumulate(lifted)
        where = np.maximum.accumulate(np.where(lifted == top, np.arange(len(new)), 0))
        new, first = top - steps[1:], first[where]
        h = np.concatenate([[0], new])
        begin = np.concatenate([[0], first])
        k = int(new.argmax())
        if new[k] > best[0]:
            best = (int(new[k]), int(first[k]), k + 1)
    return best


def _hits(grams: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in grams that the sorted distinct index has, and which of its entries."""
    at = np.minimum(np.searchsorted(index, grams), max(len(index) - 1, 0))
    place = np.flatnonzero(index[at] == grams) if len(index) else np.zeros(0, np.int64)
    return place, at[place]


class _Places:
    """Where the entries of a sorted distinct index occur among the n-grams of a chunk."""

    def __init__(self, grams: np.ndarray, index: np.ndarray):
        place, which = _hits(grams, index)
        self.width = len(grams) + 1
        self.keys = np.sort(which * self.width + place)

    def within(self, which: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether entry `which` begins at a place of left <= place < right."""
        if not len(self.keys):
            return np.zeros(len(which), bool)
        at = np.searchsorted(self.keys, which * self.width + left)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] < which * self.width + right)


def _bounds(items: Items, of: np.ndarray, left: np.ndarray, right: np.ndarray, words: _Places, pairs: _Places) -> np.ndarray:
    """For each passage (left, right: its first word and that after its last) an upper bound of its alignment's score with item `of`.

    Order and number of the passage's words are left aside: a word matches if the passage has it anywhere, and two matches follow each
    other without a gap if the passage has both side by side.
    """
    size = (items.first[of + 1] - items.first[of]).astype(np.int64)
    order = np.argsort(-size, kind="stable")
    of, left, right, size = of[order], left[order], right[order], size[order]
    top = np.zeros(len(of), np.int64)
    ends_in_match, ends_in_gap = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    for j in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -j, "left"))  # passages whose items have more than j words
        at = items.first[of[:k]] + j
        has = words.within(items.single[at], left[:k], right[:k])
        side = pairs.within(items.pair[at], left[:k], right[:k] - 1) if j else has
        match, gap = ends_in_match[:k], ends_in_gap[:k]
        follows = np.maximum(np.maximum(np.where(side, match, match + GAP), gap), 0) + MATCH
        ends_in_gap[:k] = np.maximum(match, gap) + max(MISMATCH, GAP)
        ends_in_match[:k] = np.where(has, follows, 0)
        top[:k] = np.maximum(top[:k], ends_in_match[:k])
    out = np.empty(len(of), np.int64)
    out[order] = top
    return out


def _slices(weights: np.ndarray, group: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows that add up to about `most`, cut between groups."""
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=group[:1] - 1)), len(group))
    total = np.concatenate([[0], np.cumsum(weights)])[cuts]
    out, k = [], 0
    while k + 1 < len(cuts):
        end = max(k + 1, int(np.searchsorted(total, total[k] + most, "right")) - 1)
        out.append((int(cuts[k]), int(cuts[end])))
        k = end
    return out


_FOUND = T.StructType().add("item_id", "long").add("similarity", "double").add("start", "integer").add("end", "integer")


def _search(docs: DataFrame, keep: list[str], into: str, items: Items, n: int, least: int, similarity: float) -> DataFrame:
    """Rows of docs (text) with the columns `keep` and `into`, an array of the items found in each."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = docs.select(*keep).schema.add(into, T.ArrayType(_FOUND))
    sent = keep if "text" in keep else [*keep, "text"]
    place = sent.index("text")
    kind = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])

    def passages(w: tx.Words, words: np.ndarray, block: Items, index: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, word after the last) of a chunk's passages that can be similar enough."""
        where, which = _hits(tx.ngrams(words, n), index)
        doc = np.searchsorted(w.first, where, "right") - 1
        inside = where + n <= w.first[doc + 1]
        where, which, doc = where[inside], which[inside], doc[inside]
        many = end[which] - begin[which]
        if not len(where):
            return
        singles, pairs = _Places(words, block.singles), _Places(tx.ngrams(words, 2), block.pairs)
        for lo, hi in _slices(many, doc, HITS):
            m = many[lo:hi]
            entry = np.repeat(begin[which[lo:hi]], m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
            at, d = np.repeat(where[lo:hi], m), np.repeat(doc[lo:hi], m)
            start = at - block.place[entry]  # where the item would begin
            order = np.lexsort((start, block.item[entry], d))
            at, d, of, start = at[order], d[order], block.item[entry][order], start[order]
            size = (block.first[1:] - block.first[:-1])[of]
            new = np.ones(len(of), bool)
            new[1:] = (d[1:] != d[:-1]) | (of[1:] != of[:-1]) | (np.diff(start) > size[1:])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(of)) - 1
            seeds = np.bincount(np.unique((np.cumsum(new) - 1) * (len(words) + 1) + at) // (len(words) + 1), minlength=len(first))
            some = seeds >= np.minimum(least, np.maximum(1, size[first] - n + 1))
            first, last = first[some], last[some]
            d, of, size = d[first], of[first], size[first]
            slack = size // 2 + 4
            left, right = np.maximum(w.first[d], start[first] - slack), np.minimum(w.first[d + 1], start[last] + size + slack)
            near = _bounds(block, of, left, right, singles, pairs) / (MATCH * size) >= similarity
            yield from zip(d[near].tolist(), of[near].tolist(), left[near].tolist(), right[near].tolist(), strict=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        index, begin = np.unique(block.grams, return_index=True)
        end = np.append(begin[1:], len(block.grams))
        for batch in batches:
            rest = batch.columns[: len(keep)]
            at = 0
            for lo, hi, data, off in tx.chunks(batch.column(place)):
                w = tx.Words(data, off, _APART)
                words = w.hashes
                found: dict[tuple[int, int], tuple[float, int, int]] = {}
                for d, k, left, right in passages(w, words, block, index, begin, end):
                    y = block.words[k]
                    score, s, e = align(words[left:right], y)
                    share = score / (MATCH * len(y))
                    if share >= similarity and share > found.get((d, k), (0, 0, 0))[0]:
                        found[d, k] = (share, left + s, left + e)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                out: list[list] = [[], [], [], []]
                of = []
                for (d, k), (share, s, e) in sorted(found.items()):
                    base = points[off[d]]
                    of.append(d)
                    for x, v in zip(out, (block.ids[k], share, int(points[w.starts[s]] - base), int(points[w.ends[e - 1]] - base)), strict=True):
                        x.append(v)
                spans = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(out, kind, strict=True)], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(hi - lo + 1)), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, hi - lo) for c in rest), lists], [*keep, into])
                at += hi - lo

    return docs.select(*sent).mapInArrow(rows, schema)


def _texts(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def _count(benchmark: DataFrame, most: int) -> int:
    """How many blocks of about `most` bytes of text the items are dealt to."""
    return max(1, -(-(_texts(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most))


def _blocks(benchmark: DataFrame, n: int, blocks: int) -> Iterator[Items]:
    """The items in so many blocks, read one after the other."""
    rows = _texts(benchmark)
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield _items(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), n)


def matched(docs: DataFrame, benchmark: DataFrame, into: str = "matches", n: int = 3, least: int = 2, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Documents (text; all columns and rows stay) with a column of the test items (item_id, text) that a passage of theirs aligns with.

    It is an array of item_id, similarity, start and end; a column of its name is replaced. similarity is the alignment's score divided by that of the
    item with itself; start and end are code points in the document; of one item the best passage counts. A seed is any n-gram of an item. A passage
    needs `least` seeds (or all of a short item's). Items of fewer than n words and null or empty texts match nothing; texts of any length are searched
    whole. Rows are judged each, by their text alone, whatever their ids; repeated items match each; no rows give no rows. Rows pass through once for every `block` bytes of items; with more
    than one block they are numbered and written once, each block's matches are written before the next one is broadcast, and what matched is joined by number.
    """
    keep = [c for c in docs.columns if c != into]
    blocks = _count(benchmark, block)
    if blocks == 1:
        return _search(docs, keep, into, next(_blocks(benchmark, n, 1)), n, least, similarity)
    uid, part, found = (_free(docs, into, c) for c in ("uid", "block", "found"))
    rows = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    hits = None
    for k, items in enumerate(_blocks(benchmark, n, blocks)):
        one = materialize(_search(rows.select(uid, "text"), [uid], found, items, n, least, similarity).filter(F.size(found) > 0).withColumn(part, F.lit(k)), "matches")
        hits = one if hits is None else hits.unionByName(one)
    every = hits.groupBy(uid).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(part, found))), lambda x: x[found])).alias(found))
    return rows.join(every, uid, "left").select(*keep, F.coalesce(found, F.array().cast(every.schema[found].dataType)).alias(into))


def _free(docs: DataFrame, into: str, name: str) -> str:
    """A name that neither a column of docs nor `into` has."""
    while name.lower() in (c.lower() for c in [*docs.columns, into]):
        name += "_"
    return name


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: int = 2, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, item_id, similarity, start, end) of the matches that matched() finds; a row for each of a document's rows and items.

    A null doc_id stays null; rows that share one have rows each; null and empty texts, and no rows or items, give none; other columns are ignored. Of several blocks of items each one's rows are written before the next is broadcast.
    """
    rows, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    blocks = _count(benchmark, block)
    for items in _blocks(benchmark, n, blocks):
        part = _search(rows, ["doc_id"], "found", items, n, least, similarity).select("doc_id", F.explode("found").alias("f"))
        if blocks > 1:
            part = materialize(part, "matches")
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "f.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
