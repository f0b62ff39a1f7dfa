"""Operator 1: n-gram Jaccard join.

The documents-by-n-grams incidence matrix A is multiplied with its transpose in blocks. One block is the
columns that can decide: each document keeps only its rarest n-grams, so few that two documents with too
small a set of common ones there cannot reach the threshold (prefix bound). Overlap counts of that block are
accumulated per pair, and a pair goes as soon as the count plus what may follow is below the overlap that
the two sizes ask for. For the survivors the remaining columns are multiplied block by block, again with
early discards. Rarity comes from a sketch of fixed size (parameter sketch_bits), so what is broadcast does
not grow; it only orders columns and can cost time, never links.

Documents with equal sets are one row of A. Pairs within a dense group are not all emitted: every column
first pairs its rows with one pivot; only rows that this leaves in different components are paired with
others, so components are the same as if all pairs had been compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import text as tx
from quern.llm.graph import components
from quern.llm.shared import documents, materialize, release

SLICES = 64


def _sketch(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """For each of 2**bits buckets of n-gram hashes, in how many documents one of them occurs (saturating uint32)."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for _, _, data, off in tx.chunks(batch.column(0)):
                got = list(tx.shingles(tx.Words(data, off), n))
                if got:
                    total += np.bincount((np.concatenate(got) >> np.uint64(64 - bits)).astype(np.int64), minlength=size).astype(np.uint32)
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(total, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size // SLICES, np.uint64)
        for frame in frames:
            for x in frame["counts"]:
                total += np.frombuffer(zlib.decompress(x), np.uint32)
        low = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        yield pd.DataFrame({"slice": [key[0]], "counts": [zlib.compress(low.tobytes(), 1)]})

    kind = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(count, kind).groupBy("slice").applyInPandas(add, kind).collect()
    out = np.zeros(size, np.uint32)
    for r in rows:
        out[r[0] * (size // SLICES) : (r[0] + 1) * (size // SLICES)] = np.frombuffer(zlib.decompress(r[1]), np.uint32)
    return out


def _prefixes(docs: DataFrame, n: int, percent: int, sketch: np.ndarray, bits: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (together the set's 128-bit signature) and the prefix of its columns, rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            ids = batch.column(0)
            at = 0
            for lo, hi, data, off in tx.chunks(batch.column(1)):
                sizes, s1, s2, flat, ends = [], [], [], [], [0]
                for u in tx.shingles(tx.Words(data, off), n):
                    m = len(u)
                    sizes.append(m)
                    x = tx.mix(u + np.uint64(1))
                    s1.append(int(x.sum(dtype=np.uint64)) if m else 0)
                    s2.append(int(np.bitwise_xor.reduce(tx.mix(x))) if m else 0)
                    keep = m - -(-percent * m // 100) + 1 if m else 0
                    order = np.argsort(rank[(u >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")[:keep]
                    flat.append(u[order])
                    ends.append(ends[-1] + keep)
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, hi - lo), pa.array(sizes, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), prefix], ["doc_id", "n_shingles", "s1", "s2", "prefix"])
                at += hi - lo

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_shingles long, s1 long, s2 long, prefix array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """id and the sorted hashes of all columns, as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lo, hi, data, off in tx.chunks(batch.column(1)):
                sets = [u.tobytes() for u in tx.shingles(tx.Words(data, off), n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, hi - lo), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["id", "cols"])
                at += hi - lo

    return docs.select("doc_id", "text").mapInArrow(rows, "id long, cols binary")


def _multiply(pairs: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """(a, b, x, y: sets as bytes) to those pairs that reach the threshold, with their overlap.

    Columns are multiplied in blocks of the first set's order; what is accumulated plus all that may follow is held against the overlap needed.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, overlap = [], []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                if min(len(x), len(y)) < need:
                    continue
                got = done = 0
                while done < len(x):
                    part = x[done : done + block]
                    lo, hi = np.searchsorted(y, part[0]), np.searchsorted(y, part[-1], "right")
                    if hi > lo:
                        at = np.searchsorted(y[lo:hi], part)
                        got += int((y[lo:hi][np.minimum(at, hi - lo - 1)] == part).sum())
                    done += len(part)
                    if got + min(len(x) - done, len(y) - hi) < need:
                        break
                else:
                    keep.append(i)
                    overlap.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(overlap, pa.int64())], ["a", "b", "overlap"])

    return pairs.mapInArrow(rows, "a long, b long, overlap long")


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Accumulates the overlap of the prefix columns for (a, b, na, nb, pa, pb) and keeps pairs that may still reach the threshold."""
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    return (
        pairs.groupBy("a", "b", "na", "nb")
        .agg(F.count("*").alias("got"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        .filter(F.col("got") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= need)
        .select("a", "b")
    )


def _fits(na: str, pa_: str, sa: str, nb: str, pb: str, sb: str, percent: int):
    """Of two rows of one column: whether sizes and places allow the threshold, at least if it is the pair's first common column.

    s: how many of the row's columns before this one others have too. A first common column leaves enough columns after it in both
    rows; all columns before one that does so do so too, hence counts up to the last that is kept are complete.
    """
    most = F.least(sa, sb) + 1 + F.least(F.col(na) - F.col(pa_) - 1, F.col(nb) - F.col(pb) - 1)
    need = F.lit(percent) * (F.col(na) + F.col(nb))
    return (most * (100 + percent) >= need) & ((F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb)) * (100 + percent)) >= need)


def _numbered(cells: DataFrame) -> DataFrame:
    """Adds s, the number of the document's rows before each."""
    return cells.withColumn("s", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)


def _verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), n), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("cols").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("cols").alias("y")), "b")
    out = materialize(_multiply(both.select("a", "b", "x", "y"), percent), "verified")
    release(sets)
    return out


def with_own_ids(docs: DataFrame, into: str) -> tuple[DataFrame, bool]:
    """Adds `into`, an id that no other row has: doc_id, but for rows without one or with one that occurs again. Those get numbers above all ids, in the order of doc_id and text.

    Also returned: whether there are such rows. Only ids are grouped, and only such rows written; the rows' other columns stay.
    """
    also, nth = f"{into}_again", f"{into}_nth"
    again = materialize(docs.groupBy(F.col("doc_id").alias(also)).agg(F.count("*").alias("rows")).filter(F.col(also).isNull() | (F.col("rows") > 1)).select(also), "again")
    own = F.col("doc_id").cast("long").alias(into)
    if again.isEmpty():
        return docs.select("*", own), False
    odd = docs.join(again, F.col("doc_id").eqNullSafe(F.col(also)), "left_semi")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last(), F.xxhash64(*(F.col(c).cast("string") for c in docs.columns))]
    odd = materialize(odd.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(nth, F.monotonically_increasing_id()), "odd")
    low, high = (x or 0 for x in docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first())
    number = F.col(nth) + (high + 1) if high < 1 << 61 else F.lit(low - 1) - F.col(nth)
    single = docs.filter("doc_id is not null").join(again, F.col("doc_id") == F.col(also), "left_anti")
    return single.select(*docs.columns, own).unionByName(odd.select(*docs.columns, number.alias(into))), True


def jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, sketch_bits: int = 21, own: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text; more columns are ignored) whose sets of n-word shingles have a Jaccard similarity of percent / 100 or more.

    Returns (members, links). members has a row for each input row: doc_id, n_shingles, class_id (smallest doc_id
    with the same set) and component_id (smallest doc_id reachable by links). links has the pairs (a, b, overlap) of
    class ids that were compared and reach the threshold; within a dense group they span its components.
    A null or empty text has no shingles, is its own class and component; texts of any length count whole. Repeated rows stay and are in one class. Rows
    that share a doc_id, or have none, are documents of their own and are linked by their texts; the smallest doc_id is that of the rows that have one, else null.
    No rows: no rows. own: every row is known to have a doc_id of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if not own:
        rows, odd = with_own_ids(docs, "_id")
        if odd:
            rows = materialize(rows, "rows")
            members, links = jaccard_join(rows.select(F.col("_id").alias("doc_id"), "text"), n, percent, sketch_bits, True)
            members = materialize(members.withColumnRenamed("doc_id", "_id").join(rows.select("_id", "doc_id"), "_id"), "members")
            for c in ("class_id", "component_id"):
                least = members.groupBy(c).agg(F.min("doc_id").alias("_least"))
                members = members.join(least, c).drop(c).withColumnRenamed("_least", c)
            return members.select("doc_id", "n_shingles", "component_id", "class_id"), links
    sketch = _sketch(docs, n, sketch_bits)
    table = materialize(_prefixes(docs, n, percent, sketch, sketch_bits), "prefixes")
    classes = materialize(table.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = table.filter("n_shingles > 0").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    cells = reps.select("doc_id", "n_shingles", F.posexplode("prefix").alias("pos", "h"))
    pivot = cells.groupBy("h").agg(F.count("*").alias("rows"), F.min(F.struct("pos", "doc_id", "n_shingles")).alias("p")).filter("rows > 1").drop("rows")
    block = materialize(cells.join(pivot, "h").select("h", "doc_id", "n_shingles", "pos", "p"), "block")
    star = block.filter("doc_id != p.doc_id").select(
        F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b"),
        *(F.when((F.col("doc_id") < F.col("p.doc_id")) == low, F.col(c)).otherwise(F.col(f"p.{c}")).alias(name) for low, c, name in ((True, "n_shingles", "na"), (False, "n_shingles", "nb"), (True, "pos", "pa"), (False, "pos", "pb"))),
    )
    tried = materialize(_bounded(star, percent), "tried")
    links = _verified(docs, tried, n, percent)
    found = components(links)
    # columns whose rows are still in several components: the largest part there is only compared with the others
    cell = block.select("h", "doc_id", "n_shingles", "pos").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    parts = cell.groupBy("h", "component").agg(F.count("*").alias("rows"))
    several = parts.groupBy("h").agg(F.count("*").alias("parts"), F.max(F.struct("rows", "component")).alias("most")).filter("parts > 1")
    open_ = materialize(_numbered(cell.join(several.select("h", F.col("most.component").alias("most")), "h")), "open")
    left = open_.filter("component != most").select("h", *(F.col(c).alias(f"{c}_l") for c in ("doc_id", "n_shingles", "pos", "s", "component")))
    right = open_.select("h", "doc_id", "n_shingles", "pos", "s", "component", "most")
    rest = left.join(right, "h").filter(
        (F.col("component") != F.col("component_l")) & ((F.col("component") == F.col("most")) | (F.col("doc_id_l") < F.col("doc_id"))) & _fits("n_shingles_l", "pos_l", "s_l", "n_shingles", "pos", "s", percent)
    )
    low = F.col("doc_id_l") < F.col("doc_id")
    rest = rest.select(
        F.least("doc_id_l", "doc_id").alias("a"), F.greatest("doc_id_l", "doc_id").alias("b"),
        F.when(low, F.col("n_shingles_l")).otherwise(F.col("n_shingles")).alias("na"), F.when(low, F.col("n_shingles")).otherwise(F.col("n_shingles_l")).alias("nb"),
        F.when(low, F.col("pos_l")).otherwise(F.col("pos")).alias("pa"), F.when(low, F.col("pos")).otherwise(F.col("pos_l")).alias("pb"),
    )
    rest = materialize(_bounded(rest, percent).join(tried, ["a", "b"], "left_anti"), "rest")
    links = materialize(links.unionByName(_verified(docs, rest, n, percent)), "links")
    release(block, open_, tried, rest)
    final = components(links)
    member = table.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left").withColumn("class_id", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")))
    member = member.join(final.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id")
    return member, links


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))[0].select("doc_id", "n_shingles", "component_id", "class_id")
