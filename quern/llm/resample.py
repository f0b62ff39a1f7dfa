"""Operator 11: resampling documents towards a target by importance weights of hashed n-grams.

Postings (bucket, document, count) are shuffled by ranges of buckets; where a range's postings arrive, its totals of both corpora arrive,
too, the gains of its buckets are computed there and each document's share is sent on, to be summed by document. A posting is two bytes
in most cases: those of a chunk of texts and a range of buckets are one row. A range's postings are dealt to as many salts as the input needs, so no
task has a whole range, however frequent a bucket is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import text as tx
from quern.llm.labelled import numbers, smallest
from quern.llm.shared import documents, materialize, release
from quern.operators.vocab import numbered

#: Buckets of a range; an offset in it is a byte.
WIDTH = 250
#: Words of at most so many bytes are appended to a checksum by tables.
SHORT = 63
#: Tasks that read the input for each salt of a range.
TASKS_A_SALT = 4

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_tables: list[np.ndarray] = []


def _shift() -> np.ndarray:
    """[length * 1024 + 256 * k + value]: what byte k of a checksum with that value becomes when so many bytes follow, their own checksum apart."""
    if not _tables:
        at = [zlib.crc32(bytes(n)) for n in range(SHORT + 2)]
        _tables.append(np.array([zlib.crc32(bytes(n), v << 8 * k) ^ at[n] for n in range(SHORT + 2) for k in range(4) for v in range(256)], np.uint32))
    return _tables[0]


def _longer(before: np.ndarray, length: np.ndarray, own: np.ndarray, word) -> np.ndarray:
    """crc32 of texts with these checksums followed by pieces of these lengths and checksums; word(i): the piece's bytes, asked for long ones."""
    table, base = _shift(), np.minimum(length, SHORT + 1) * 1024
    out = own.copy()
    for k in range(4):
        out ^= table[base + (256 * k) + ((before >> np.uint32(8 * k)) & np.uint32(255))]
    for i in np.flatnonzero(length > SHORT + 1).tolist():
        out[i] = zlib.crc32(word(i), int(before[i]))
    return out


def features(data: np.ndarray, off: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of texts: each feature's crc32 and its text's number, and each text's number of words. Features are the runs of 1 to `most` words, joined by a space."""
    w = tx.Words(data, off, ~_WORD)
    of = np.repeat(np.arange(len(off) - 1), np.diff(w.first))
    if not len(of):
        return np.zeros(0, np.uint32), of, np.diff(w.first)
    raw = data.tobytes().translate(_LOWER)
    _, where, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    parts = [raw[a:b] for a, b in zip(w.starts[where].tolist(), w.ends[where].tolist(), strict=True)]
    alone = np.array([zlib.crc32(p) for p in parts], np.uint32)[back]
    after = np.array([zlib.crc32(b" " + p) for p in parts], np.uint32)[back]
    length = w.ends - w.starts + 1
    out, texts, now = [alone], [of], alone
    for n in range(1, most):
        now = _longer(now[:-1], length[n:], after[n:], lambda i, n=n: b" " + raw[w.starts[i + n] : w.ends[i + n]])
        same = of[:-n] == of[n:]
        out.append(now[same])
        texts.append(of[:-n][same])
    return np.concatenate(out), np.concatenate(texts), np.diff(w.first)


_SCHEMA = "range int, uid long, doc_id long, words long, features long, docs binary, sizes binary, places binary, counts binary, sums binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"range": pa.int32(), "uid": pa.int64(), "doc_id": pa.int64(), "words": pa.int64(), "features": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.binary())) if c in columns else pa.nulls(n, kinds.get(c, pa.binary())) for c in _NAMES], _NAMES)


def _postings(docs: DataFrame, buckets: int, full: bool) -> DataFrame:
    """Of rows (uid, doc_id, text): a row for each text (range -1), with `full` a row for each chunk of texts and range of buckets with its postings, and a row for each task and range with sums."""
    ranges = -(-buckets // WIDTH)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ranges * WIDTH, np.int64)
        for batch in batches:
            uids, ids = batch.column(0).to_numpy(), batch.column(1)
            for lo, hi, data, off in tx.chunks(batch.column(2)):
                crc, of, words = features(data, off)
                bucket = (crc % np.uint32(buckets)).astype(np.int64)
                sums += np.bincount(bucket, minlength=len(sums))
                if not full:
                    continue
                uid = uids[lo:hi]
                yield _rows(range=np.full(hi - lo, -1), uid=uid, doc_id=ids.slice(lo, hi - lo), words=words, features=np.bincount(of, minlength=hi - lo))
                texts = len(off) - 1
                key = np.sort((bucket // WIDTH * texts + of) * WIDTH + bucket % WIDTH)
                first = np.flatnonzero(np.diff(key, prepend=-1))
                counts, key = np.diff(first, append=len(key)), key[first]
                of_range, of_text, place = key // (texts * WIDTH), key // WIDTH % texts, (key % WIDTH).astype(np.uint8)
                cut = np.searchsorted(of_range, np.arange(ranges + 1))
                out: dict[str, list] = {"range": [], "uid": [], "docs": [], "sizes": [], "places": [], "counts": []}
                for r, a, b in zip(range(ranges), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if a < b:
                        begin = np.flatnonzero(np.diff(of_text[a:b], prepend=-1))
                        far = uid[of_text[a:b][begin]] - uid[0]
                        for c, v in zip(out, (r, uid[0], smallest(far), smallest(np.diff(begin, append=b - a)), place[a:b].tobytes(), smallest(counts[a:b])), strict=True):
                            out[c].append(v)
                if out["range"]:
                    yield _rows(**out)
        used = np.flatnonzero(sums.reshape(ranges, WIDTH).any(1))
        yield _rows(range=used, sums=[sums[r * WIDTH : (r + 1) * WIDTH].tobytes() for r in used.tolist()])

    return docs.mapInArrow(rows, _SCHEMA)


def _totals(postings: DataFrame, name: str) -> DataFrame:
    """(bucket, name) of the rows with sums; a task sends each bucket at most once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[r] = sums.get(r, 0) + np.frombuffer(raw, np.int64)
        for r, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(r * WIDTH, (r + 1) * WIDTH)), pa.array(x)], ["bucket", "n"])

    return postings.filter("sums is not null").select("range", "sums").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    return math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(uid, doc_id, words, features, weight), a row for each row of docs (doc_id, text): the sum of its features' gains towards the texts of target (text).

    A feature is a run of 1 to 3 words of a text, A-Z lower-cased; a word is a run of digits, letters a-z and everything beyond ASCII. A bucket's gain is
    floor(1000 * ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) with its features in target (t of T) and docs (s of S). Null and empty texts have no features and weigh 0; a null doc_id
    stays null; repeated rows count each; a text of any length counts whole. No documents: no rows; an empty target gives gains from zeros.
    uid is a number of the row.
    """
    numbered_rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    postings = materialize(_postings(numbered_rows, buckets, True), "postings")
    aim = _postings(target.select(F.lit(0).cast("long").alias("uid"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), buckets, False)
    both = materialize(_totals(postings, "s").join(_totals(aim, "t"), "bucket", "full_outer").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in "st")), "totals")
    all_s, all_t = both.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "st")).first()
    tasks = postings.filter("range = -1").agg(F.max(F.shiftright("uid", 33))).first()[0] or 0
    salts = -(-(tasks + 1) // TASKS_A_SALT)
    of_range = both.groupBy(F.floor(F.col("bucket") / WIDTH).cast("int").alias("range")).agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("totals"))
    of_range = of_range.select("range", "totals", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    rows = postings.filter("places is not null").withColumn("salt", F.shiftright("uid", 33) % salts)
    rows = rows.join(of_range.hint("shuffle_hash"), ["range", "salt"]).select("range", "uid", "docs", "sizes", "places", "counts", "totals")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, (r, uid) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if r not in gains:
                    gains[r] = np.zeros(WIDTH, np.int64)
                    for x in batch.column(6)[k].as_py():
                        gains[r][x["bucket"] - r * WIDTH] = gain(x["s"], x["t"], all_s, all_t, buckets)
                docs_, sizes, places, counts = (batch.column(c)[k].as_buffer() for c in (2, 3, 4, 5))
                place = np.frombuffer(places, np.uint8)
                begin, n = _begins(sizes, len(place))
                share = np.add.reduceat(gains[r][place] * numbers(memoryview(counts), len(place)), begin)
                yield pa.RecordBatch.from_arrays([pa.array(numbers(memoryview(docs_), n).astype(np.int64) + uid), pa.array(share)], ["uid", "share"])

    nothing = (F.lit(None).cast("long").alias(c) for c in ("doc_id", "words", "features"))
    every = postings.filter("range = -1").select("uid", "doc_id", "words", "features", F.lit(0).cast("long").alias("share")).unionByName(rows.mapInArrow(shares, "uid long, share long").select("uid", *nothing, "share"))
    out = materialize(every.groupBy("uid").agg(*(F.max(c).alias(c) for c in ("doc_id", "words", "features")), F.sum("share").alias("weight")), "weights")
    release(postings, both)
    return out


def _begins(raw: pa.Buffer, total: int) -> tuple[np.ndarray, int]:
    """Where each document's postings begin, from their sizes, which add up to total; and how many documents there are."""
    for kind in (np.uint16, np.uint32):
        if raw.size % kind().itemsize == 0:
            size = np.frombuffer(raw, kind).astype(np.int64)
            if size.sum() == total:
                break
    return np.cumsum(size) - size, len(size)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: str = "42", buckets: int = 10_000) -> DataFrame:
    """Documents (doc_id, text; more columns are ignored) as doc_id, n_features, weight, score, rank: drawn without replacement in proportion to exp(weight / 1000) by Gumbel keys.

    weight: see weights. score: weight plus a key by the sha256 of seed and doc_id. Of the documents with `least` words or more, floor(percent / 100) of them with the highest scores are drawn and have a rank from 1, ties by doc_id;
    others have a null rank. A null doc_id is hashed as an empty text and comes after others in ties; repeated rows have the same score and ranks of their own. No rows: no rows.
    """
    rows = weights(docs, target, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    key = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = rows.select("uid", "doc_id", F.col("features").alias("n_features"), "weight", (F.col("weight") + key).alias("score"), "words")
    drawn = scored.filter(F.col("words") >= least).count() * percent // 100
    ranked = numbered(scored.filter(F.col("words") >= least), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("uid")], 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(F.col("id") <= drawn, F.col("id")).alias("rank")).unionByName(scored.filter(F.col("words") < least).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
