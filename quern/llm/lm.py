"""Operator 7: language-model scores from a subword lattice.

A text's probability sums over all its segmentations into pieces of an existing vocabulary, by forward recursion in
log space. Pieces don't cross words, so the lattice of a text is its words' lattices one behind the other, and each distinct
word is summed once. Half of a piece's weight comes from the vocabulary's own scores, half from how often the
vocabulary's segmentation of the training texts has it. With `words`, every training word is a piece of its own as well: an edge over the whole
word, whose weight is its count less a discount; what the discounts leave is shared by the segmentations into the vocabulary's pieces, whose
weights are then shares among those that a word can begin or go on with.

Counts are exact and cover the whole corpus. Those of the most frequent words (a bounded number) are broadcast; other
words are joined by hash, a row for each document that has one. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import text as tx
from quern.llm.labelled import fold
from quern.llm.shared import documents, materialize, release

#: The token at the end of a text, as a word's hash.
END = np.uint64(0x0123456789ABCDEF)
STOP = 0.3  # share of pieces that end a word
SCORES = 0.5  # share of a piece's weight that the vocabulary's own scores give, however many texts are learnt from
HELD = 400_000  # distinct words that a task holds at once
FREQUENT = 1 << 20  # words whose counts are broadcast, at most
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = 0xFF  # stands for the sign of a word's begin; no UTF-8 text has that byte


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary: a hash table of its pieces as bytes, and prior, their probabilities by its own scores: a score of -r, as rank r, counts as 1 / (r + 1)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.prior = np.zeros(n)
        raw: dict[bytes, int] = {}
        for i in range(n):
            if self.model.is_byte(i):
                raw.setdefault(bytes([int(self.model.id_to_piece(i)[3:5], 16)]), i)
                self.prior[i] = 1 / n  # bytes have no scores; they weigh what the last rank does
            elif not (self.model.is_control(i) or self.model.is_unknown(i)):
                raw[self.model.id_to_piece(i).encode().replace("▁".encode(), bytes([_MARK]))] = i
                self.prior[i] = 1 / (abs(self.model.get_score(i)) + 1)
        raw.setdefault(bytes([_MARK]), self.model.piece_to_id("▁"))
        self.prior /= self.prior.sum()
        self.longest = max(map(len, raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(p) for p in raw])
        keys = _spans(flat, ends - [len(p) for p in raw], ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(raw.values()))[order]
        self.begins = np.array([p[0] == _MARK for p in raw])[order]
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Natural logarithm of each piece's probability, in the order of keys: that of the scores, mixed with its share of counts, where there are any."""
        p = SCORES * self.prior + (1 - SCORES) * counts / counts.sum() if counts.any() else self.prior
        return np.log(np.maximum(p, 1e-12))[self.ids]

    def placed(self, counts: np.ndarray) -> np.ndarray:
        """The same among the pieces of a place, as a word begins with a piece that has the sign and goes on with others: counts and, of one for each piece, the share by its own score."""
        p = np.maximum(counts + len(self.prior) * self.prior, 1e-12)[self.ids]
        return np.log(p / np.where(self.begins, p[self.begins].sum(), p[~self.begins].sum()))


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


_LETTER = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, inverse = tx.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * p[: len(data)], out=total[1:])
    return tx.mix((total[ends] - total[starts]) * inverse[starts])


def marginals(v: Pieces, weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural logarithm of each word's probability, summed over all segmentations; words are lower-case and without the sign of their begin."""
    if not words:
        return np.zeros(0)
    mark = bytes([_MARK])
    data = np.frombuffer(mark + mark.join(words), np.uint8)
    size = np.array([len(w) + 1 for w in words])
    first = np.cumsum(size) - size
    rel = np.arange(len(data)) - np.repeat(first, size)
    left = np.repeat(size, size) - rel  # bytes to the word's end
    p, inverse = tx.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * p[: len(data)], out=total[1:])
    starts, ends, values, order = [], [], [], []
    for n in range(1, min(v.longest, int(size.max())) + 1):
        at = np.flatnonzero(left >= n)
        key = tx.mix((total[at + n] - total[at]) * inverse[at])
        maybe = v.some[(key >> np.uint64(44)).astype(np.int64)]
        at, key = at[maybe], key[maybe]
        k = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        hit = v.keys[k] == key
        at = at[hit]
        starts.append(at)
        ends.append(at + n)
        values.append(weights[k[hit]])
        order.append((rel[at] + n) * 64 + min(n, 63))
    starts, ends, values, order = (np.concatenate(x) for x in (starts, ends, values, order))
    by = np.argsort(order, kind="stable")
    starts, ends, values, order = starts[by], ends[by], values[by], order[by]
    # one cell for each place in a word, and one behind it: place k of word j is at first[j] + j + k
    word = np.repeat(np.arange(len(words)), size)
    cell = starts + word[starts]
    to = cell + (ends - starts)
    forward = np.full(len(data) + len(words), -np.inf)
    forward[first + np.arange(len(words))] = 0
    go_on = np.log(1 - STOP)
    cuts = np.flatnonzero(np.diff(order)) + 1
    for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(order)).tolist(), strict=True):
        forward[to[a:b]] = np.logaddexp(forward[to[a:b]], forward[cell[a:b]] + values[a:b] + go_on)
    return forward[first + np.arange(len(words)) + size] + np.log(STOP / (1 - STOP))


def _counts(texts: DataFrame, path: str) -> DataFrame:
    """(piece, key, n): each task's distinct words, by hash, and with piece set the vocabulary's pieces, with how often the texts have them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        total = np.zeros(len(v.prior))
        hashes, often, words = [np.array([END])], [np.zeros(1)], [b""]

        def batch_of(piece: bool, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(key), 100_000):
                part = key[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), piece)), pa.array(part.astype(np.uint64).view(np.int64)), pa.array(np.rint(n[k : k + 100_000]).astype(np.int64))], ["piece", "key", "n"])

        def settle() -> Iterator[pa.RecordBatch]:
            distinct, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate(often), len(distinct))
            for k in range(0, len(first), 20_000):
                ids = v.model.encode([words[i].decode() for i in first[k : k + 20_000].tolist()], num_threads=1)
                total[:] += np.bincount(np.fromiter((i for x in ids for i in x), np.int64), np.repeat(n[k : k + 20_000], [len(x) for x in ids]), len(total))
            hashes[1:], often[1:], words[1:], often[0][:] = [], [], [], 0
            yield from batch_of(False, distinct[n > 0], n[n > 0])

        for batch in batches:
            often[0] += batch.num_rows
            for _, _, data, off in tx.chunks(batch.column(0)):
                w = tx.Words(data, off)
                distinct, where, n = np.unique(w.hashes, return_index=True, return_counts=True)
                raw = _LOWER[data].tobytes()
                hashes.append(distinct)
                often.append(n.astype(np.float64))
                words.extend(raw[a:b] for a, b in zip(w.starts[where].tolist(), w.ends[where].tolist(), strict=True))
                if len(words) > HELD:
                    yield from settle()
        yield from settle()
        some = np.flatnonzero(total)
        yield from batch_of(True, some, total[some])

    return texts.mapInArrow(rows, "piece boolean, key long, n long")


class _Marginals:
    """Natural logarithms of words' probabilities; those of up to HELD words are remembered by hash."""

    def __init__(self, v: Pieces, weights: np.ndarray):
        self.v, self.weights = v, weights
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, distinct: np.ndarray, text) -> np.ndarray:
        """distinct: sorted hashes; text(i): the word with the i-th."""
        if len(self.keys) > HELD:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
        at = np.searchsorted(self.keys, distinct)
        old = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~old)
        out = np.empty(len(distinct))
        out[old] = self.values[at[old]]
        out[new] = marginals(self.v, self.weights, [text(i) for i in new.tolist()])
        self.keys, self.values = np.insert(self.keys, at[new], distinct[new]), np.insert(self.values, at[new], out[new])
        return out


def _frequent(totals: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, by sorted hash, and counts of those that occur at least 2**k times, for the least k that leaves `most` or fewer."""
    power = F.floor(F.log2("total")).cast("int")
    steps = sorted(totals.groupBy(power.alias("power")).agg(F.count("*")).collect(), reverse=True)  # at most 63 rows
    least, words = 64, 0
    for k, n in steps:
        words += n
        if words > most:
            break
        least = k
    table = totals.filter(power >= least).toArrow()
    word = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], table.column("total").to_numpy()[order]


def _discount(once: int, twice: int) -> float:
    """What each training word's count is lowered by, from how many words occur once and twice (the estimate of Ney, Essen and Kneser)."""
    return min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.1


def score(docs: DataFrame, train, path: str | None = None, frequent: int = FREQUENT, words: bool = False) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text; others are ignored).

    train is a boolean column: the texts to learn from. Scores are log10 probabilities of whole texts, however long; a null or empty text is its end alone.
    score: a text ends with the share of the training tokens that are ends (plus one of two), else a word follows, of the lattice's probability. words: the lattice also has each
    training word as one piece, however rare. A null doc_id counts as not for training if `train` is null for it. No training texts: counts are 0, and scores come from the
    vocabulary. Repeated rows are scored and counted each; no rows give no rows. Words are known by 64-bit hashes. At most `frequent` words' counts are broadcast.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    counted = materialize(_counts(rows.filter("train").select("text"), path), "counts")
    v = pieces(path)
    counts = np.zeros(len(v.prior))
    for r in counted.filter("piece").groupBy("key").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r[0]] = r[1]
    totals = materialize(counted.filter("not piece").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("total")), "totals")
    release(counted)
    end = int(END.view(np.int64))
    times = lambda k: F.count_if((F.col("word") != end) & (F.col("total") == k))
    n, distinct, ends, once, twice = (int(x) for x in totals.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == end, F.col("total"))), F.lit(0)), times(1), times(2)).first())
    scale = np.log10(n + 0.1 * (distinct + 1))
    stop = (ends + 1) / (n + 2)
    whole = words and n > ends
    less, many_words = _discount(once, twice), max(n - ends, 1)
    spell = np.log(less * (distinct - int(ends > 0)) / many_words) if whole else 0.0  # the share that is left to the vocabulary's pieces
    shared = spark.sparkContext.broadcast((v.placed(counts) if words else v.weights(counts), *_frequent(totals, frequent)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, total = shared.value
        lattice = _Marginals(pieces(path), weights)
        row = TaskContext.get().partitionId() << 33
        pair = pa.struct([("word", pa.int64()), ("k", pa.int64()), ("p", pa.float64())])
        for batch in batches:
            at = 0
            for lo, hi, data, off in tx.chunks(batch.column(1)):
                m = hi - lo
                w = tx.Words(data, off)
                found, where, back = np.unique(w.hashes, return_index=True, return_inverse=True)
                raw = _LOWER[data].tobytes()
                log_p = lattice.of(found, lambda i, raw=raw, w=w, where=where: raw[w.starts[where[i]] : w.ends[where[i]]])
                place = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                often = known[place] == found if len(known) else np.zeros(len(found), bool)
                if whole:
                    log_p += spell
                    log_p[often] = np.logaddexp(log_p[often], np.log((total[place[often]] - less) / many_words))
                here = np.where(often, log_p, 0.0) if whole else log_p  # other words' are added when their counts are joined
                base = np.where(often, np.log10((total[place] if len(known) else 0) + 0.1) - scale, 0.0)
                doc = np.repeat(np.arange(m), np.diff(w.first))
                rare = np.flatnonzero(~often[back])
                pairs, k = np.unique(doc[rare] * len(found) + back[rare], return_counts=True)
                of = pairs // max(len(found), 1)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(m + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(found[pairs - of * len(found)].view(np.int64)), pa.array(k), pa.array(log_p[pairs - of * len(found)])], fields=list(pair)))
                many = np.diff(w.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + m)), batch.column(0).slice(at, m), batch.column(2).slice(at, m), pa.array(many + 1),
                        pa.array(np.bincount(doc, often[back], m).astype(np.int64) + int(ends > 0)), pa.array(np.bincount(doc, base[back], m) + np.log10(ends + 0.1) - scale),
                        pa.array(np.bincount(doc, here[back], m) / np.log(10) + many * np.log10(1 - stop) + np.log10(stop)), lists,
                    ],
                    ["row", "doc_id", "train", "n_tokens", "n_known", "base_score", "score", "rare"],
                )
                row += m
                at += m

    kind = "row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:long,k:long,p:double>>"
    scored = materialize(rows.mapInArrow(judge, kind), "scored")
    rare = scored.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.k", "w.p").join(totals, "word", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    piece = F.log((F.col("total") - less) / many_words)  # null for unknown words
    log_p = F.coalesce(F.greatest("p", piece) + F.log1p(F.exp(-F.abs(F.col("p") - piece))), F.col("p")) if whole else F.lit(0.0)
    rest = rare.groupBy("row").agg(
        F.sum(F.when(F.col("total") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * (F.log10(F.col("total") + 0.1) - float(scale))).alias("rest"), F.sum(F.col("k") * log_p / float(np.log(10))).alias("log_p"),
    )
    got = scored.drop("rare").join(rest, "row", "left")
    return got.select("doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("log_p", F.lit(0.0))).alias("score"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 10) == 0
    return score(documents(spark, sf_dir), ~held, words=True).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
