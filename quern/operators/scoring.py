"""Triple scorers over array columns: (h, r, t: arrays of doubles) -> score column; higher is better."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tables import materialize


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def transe_l1(h: Column, r: Column, t: Column, gamma: float = 40.0) -> Column:
    return gamma - _sum(F.zip_with(F.zip_with(h, r, lambda x, y: x + y), t, lambda x, y: F.abs(x - y)))


def transe_l2(h: Column, r: Column, t: Column) -> Column:
    return sigmoid(-F.sqrt(_sum(F.zip_with(F.zip_with(h, r, lambda x, y: x + y), t, lambda x, y: (x - y) * (x - y)))))


def distmult(h: Column, r: Column, t: Column, bias: Column | float = 0.0) -> Column:
    return sigmoid(dot(F.zip_with(h, r, lambda x, y: x * y), t) + bias)


def _halves(x: Column, d: int) -> tuple[Column, Column]:
    return F.slice(x, 1, d), F.slice(x, d + 1, d)


def complex_(h: Column, r: Column, t: Column, d: int) -> Column:
    """Arrays hold d real parts, then d imaginary ones."""
    (hr, hi), (rr, ri), (tr, ti) = (_halves(x, d) for x in (h, r, t))
    mul = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    real = F.zip_with(mul(hr, rr), mul(hi, ri), lambda x, y: x - y)
    imag = F.zip_with(mul(hr, ri), mul(hi, rr), lambda x, y: x + y)
    return sigmoid(dot(real, tr) + dot(imag, ti))


def rotate(h: Column, phase: Column, t: Column, d: int, gamma: float = 9.0) -> Column:
    """h, t: d real, then d imaginary parts; phase: d numbers, scaled by (gamma + 2) / d to angles. L1 over both parts."""
    unit = (gamma + 2) / d / math.pi
    (hr, hi), (tr, ti) = _halves(h, d), _halves(t, d)
    angle = F.transform(F.slice(phase, 1, d), lambda x: x / unit)
    cos, sin = F.transform(angle, lambda x: F.cos(x)), F.transform(angle, lambda x: F.sin(x))
    mul = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    real = F.zip_with(mul(hr, cos), mul(hi, sin), lambda x, y: x - y)
    imag = F.zip_with(mul(hr, sin), mul(hi, cos), lambda x, y: x + y)
    off = lambda a, b: _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return gamma - (off(real, tr) + off(imag, ti))


def correlate(a: Column, b: Column, d: int, convolve: bool = False) -> Column:
    """Circular correlation (or convolution) of two arrays of length d."""
    place = (lambda k, i: F.pmod(k - i, F.lit(d))) if convolve else (lambda k, i: F.pmod(k + i, F.lit(d)))
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), F.lit(0.0), lambda s, i: s + F.get(a, i) * F.get(b, place(k, i))))


def path_translation(total: Column) -> Column:
    return 2 * (sigmoid(1 / total) - 0.5)


def softmax(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Adds p, the softmax of value within by."""
    w = Window.partitionBy(by)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return rows.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def entropy(rows: DataFrame, by: str, eps: float = 1e-20) -> DataFrame:
    return rows.groupBy(by).agg(F.sum(-F.col("p") * F.log(F.col("p") + eps)).alias("entropy"))


def label_smoothing(y: Column, n: int, eps: float = 0.1, spread: bool = False) -> Column:
    """(1 - eps) * y plus 1 / n, or plus eps / n with spread."""
    return (1 - eps) * y + ((eps if spread else 1.0) / n)


def shaped_reward(hit: Column, fact: Column, mu: float = 1.0, threshold: float = 0.0) -> Column:
    """hit + mu * (1 - hit) * fact; facts below the threshold count 0."""
    return hit + mu * (1 - hit) * F.when(fact < threshold, F.lit(0.0)).otherwise(fact)


def oracle_reward(known: Column) -> Column:
    """1 for every known answer, whether it is the question's or not."""
    return F.when(known, 1).otherwise(0)


def distances(q: np.ndarray, t: np.ndarray, squared: bool = False) -> np.ndarray:
    """Of all rows with all, the sum of |q - t| or of its squares, added up number by number in tiles that fit a core's cache."""
    out, columns = np.empty((len(q), len(t))), np.ascontiguousarray(t.T)
    for at in range(0, len(q), 16):
        part, total = q[at : at + 16], out[at : at + 16]
        total[:] = 0
        off = np.empty_like(total)
        for i in range(q.shape[1]):
            np.subtract(part[:, i, None], columns[i], out=off)
            np.multiply(off, off, out=off) if squared else np.abs(off, out=off)
            total += off
    return out


def _logistic(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-s))


def _turned(h: np.ndarray, c: np.ndarray, s: np.ndarray) -> np.ndarray:
    a, b = np.hsplit(h, 2)
    return np.concatenate([a * c - b * s, a * s + b * c], 1)


#: The scorers over matrices: rows of h and r are queries, rows of t entities; all queries with all entities.
TABLES = {
    "transe_l1": lambda h, r, t: 40.0 - distances(h + r, t),
    "transe_l2": lambda h, r, t: _logistic(-np.sqrt(distances(h + r, t, squared=True))),
    "distmult": lambda h, r, t: _logistic((h * r) @ t.T),
    "complex": lambda h, r, t: _logistic(_turned(h, *np.hsplit(r, 2)) @ t.T),
    "rotate": lambda h, r, t: 9.0 - distances(_turned(h, *(f(r[:, : h.shape[1] // 2] / (11.0 / (h.shape[1] // 2) / math.pi)) for f in (np.cos, np.sin))), t),
}
TABLES["ensemble"] = lambda h, r, t: (TABLES["distmult"](h, r, t) + TABLES["transe_l2"](h, r, t)) / 2


def regular(dim: int, *vectors: str) -> Column:
    """Whether vectors have so many numbers, all of them finite."""
    out = F.lit(True)
    for v in vectors:
        out = out & F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False))
    return out


def matrix(column: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, dim)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores: a small file is one task otherwise, whatever is made of a row."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def best_tails(queries: DataFrame, entities: DataFrame, score, k: int = 10, block: int = 1000, table=None, dim: int = 64) -> DataFrame:
    """(q, e, score, place): of each query (q, h, r), the k entities (e, t) that score highest, by score in nine places and then e. score: a function of the arrays h, r, t.

    Queries are dealt to blocks of about `block`, which are broadcast one after the other; each is a pass over the entities, which stay where they are. Every task sends on
    no more than k rows of a query. table: the same score over matrices (see TABLES), for ids that are numbers and vectors of `dim` finite numbers; others are scored by columns.
    """
    best = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "e")
    placed = lambda rows: rows.withColumn("place", F.row_number().over(best).cast("long")).filter(F.col("place") <= k)
    if table is not None:
        ids = F.col("q").isNotNull() & regular(dim, "h", "r"), F.col("e").isNotNull() & regular(dim, "t")
        parts = [best_by_tables(queries.filter(ids[0]), entities.filter(ids[1]), table, k, dim, 8 * block)]
        for few, all_ in ((queries.filter(~ids[0]), entities), (queries.filter(ids[0]), entities.filter(~ids[1]))):
            if not few.isEmpty() and not all_.isEmpty():
                parts.append(best_tails(few, all_, score, k, block))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p.select(*out.columns))
        return placed(out) if len(parts) > 1 else out
    blocks, out = max(1, -(-queries.count() // block)), None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = entities.join(F.broadcast(part)).select("q", "e", score(F.col("h"), F.col("r"), F.col("t")).alias("score"))
        top = placed(rows)
        if blocks > 1:  # its broadcast goes before the next one comes
            top = materialize(top, "block")
        out = top if out is None else out.unionByName(top)
    return out


def best_by_tables(queries: DataFrame, entities: DataFrame, table, k: int, dim: int, block: int) -> DataFrame:
    """(q, e, score, place): what best_tails() gives, of regular vectors; a task's k best entities of each query, which its batches are compared with. Only scores that reach the last of them are sorted."""
    spark, kinds = queries.sparkSession, (dict(queries.dtypes)["q"], dict(entities.dtypes)["e"])
    vectors = spread(entities.select("e", F.col("t").cast("array<double>").alias("t")), "e")
    blocks, out = max(1, -(-queries.count() // block)), None
    for n in range(blocks):
        part = (queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n) if blocks > 1 else queries).select("q", *(F.col(c).cast("array<double>").alias(c) for c in "hr")).toArrow()
        shared = spark.sparkContext.broadcast((part.column("q").combine_chunks(), matrix(part.column("h"), dim), matrix(part.column("r"), dim)))

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, h, r = shared.value
            whose, s, e, least, seen = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.full(len(h), -np.inf), 0
            for batch in batches:
                ids, t = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
                at = 0
                while at < len(t):
                    # short at first, as nothing is ruled out yet
                    step = min(1024, max(64, seen))
                    for first in range(0, len(h), 1000):
                        new = table(h[first : first + 1000], r[first : first + 1000], t[at : at + step])
                        i, j = np.nonzero(np.round(new, 9) >= least[first : first + 1000, None])
                        whose, s, e = np.concatenate([whose, i + first]), np.concatenate([s, new[i, j]]), np.concatenate([e, ids[at + j]])
                    order = np.lexsort((e, -np.round(s, 9), whose))
                    whose, s, e = whose[order], s[order], e[order]
                    place = np.arange(len(whose)) - np.searchsorted(whose, whose)
                    last = place == k - 1
                    least[whose[last]] = np.round(s[last], 9)
                    whose, s, e = whose[place < k], s[place < k], e[place < k]
                    seen, at = seen + step, at + step
            yield pa.RecordBatch.from_arrays([names.take(pa.array(whose)), pa.array(e), pa.array(s)], ["q", "e", "score"])

        found = vectors.mapInArrow(rows, f"q {kinds[0]}, e {kinds[1]}, score double")
        top = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "e")).cast("long")).filter(F.col("place") <= k)
        if blocks > 1:
            top = materialize(top, "block")
            shared.destroy()
        out = top if out is None else out.unionByName(top)
    return out


def best_by_products(queries: DataFrame, entities: DataFrame, k: int = 10, block: int = 1000, bias: bool = False) -> DataFrame:
    """(q, e, score, place): of each query (q, vec: array), the k entities (e: long, v: array, with `bias` b) with the largest dot product, plus b, by score in nine places and then e.

    Queries come in blocks, one after the other, each broadcast; a batch of entities is one matrix product with a block, and a task keeps each query's k best so far. So it sends no more than k rows a query, whatever it has read.
    """
    spark, kind = queries.sparkSession, dict(queries.dtypes)["q"]
    blocks, out = max(1, -(-queries.count() // block)), None
    vectors = entities.select(F.col("e").cast("long").alias("e"), F.col("v").cast("array<double>").alias("v"), (F.col("b").cast("double") if bias else F.lit(0.0)).alias("b"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "e")
    for n in range(blocks):
        part = (queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n) if blocks > 1 else queries).select("q", F.col("vec").cast("array<double>").alias("vec")).toArrow()
        if not part.num_rows:
            continue
        asked = part.column("vec").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
        shared = spark.sparkContext.broadcast((part.column("q").combine_chunks(), asked))

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            top = np.full((len(asked), 0), -np.inf), np.zeros((len(asked), 0), np.int64)
            for batch in batches:
                v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                e, b = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for at in range(0, len(v), 2048):
                    s = np.concatenate([top[0], np.round(asked @ v[at : at + 2048].T + b[None, at : at + 2048], 9) + 0.0], 1)
                    ids = np.concatenate([top[1], np.broadcast_to(e[at : at + 2048], (len(asked), len(v[at : at + 2048])))], 1)
                    order = np.lexsort((ids, -s), axis=1)[:, :k]
                    top = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)
            width = top[0].shape[1]
            if width:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(asked)), width))), pa.array(top[1].ravel()), pa.array(top[0].ravel())], ["q", "e", "score"])

        found = vectors.mapInArrow(rows, f"q {kind}, e long, score double").withColumn("place", F.row_number().over(best).cast("long")).filter(F.col("place") <= k)
        if blocks > 1:
            found = materialize(found, "block")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"q {kind}, e long, score double, place long")


def relation_weights(paths: DataFrame) -> DataFrame:
    """(h, t, r, weight): for each pair, by relation the sum of the probabilities of its paths (h, t, relations, p) that have it, once for each time they do."""
    return paths.select("h", "t", F.explode("relations").alias("r"), "p").groupBy("h", "t", "r").agg(F.sum("p").alias("weight"))


def state_embedding(rows: DataFrame, kind: str = "average") -> DataFrame:
    """(q, v): a query's expected tail from scored candidates (q, e, score, v: array): their average by score, or with e the best one's (ties by e) or one drawn in proportion to the scores by md5 ("sample")."""
    if kind == "average":
        sums = rows.select("q", "score", F.posexplode("v").alias("i", "x")).groupBy("q", "i").agg((F.sum(F.col("x") * F.col("score")) / F.sum("score")).alias("x"))
        return sums.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    # the smallest of -ln(u) / score is each candidate's with a probability in proportion to its score
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", "q", "e").cast("binary")), 1, 12), 16, 10).cast("double") + 1) / (2**48 + 1)
    key = -F.col("score") if kind == "best" else -F.log(u) / F.col("score")
    return rows.withColumn("_k", key).groupBy("q").agg(F.min_by(F.struct("e", "v"), F.struct("_k", "e")).alias("b")).select("q", "b.e", "b.v")


def stable_rewards(rollouts: DataFrame, by: str = "q", normal: bool = False, eps: float = 1e-10) -> DataFrame:
    """Adds stable: reward less the mean of a query's rollouts, with `normal` divided by their sample deviation (plus eps)."""
    w = Window.partitionBy(by)
    off = F.col("reward") - F.avg("reward").over(w)
    return rollouts.withColumn("stable", off / (F.coalesce(F.stddev_samp("reward").over(w), F.lit(0.0)) + eps) if normal else off)


def discounted(reward: Column, steps: int, gamma: float) -> Column:
    """Array of what each step of a rollout returns, when only the last one is rewarded."""
    return F.transform(F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)), lambda k: reward * F.pow(F.lit(gamma), k))


def cross_entropy(p: Column, y: Column, eps: float = 1e-12) -> Column:
    """Binary cross-entropy of a probability and a label, which may be smoothed."""
    return -(y * F.log(F.greatest(p, F.lit(eps))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(eps))))


def policy_loss(returns: Column, log_p: Column, entropy_: Column, beta: float) -> Column:
    """One rollout's policy-gradient loss: minus the sum of returns times log-probabilities (arrays), less beta times the mean entropy."""
    return -dot(returns, log_p) - beta * entropy_


def margin_loss(good: Column, bad: Column, margin: float) -> Column:
    return F.greatest(F.lit(0.0), margin - good + bad)


def masked_softmax(rows: DataFrame, by: str, value: str, allowed: str) -> DataFrame:
    """Adds p, the softmax of value within by over the allowed rows; the others' is 0."""
    return softmax(rows.withColumn("_v", F.when(F.col(allowed), F.col(value)).otherwise(F.col(value) - 1e31)), by, "_v").drop("_v")


def train_distmult(triples: DataFrame, entities: DataFrame, relations: DataFrame, rate: float = 0.1, epochs: int = 1) -> tuple[DataFrame, DataFrame]:
    """Full-gradient steps of the logistic loss of DistMult: triples (h, r, t, y), entities (e, v) and relations (r, w) with arrays; the new entities and relations.

    A step is two joins and a grouped sum for each table, so vectors stay distributed; gradients are summed over all triples in long form.
    """
    scale = lambda a, x: F.transform(a, lambda y: y * x)
    mul = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)

    def moved(table: DataFrame, key: str, vec: str, grad: DataFrame) -> DataFrame:
        long = grad.select(key, F.posexplode("g").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
        total = long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("g"))
        new = F.when(F.col("g").isNull(), F.col(vec)).otherwise(F.zip_with(vec, "g", lambda a, b: a - rate * b))
        return table.join(total, key, "left").select(key, new.alias(vec))

    for _ in range(epochs):
        rows = triples.join(entities.select(F.col("e").alias("h"), F.col("v").alias("hv")), "h").join(entities.select(F.col("e").alias("t"), F.col("v").alias("tv")), "t").join(relations.select("r", F.col("w").alias("rv")), "r")
        rows = materialize(rows.withColumn("d", sigmoid(dot(mul(F.col("hv"), F.col("rv")), F.col("tv"))) - F.col("y")), "gradients")
        own = rows.select(F.col("h").alias("e"), scale(mul(F.col("rv"), F.col("tv")), F.col("d")).alias("g")).unionByName(rows.select(F.col("t").alias("e"), scale(mul(F.col("hv"), F.col("rv")), F.col("d")).alias("g")))
        of_r = rows.select("r", scale(mul(F.col("hv"), F.col("tv")), F.col("d")).alias("g"))
        entities, relations = materialize(moved(entities, "e", "v", own), "entities"), materialize(moved(relations, "r", "w", of_r), "relations")
    return entities, relations
