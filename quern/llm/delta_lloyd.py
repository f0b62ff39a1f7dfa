"""Operator 13: Lloyd's clustering of quantised vectors by differences.

Assignments are a written table; the clusters' sums and counts are exact integers in the driver, a row for each cluster. A round compares a vector with the centroids
that have changed only, unless its own has: then with all. What moves gives a signed transfer, added up by task and then over all, so sums are never taken anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import materialize, release

#: Components are integers of at most this size, so that any squared distance of 64 of them fits a long.
LARGEST = 1 << 27
_LONG = (1 << 63) - 1
_STATE = "vec_id long, x binary, old int, cluster int, distance long"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def kept(vectors: DataFrame, size: int = 64, scale: int = 64, vec: str = "embedding") -> DataFrame:
    """(vec_id, x: array of longs) of the vectors with `size` components, all finite: floor(scale * component), within LARGEST."""
    x = F.col(vec).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).filter(F.size("v") == size)
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * scale, F.lit(2.0**40)), F.lit(-(2.0**40)))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long")
    return rows.select("vec_id", F.transform("v", whole).alias("x"))


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of a binary column; a vector's components have one, two or four bytes."""
    raw = [x.as_buffer() for x in column]
    width = np.array([len(x) // size for x in raw])
    out = np.empty((len(raw), size), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(raw[i] for i in at.tolist()), f"<i{w}").reshape(len(at), size)
    return out


def _packed(x: np.ndarray) -> list[bytes]:
    most = np.maximum(x.max(1), -1 - x.min(1)) if len(x) else np.zeros(0, np.int64)
    kind = np.where(most < 1 << 7, 1, np.where(most < 1 << 15, 2, 4))
    return [row.astype(f"<i{w}").tobytes() for row, w in zip(x, kind.tolist(), strict=True)]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, exact: in doubles where all of it is below 2**53."""
    most = (int(np.abs(a).max()) if a.size else 0) * (int(np.abs(b).max()) if b.size else 0) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 1 << 50 else a @ b


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids, exact."""
    return (x * x).sum(1)[:, None] - 2 * _product(x, centroids.T) + (centroids * centroids).sum(1)[None, :]


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New owners and distances, and how many distances were computed. owner -1: none yet. Ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    moved = (owner < 0) | changed[owner]
    some = np.flatnonzero(changed)
    still = np.flatnonzero(~moved)
    if len(some) and len(still):
        d = distances(x[still], centroids[some])
        best = d.argmin(1)
        d, c = d[np.arange(len(still)), best], some[best]
        closer = (d < distance[still]) | ((d == distance[still]) & (c < owner[still]))
        owner[still[closer]], distance[still[closer]] = c[closer], d[closer]
    gone = np.flatnonzero(moved)
    if len(gone):
        d = distances(x[gone], centroids)
        owner[gone] = d.argmin(1)
        distance[gone] = d.min(1)
    return owner, distance, len(still) * len(some) + len(gone) * len(centroids)


def _assigned(rows: DataFrame, centroids: np.ndarray, changed: np.ndarray, first: bool) -> DataFrame:
    """The next state: of rows (vec_id, x: array) if `first`, else of a state."""
    size = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if first:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, size)
                raw, owner, distance = pa.array(_packed(x), pa.binary()), np.full(n, -1), np.zeros(n, np.int64)
            else:
                raw, owner, distance = batch.column(1), batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
                x = _unpacked(raw, size)
            now, far, _ = nearest(x, owner, distance, centroids, changed)
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array(owner, pa.int32()), pa.array(now, pa.int32()), pa.array(far)], _NAMES)

    return rows.select(*(["vec_id", "x"] if first else ["vec_id", "x", "cluster", "distance"])).mapInArrow(assign, _STATE)


def _transfers(state: DataFrame, k: int, size: int) -> dict[int, list[int]]:
    """By cluster, what the moved vectors change of its components' sums and, at the end, of its count."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            x = np.concatenate([_unpacked(batch.column(0), size), np.ones((batch.num_rows, 1), np.int64)], 1)
            for column, sign in ((1, -1), (2, 1)):
                of = batch.column(column).to_numpy()
                ones = np.zeros((k, len(of)), np.int64)
                mine = np.flatnonzero(of >= 0)
                ones[of[mine], mine] = sign
                sums += _product(ones, x)
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    moved = state.filter("old != cluster").select("x", "old", "cluster").mapInArrow(signed, "cluster int, sums array<long>")
    total = moved.select("cluster", F.posexplode("sums").alias("i", "n")).groupBy("cluster", "i").agg(F.sum("n").alias("n"))
    out: dict[int, list[int]] = {}
    for r in total.collect():  # at most k times (size + 1) rows
        out.setdefault(r.cluster, [0] * (size + 1))[r.i] = r.n
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", size: int = 64, scale: int = 64) -> DataFrame:
    """Vectors (vec_id, embedding; more columns are ignored) as vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with `size` components, all finite, as integers (see kept). The first centroids are the k vectors whose ids have the smallest sha256 with the seed; those of equal ids, by their components. Each round assigns
    all vectors to the nearest centroid, ties to the smaller number, and moves every centroid that has any to the floor of their mean; then they are assigned once more. It ends early when no centroid moves.
    A null vec_id is hashed as an empty text and stays null; repeated rows count each; fewer than k vectors are as many centroids; none, or an empty table: no rows. Sums of distances beyond a long are its largest value.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, size, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = rows.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not chosen:
        return spark.createDataFrame([], columns)
    centroids = np.array([r.x for r in chosen], np.int64)
    sums = [[0] * (size + 1) for _ in chosen]
    state = materialize(_assigned(rows, centroids, np.ones(len(chosen), bool), True), "assigned")
    for _ in range(rounds):
        for c, change in _transfers(state, len(chosen), size).items():
            sums[c] = [a + b for a, b in zip(sums[c], change, strict=True)]
        moved = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(sums, centroids, strict=True)], np.int64)
        changed = (moved != centroids).any(1)
        if not changed.any():
            break
        centroids, was = moved, state
        state = materialize(_assigned(was, centroids, changed, False), "assigned")
        release(was)
    whole = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    own = {r[0]: r[1] for r in state.groupBy("cluster").agg(whole("distance")).collect()}  # at most k rows
    every = min(_LONG, sum(own.values()))
    named = [(c, inertia, every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, inertia in own.items()]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select(*(c.split()[0] for c in columns.split(", ")))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    """Lloyd's rounds over all vectors and centroids, without differences."""
    out = [f"""v as (select row_number() over () as n, vec_id, [cast(floor({scale} * x::double) as bigint) for x in embedding] as x from embeddings where len(embedding) = {size} and len([1 for x in embedding if x is not null and isfinite(x)]) = {size})""",
           f"""c0 as (select row_number() over (order by key, x) - 1 as c, x as m from (select sha256('1:' || vec_id) as key, x from v) order by key, x limit {k})"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} as (select n, any_value(vec_id) as vec_id, any_value(x) as x, min(d * {k} + c) as best from (select n, vec_id, x, c, cast(list_sum([(x[i] - m[i]) * (x[i] - m[i]) for i in range(1, {size + 1})]) as bigint) as d from v cross join c{i}) group by n)""")
        if i < rounds:
            out.append(f"""s{i} as (select c, i, sum(y) as s, count(*) as w from (select best % {k} as c, unnest(x) as y, unnest(range(1, {size + 1})) as i from a{i}) group by c, i)""")
            out.append(f"""c{i + 1} as (select c{i}.c, coalesce(x, m) as m from c{i} left join (select c, list(cast((s - ((s % w) + w) % w) // w as bigint) order by i) as x from s{i} group by c) t on t.c = c{i}.c)""")
    last = f"""select vec_id, cast(best % {k} as integer) as cluster, cast(best // {k} as bigint) as distance, cast(sum(best // {k}) over (partition by best % {k}) as bigint) as cluster_inertia, cast(sum(best // {k}) over () as bigint) as inertia,
        sha256(array_to_string(m, ',')) as centroid_sha256 from a{rounds} join c{rounds} on c{rounds}.c = best % {k}"""
    return f"with {', '.join(out)} {last}"


SQL = _sql()
