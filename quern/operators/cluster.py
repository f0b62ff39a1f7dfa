"""Average-linkage clustering of distinct signatures, and changes between two clusterings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.tables import materialize, release
from quern.operators.similarity import groups, signatures

#: Distinct signatures that are clustered on the driver (a matrix of their distances); more are clustered in rounds of joins.
MOST = 2000


def average_linkage(vectors: np.ndarray, weights: np.ndarray, cut: float) -> np.ndarray:
    """Labels of rows: clusters are merged, nearest first, while their mean cosine distance is at most cut. weights: how many entities a row stands for."""
    n = len(vectors)
    d = 1 - vectors @ vectors.T
    np.fill_diagonal(d, np.inf)
    size = weights.astype(float).copy()
    label = np.arange(n)
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        i, j = np.unravel_index(np.argmin(np.round(d, 9)), d.shape)
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        alive[j] = False
    return label


def merged_in_rounds(sizes: DataFrame, cut: float) -> DataFrame:
    """(sig, c) for signatures (sig, n: how many entities): the same clustering, of any number of signatures.

    Average linkage of unit vectors is the product of two clusters' sums over the product of their sizes, so a cluster is a sparse sum. Each
    round merges all pairs that are nearest to each other: merging one doesn't bring another nearer, hence the order of merges doesn't matter.
    No distance is above 1, that of clusters without a common relation, so a cut of 1 or more leaves one cluster.
    """
    if cut >= 1:
        return sizes.select("sig").crossJoin(F.broadcast(sizes.agg(F.min("sig").alias("c"))))
    long = sizes.select("sig", "n", F.explode(F.split("sig", ",")).alias("r"), (F.col("n") / F.sqrt(F.size(F.split("sig", ",")).cast("double"))).alias("s"))
    sums, size = materialize(long.select(F.col("sig").alias("c"), "r", "s"), "sums"), materialize(sizes.select(F.col("sig").alias("c"), F.col("n").cast("double").alias("n")), "sizes")
    label = materialize(sizes.select("sig", F.col("sig").alias("c")), "labels")
    while True:
        a, b = sums.select(F.col("c").alias("a"), "r", F.col("s").alias("x")), sums.select(F.col("c").alias("b"), "r", F.col("s").alias("y"))
        dots = a.join(b, "r").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
        far = dots.join(size.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
        pairs = far.select("a", "b", F.round(1 - F.col("dot") / (F.col("na") * F.col("nb")), 9).alias("d")).filter(F.col("d") <= cut)
        each = pairs.select("a", "b", "d", F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.min(F.struct("d", "a", "b")).alias("best"))
        mutual = materialize(each.groupBy("best.a", "best.b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b"), "mutual")
        if mutual.isEmpty():
            return label
        to = lambda df: df.join(mutual.select(F.col("b").alias("c"), F.col("a").alias("into")), "c", "left").withColumn("c", F.coalesce("into", "c")).drop("into")
        sums = materialize(to(sums).groupBy("c", "r").agg(F.sum("s").alias("s")), "sums")
        size = materialize(to(size).groupBy("c").agg(F.sum("n").alias("n")), "sizes")
        label = materialize(to(label).select("sig", "c"), "labels")


def clustered(sizes: DataFrame, cut: float) -> DataFrame:
    """(sig, c) for signatures (sig, n: how many entities): on the driver up to MOST of them, else by merged_in_rounds. c is the cluster's first signature in order of text."""
    if sizes.count() > MOST:
        return merged_in_rounds(sizes, cut)
    rows = sizes.orderBy("sig").collect()
    relations = sorted({r for row in rows for r in row.sig.split(",")})
    at = {r: k for k, r in enumerate(relations)}
    x = np.zeros((len(rows), len(relations)))
    for k, row in enumerate(rows):
        own = [at[r] for r in row.sig.split(",")]
        x[k, own] = 1 / np.sqrt(len(own))
    label = average_linkage(x, np.array([r.n for r in rows]), cut) if rows else []
    return sizes.sparkSession.createDataFrame([(r.sig, rows[k].sig) for r, k in zip(rows, label, strict=True)], "sig string, c string")


def clusters(edges: DataFrame, cut: float = 0.7) -> DataFrame:
    """(e, c): average-linkage clusters of entities by signature; c is the cluster's first signature in order of text."""
    of = materialize(groups(signatures(edges))[0], "signatures")
    return of.join(clustered(materialize(of.groupBy("sig").agg(F.count("*").alias("n")), "sizes"), cut), "sig").select("e", "c")


@dataclass(frozen=True)
class Linkage:
    """An average-linkage clustering that can be kept up to date: signatures with how many entities have them (sig, n), the component that each is in (sig, k), and its cluster (sig, c).

    Components are those of the graph of signatures no further apart than the cut. A merge needs a mean distance, so some distance, within the cut: clusters never reach beyond a component.
    """

    sizes: DataFrame
    components: DataFrame
    clusters: DataFrame


def _relations(sizes: DataFrame) -> DataFrame:
    own = F.split("sig", ",")
    return sizes.select("sig", F.explode(own).alias("r"), (1 / F.sqrt(F.size(own).cast("double"))).alias("w"))


def _links(some: DataFrame, sizes: DataFrame, cut: float) -> DataFrame:
    """(a, b): signatures a of `some` and others b of all that are no further apart than the cut."""
    x, y = _relations(some).withColumnRenamed("sig", "a"), _relations(sizes).select(F.col("sig").alias("b"), "r", F.col("w").alias("v"))
    return x.join(y, "r").filter("a != b").groupBy("a", "b").agg((1 - F.sum(F.col("w") * F.col("v"))).alias("d")).filter(F.round("d", 9) <= cut).select("a", "b")


def _components(sizes: DataFrame, cut: float) -> DataFrame:
    """(sig, k): the smallest signature that links lead to; labels go along links and to the label's own label until none changes."""
    links = materialize(_links(sizes, sizes, cut), "links")
    label = materialize(sizes.select("sig", F.col("sig").alias("k")), "components")
    while True:
        near = links.join(label.withColumnRenamed("sig", "b"), "b").groupBy(F.col("a").alias("sig")).agg(F.min("k").alias("m"))
        new = label.join(near, "sig", "left").select("sig", F.least("k", "m").alias("k"), (F.col("m") < F.col("k")).alias("moved"))
        new = materialize(new.join(label.select(F.col("sig").alias("k"), F.col("k").alias("up")), "k").select("sig", F.least("k", "up").alias("k"), (F.coalesce("moved", F.lit(False)) | (F.col("up") < F.col("k"))).alias("moved")), "components")
        old, label = label, new.select("sig", "k")
        release(old)
        if new.filter("moved").isEmpty():
            return label


def linkage(sizes: DataFrame, cut: float = 0.7) -> Linkage:
    """A clustering of signatures (sig, n) from scratch. For a cut of 1 or more all are one component."""
    if cut >= 1:
        k = sizes.select("sig", F.lit("").alias("k"))
    else:
        k = _components(sizes, cut)
    return Linkage(sizes, k, materialize(clustered(sizes, cut), "clusters"))


def relinked(old: Linkage, sizes: DataFrame, cut: float = 0.7) -> tuple[Linkage, DataFrame]:
    """The clustering after signatures (sig, n) have changed, and which signatures (sig) were clustered anew; it equals linkage(sizes, cut).

    Clustered anew are the components that have a changed signature or get a link to a new one; those tables are all that is computed, others are taken over.
    """
    both = sizes.select("sig", "n").join(old.sizes.select("sig", F.col("n").alias("was")), "sig", "full_outer")
    changed = materialize(both.filter(~F.col("n").eqNullSafe(F.col("was"))), "changed")
    if changed.isEmpty():
        return Linkage(sizes, old.components, old.clusters), sizes.select("sig").limit(0)
    new = changed.filter("was is null").select("sig", "n")
    reached = changed.select("sig").union(_links(new, sizes, cut).select("b") if cut < 1 else sizes.select("sig"))
    hit = materialize(old.components.join(reached.distinct(), "sig", "left_semi").select("k").distinct(), "hit")
    kept = materialize(old.components.join(hit, "k", "left_anti").select("sig", "k"), "kept")
    again = materialize(sizes.join(kept.select("sig"), "sig", "left_anti"), "again")
    part = linkage(again, cut)
    return Linkage(sizes, kept.unionByName(part.components), old.clusters.join(kept.select("sig"), "sig", "left_semi").unionByName(part.clusters)), again.select("sig")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(e, old, new) of entities whose cluster is another one, or that are new or gone."""
    both = before.select("e", F.col("c").alias("old")).join(after.select("e", F.col("c").alias("new")), "e", "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))
