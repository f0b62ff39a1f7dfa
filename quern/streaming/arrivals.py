"""Entity-arrival micro-batches: the graph becomes visible as its entities arrive."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.tables import materialize
from quern.operators.paths import order_by_md5, step_name
from quern.operators.vocab import entities, inverse, numbered


def hubs(edges: DataFrame, share: float = 0.1) -> DataFrame:
    """(e, n): the most used entities, a share of all of them, by uses and then name.

    A histogram of the uses tells which use is cut; only entities with just that use are sorted by name.
    """
    use = materialize(edges.select(F.explode(F.array("h", "t")).alias("e")).groupBy("e").agg(F.count("*").alias("n")), "uses")
    many = use.groupBy("n").agg(F.count("*").alias("many"))  # a row for each number of uses; their sum is twice the edges, so they are few
    total = F.sum("many").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    k = int((many.agg(F.sum("many")).first()[0] or 0) * share)
    cut = many.withColumn("upto", total).filter(F.col("upto") >= k).orderBy(F.desc("n")).first()
    if not k or cut is None:
        return use.filter("false")
    left = k - (cut.upto - cut.many)
    ties = numbered(use.filter(F.col("n") == cut.n), [F.asc("e")]).filter(F.col("id") < left)
    return use.filter(F.col("n") > cut.n).unionByName(ties.select("e", "n"))


def _part(key: Column, parts: int) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % parts


def arrival_steps(edges: DataFrame, seeds: DataFrame, steps: int = 10, share: float = 0.5, seed: str = "42") -> DataFrame:
    """(e, step): seeds and a share of the others come at step 0, the rest at steps 1 to `steps`, by md5 of the name. No sort of all entities is needed."""
    key = order_by_md5("e", seed=seed)
    part = _part(key, 1000)
    rest = F.floor((part - int(share * 1000)) / ((1000 - share * 1000) / steps)) + 1
    found = entities(edges).join(seeds.select("e", F.lit(1).alias("hub")), "e", "left")
    return found.select("e", F.when((F.col("hub") == 1) | (part < int(share * 1000)), F.lit(0)).otherwise(F.least(rest, F.lit(steps))).cast("long").alias("step"))


def edge_steps(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges with the step at which both ends are there."""
    a = steps.select(F.col("e").alias("h"), F.col("step").alias("a"))
    b = steps.select(F.col("e").alias("t"), F.col("step").alias("b"))
    return edges.join(a, "h").join(b, "t").withColumn("step", F.greatest("a", "b")).drop("a", "b")


def coverage(stepped: DataFrame) -> DataFrame:
    """(step, new_edges, all_edges) for each step."""
    n = stepped.groupBy("step").agg(F.count("*").alias("new_edges"))
    return n.withColumn("all_edges", F.sum("new_edges").over(Window.orderBy("step")))


def incremental_vocab(steps: DataFrame) -> DataFrame:
    """(e, step, id): ids are given in order of step and name, so earlier ones never change."""
    return numbered(steps, [F.asc("step"), F.asc("e")])


def incremental_relations(stepped: DataFrame) -> DataFrame:
    """(name, step, id): relations in the order of the step that has them first and of name; a relation and its inverse get ids together, so earlier ones never change."""
    first = stepped.groupBy("r").agg(F.min("step").cast("long").alias("step"))
    ids = numbered(first, [F.asc("step"), F.asc("r")])
    both = F.array(F.struct(F.col("r").alias("name"), (F.col("id") * 2).alias("id")), F.struct(inverse("r").alias("name"), (F.col("id") * 2 + 1).alias("id")))
    return ids.select("step", F.explode(both).alias("x")).select("x.name", "step", "x.id")


def affected(paths: DataFrame, facts: DataFrame, new: DataFrame) -> DataFrame:
    """Entities on the paths (start, program, end, nodes, n) of new entities (e) up to where they reach an answer of the start, but not by the fact's own edge; new ones are left out."""
    mine = paths.join(new.select(F.col("e").alias("start")), "start", "left_semi")
    hit = mine.join(facts.select(F.col("h").alias("start"), F.col("r").alias("asked"), F.col("t").alias("end")), ["start", "end"])
    # no path comes back to its start, so the fact's own edge can only be a path of one hop
    hit = hit.filter((F.col("n") > 1) | (F.col("program") != step_name("asked")))
    return hit.select(F.explode("nodes").alias("e")).distinct().join(new.select("e"), "e", "left_anti")


def seed_size(total: int, share: float) -> int:
    return int(total * share)


def arrivals(edges: DataFrame, steps: int, share: float = 0.5, hub_share: float = 0.1, seed: str = "42") -> DataFrame:
    """(e, step): hubs and then others, in the order of md5, up to a share of all entities come at step 0; of the rest equally many, rounded up, at each of `steps` steps, what is left at the last."""
    seeds = materialize(hubs(edges, hub_share).select("e"), "hubs")
    rest = numbered(entities(edges).join(seeds, "e", "left_anti"), [order_by_md5("e", seed=seed).asc(), F.asc("e")])
    first = seeds.count()
    total = first + rest.count()
    left, size = max(0, seed_size(total, share) - first), max(1, math.ceil((1 - share) * total / steps))
    later = F.least(F.floor((F.col("id") - left) / size) + 1, F.lit(steps))
    return seeds.select("e", F.lit(0).cast("long").alias("step")).unionByName(rest.select("e", F.when(F.col("id") < left, F.lit(0)).otherwise(later).cast("long").alias("step")))


def entity_coverage(steps: DataFrame) -> DataFrame:
    """(step, new_entities, all_entities, share): entities that came with each step and so far, and the share of all."""
    n = steps.groupBy("step").agg(F.count("*").alias("new_entities")).withColumn("all_entities", F.sum("new_entities").over(Window.orderBy("step")))
    return n.withColumn("share", F.col("all_entities") / F.sum("new_entities").over(Window.partitionBy()))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key isn't among them."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def merge_partials(partials: DataFrame, clusters: DataFrame) -> DataFrame:
    """(c, r, program, n) from partial counts (e, r, program, n), by cluster and, with c null, over all."""
    rows = partials.join(clusters, "e")
    return rows.groupingSets([["c", "r", "program"], ["r", "program"]], "c", "r", "program").agg(F.sum("n").alias("n"))


def run_stream(source: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Feeds each micro-batch of a streaming DataFrame to sink(batch, number); availableNow, so it ends when the input is used up."""
    return source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
