"""Paths, programs (relation sequences), their prior and precision, and answering by them.

A program is the text of its relations joined by slashes; a slash (or percent sign) in a relation's name is percent-coded there, see step_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tables import materialize, release
from quern.operators.vocab import coded, inverse, numbered


def step_name(r: Column | str) -> Column:
    """A relation as a program has it; also the program of that relation alone."""
    return coded(r, "/")


def order_by_md5(*parts: Column | str, seed: str = "0") -> Column:
    """A reproducible pseudo-random order: md5 text of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))


def enumerate_paths(starts: DataFrame, edges: DataFrame, hops: int = 2, revisit: bool = False, most: int | None = None) -> DataFrame:
    """(start, program, end, nodes, n) of all paths of 1 to `hops` hops from starts (e). A join per hop, a row per path: for counts of programs see found_programs.

    most: an entity with more edges has them dealt to parts of about so many, each of which meets the paths there by itself, in more tasks than there are cores; for graphs of few entities with nearly all edges.
    """
    now = starts.select(F.col("e").alias("start"), F.lit("").alias("program"), F.col("e").alias("end"), F.array("e").alias("nodes"), F.lit(0).alias("n"))
    out = None
    step = edges.select(F.col("h").alias("end"), step_name("r").alias("r"), "t")
    on = ["end"]
    if most:
        parts = materialize(step.groupBy("end").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).filter("_parts > 1"), "parts")
        step = step.join(parts, "end", "left").withColumn("_part", F.pmod(F.xxhash64("r", "t"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        on, tasks = ["end", "_part"], 8 * edges.sparkSession.sparkContext.defaultParallelism
        # the inputs are small beside the paths, so they are dealt by number: adaptive execution would put them together
        step = step.repartition(tasks, *on)
    for k in range(hops):
        if most:
            now = now.join(parts, "end", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts").repartition(tasks, *on)
        now = now.join(step.hint("shuffle_hash") if most else step, on)
        if not revisit:
            now = now.filter(~F.array_contains("nodes", F.col("t")))
        now = now.select("start", (F.col("r") if k == 0 else F.concat_ws("/", "program", "r")).alias("program"), F.col("t").alias("end"), F.array_append("nodes", F.col("t")).alias("nodes"), F.lit(k + 1).alias("n"))
        out = now if out is None else out.unionByName(now)
    return out


def sample_walks(starts: DataFrame, edges: DataFrame, walks: int = 10, hops: int = 3, seed: str = "0") -> DataFrame:
    """(start, program, end): distinct ends of `walks` random walks from each start (e) without revisits; a walk stops where it is stuck.

    Each step takes the edge whose md5 of seed, walk, hop and edge is smallest.
    """
    now = starts.select(F.col("e").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk")).select("*", F.lit("").alias("program"), F.col("start").alias("end"), F.array("start").alias("nodes"))
    step = edges.select(F.col("h").alias("end"), "r", "t")
    done = None
    for k in range(hops):
        rows = now.join(step, "end").filter(~F.array_contains("nodes", F.col("t")))
        best = Window.partitionBy("start", "walk").orderBy(order_by_md5("walk", F.lit(str(k)), "end", "r", "t", seed=seed))
        now = rows.withColumn("k", F.row_number().over(best)).filter("k = 1").select("start", "walk", F.concat_ws("/", F.when(F.col("program") != "", F.col("program")), step_name("r")).alias("program"), F.col("t").alias("end"), F.array_append("nodes", F.col("t")).alias("nodes"))
        part = now.select("start", "program", "end")
        done = part if done is None else done.unionByName(part)
    return done.distinct()


def walks_by_job(starts: DataFrame, edges: DataFrame, jobs: int, walks: int = 10, hops: int = 3, seed: str = "0") -> DataFrame:
    """(job, start, program, end): walks of each start, which belongs to one of `jobs` ranges of equal size in the order of names; a job's walks don't depend on the others."""
    ids = numbered(starts.select("e").distinct(), [F.asc("e")])
    n = ids.count()
    of = ids.select(F.col("e").alias("start"), F.floor(F.col("id") * jobs / max(n, 1)).cast("long").alias("job"))
    return sample_walks(starts, edges, walks, hops, seed).join(of, "start").select("job", "start", "program", "end")


def longest_paths(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(start, relations, nodes) of the paths of at most `hops` hops that can't be made longer without a revisit; arrays, of step names and without the start itself in nodes."""
    paths = enumerate_paths(starts, edges, hops).select("start", F.split("program", "/").alias("relations"), F.slice("nodes", 2, hops).alias("nodes"), "n")
    inner = paths.filter(F.col("n") > 1).select("start", F.slice("relations", 1, F.col("n") - 1).alias("relations"), F.slice("nodes", 1, F.col("n") - 1).alias("nodes")).distinct()
    return paths.join(inner, ["start", "relations", "nodes"], "left_anti").select("start", "relations", "nodes")


def prefix_programs(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """(h, r, program, n): of paths (start, relations, nodes), the relations up to each place that holds an answer (start, r, node) of the facts, once for each distinct prefix of nodes.

    The program that is the fact's own relation is left out.
    """
    at = paths.select("start", "relations", "nodes", F.posexplode("nodes").alias("k", "t"))
    cut = at.select("start", "t", F.slice("relations", 1, F.col("k") + 1).alias("relations"), F.slice("nodes", 1, F.col("k") + 1).alias("nodes")).distinct()
    hit = cut.join(facts.select(F.col("h").alias("start"), "r", "t"), ["start", "t"]).withColumn("program", F.array_join("relations", "/"))
    return hit.filter(F.col("program") != step_name("r")).groupBy(F.col("start").alias("h"), "r", "program").agg(F.count("*").alias("n"))


def walk_probabilities(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(h, t, program, p): walks of two hops between the ends of facts, each hop with equal probability among an entity's edges."""
    share = edges.withColumn("p", 1 / F.count("*").over(Window.partitionBy("h")).cast("double"))
    a, b = share.select("h", F.col("r").alias("r1"), F.col("t").alias("mid"), F.col("p").alias("p1")), share.select(F.col("h").alias("mid"), F.col("r").alias("r2"), "t", F.col("p").alias("p2"))
    return a.join(b, "mid").join(facts.select("h", "t"), ["h", "t"]).select("h", "t", F.concat_ws("/", step_name("r1"), step_name("r2")).alias("program"), (F.col("p1") * F.col("p2")).alias("p"))


def programs(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """(h, r, program, n): of each fact h -r-> t, programs of paths from h that end in t, with how many do; the program that is the fact's own relation is left out."""
    hit = paths.join(facts.select(F.col("h").alias("start"), "r", F.col("t").alias("end")), ["start", "end"])
    return hit.filter(F.col("program") != step_name("r")).groupBy(F.col("start").alias("h"), "r", "program").agg(F.count("*").alias("n"))


def _two(e: DataFrame, heads: DataFrame | None) -> DataFrame:
    """(h, e, program, n): walks of two hops of edges (h, r, t, n) from the heads (h), None: all, but back to the head."""
    a, b = e.select("h", F.col("r").alias("r1"), F.col("t").alias("mid"), F.col("n").alias("n1")), e.select(F.col("h").alias("mid"), F.col("r").alias("r2"), F.col("t").alias("e"), F.col("n").alias("n2"))
    if heads is not None:
        a = a.join(heads, "h", "left_semi")
    return a.join(b, "mid").filter("h != e").groupBy("h", "e", F.concat_ws("/", "r1", "r2").alias("program")).agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))


def _halves(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """Walks of two hops from the heads of pairs (h, t), written."""
    return materialize(_two(e, pairs.select("h").distinct()), "halves")


def _reached(two: DataFrame, pairs: DataFrame) -> DataFrame:
    return two.join(pairs.select("h", F.col("t").alias("e")), ["h", "e"]).select("h", F.col("e").alias("t"), "program", "n")


def _by_side(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (h, t) with _ahead: whether the walks of two hops from the head are fewer, for each pair that shares them, than those into the tail."""
    count = lambda c, name: e.groupBy(c).agg(F.count("*").alias(name))
    sizes = []
    for one, other in (("h", "t"), ("t", "h")):
        near = e.select(one, other).join(count(one, "_n").withColumnRenamed(one, other), other).groupBy(one).agg(F.sum("_n").alias("_w"))
        sizes.append(pairs.groupBy(one).agg(F.count("*").alias("_f")).join(near, one, "left").select(one, (F.coalesce("_w", F.lit(0)) / F.col("_f")).alias(f"_of_{one}")))
    return pairs.join(sizes[0], "h").join(sizes[1], "t").select("h", "t", (F.col("_of_h") <= F.col("_of_t")).alias("_ahead"))


def _longer(e: DataFrame, pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(h, t, program, n): walks of two and three hops without revisits between pairs (h, t), from halves at the heads; and the tables that were written for them."""
    two = _halves(e, pairs)
    b = e.select(F.col("h").alias("mid"), F.col("r").alias("r2"), F.col("t").alias("e"), F.col("n").alias("n2"))
    last = e.select(F.col("h").alias("e"), F.col("r").alias("r3"), "t", F.col("n").alias("n3"))
    into, half = last.groupBy("t").agg(F.count("*").alias("_in")), two.groupBy("h").agg(F.count("*").alias("_out"))
    sized = materialize(pairs.join(into, "t").join(half, "h"), "ends")
    back = sized.filter("_in <= _out").select("h", "t").join(last, "t").filter("e != h").join(two, ["h", "e"])
    ahead = sized.filter("_in > _out").select("h", "t").join(two, "h").join(last, ["e", "t"])
    columns = ["h", "t", F.concat_ws("/", "program", "r3").alias("program"), (F.col("n") * F.col("n3")).alias("n")]
    walks = back.select(*columns).unionByName(ahead.select(*columns))
    cycle = b.join(last.select("e", F.col("t").alias("mid"), "r3", "n3"), ["e", "mid"]).select(F.col("mid").alias("t"), "e", F.concat_ws("/", "r2", "r3").alias("rest"), (F.col("n2") * F.col("n3")).alias("m"))
    first = e.join(pairs, ["h", "t"])
    through = ["h", "t", F.concat_ws("/", "r", "rest").alias("program")]
    off = first.join(cycle.groupBy("t", "rest").agg(F.sum("m").alias("m")), "t").select(*through, (-F.col("n") * F.col("m")).alias("n"))
    own = first.join(cycle.withColumnRenamed("e", "h"), ["t", "h"]).select(*through, (F.col("n") * F.col("m")).alias("n"))
    three = walks.unionByName(off).unionByName(own).groupBy("h", "t", "program").agg(F.sum("n").alias("n")).filter("n > 0")
    return _reached(two, pairs).unionByName(three), [two, sized]


def found_programs(edges: DataFrame, facts: DataFrame, hops: int = 2, near: bool = False, distinct: bool = False) -> DataFrame:
    """(h, r, program, n): what programs() gives for all paths of at most `hops` (1 to 3) hops without revisits between the facts' ends, counted without a row for a path.

    Paths meet in the middle: halves of one and two hops are counted by their ends, and a fact of three hops joins the two-hop half of its head with the edges into its tail, from the end that has fewer of them.
    Such a walk revisits only where its second entity is the tail itself; those are counted by the tail's two-hop cycles and taken off. Where the halves into a fact's tail are fewer for each of its facts
    than those of its head, all of that is done from the tail, on the turned graph: so no half goes from all of a hub's neighbours to all of them. A fact with equal ends has no path.
    near: the facts have few heads, so edges are first cut to those within reach of them. distinct: edges are known to be.
    """
    every = facts is edges  # then no head of an edge is without a fact
    if not 1 <= hops <= 3:
        raise ValueError("one to three hops; enumerate_paths takes more")
    if near:
        reach = facts.select("h").distinct()
        for _ in range(hops - 1):
            reach = materialize(reach.union(edges.join(reach, "h", "left_semi").select(F.col("t").alias("h"))).distinct(), "reach")
        edges = edges.join(reach, "h", "left_semi")
    own = edges.filter("h != t").select("h", step_name("r").alias("r"), "t")
    e = own.withColumn("n", F.lit(1).cast("long")) if distinct else own.groupBy("h", "r", "t").agg(F.count("*").alias("n"))
    if hops > 1 and not (distinct and every):
        e = materialize(e, "edges")
    asked = facts.select("h", "r", "t").filter("h != t")
    pairs = asked.select("h", "t").distinct()
    mine: list[DataFrame] = []
    # ends that no fact has go when the facts are joined
    out = e.select("h", "t", F.col("r").alias("program"), "n")
    if hops == 2:
        two = _two(e, None if every else pairs.select("h").distinct())
        mine = [e]
        out = out.unionByName(two.select("h", F.col("e").alias("t"), "program", "n"))
    if hops > 2:
        sided = materialize(_by_side(e, pairs), "sided")
        turned = lambda df: df.select(*(F.col(c).alias({"h": "t", "t": "h"}.get(c, c)) for c in df.columns))
        ahead, made = _longer(e, sided.filter("_ahead").select("h", "t"))
        back, more = _longer(turned(e), turned(sided.filter("not _ahead").select("h", "t")))
        back = turned(back).withColumn("program", F.array_join(F.reverse(F.split("program", "/")), "/")).select(*ahead.columns)
        out, mine = out.unionByName(ahead).unionByName(back), [e, sided, *made, *more]
    hit = out.join(asked, ["h", "t"]).filter(F.col("program") != step_name("r"))
    found = materialize(hit.groupBy("h", "r", "program").agg(F.sum("n").alias("n")), "found")
    release(*mine)
    return found


def prior(found: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(c, r, program, prior): share of a program among those of its relation, by cluster (e, c); c is null for all entities together."""
    rows = found if clusters is None else found.join(clusters.withColumnRenamed("e", "h"), "h")
    by = ["r"] if clusters is None else ["c", "r"]
    n = rows.groupBy(*by, "program").agg(F.sum("n").alias("n"))
    out = n.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    return out.select(*(["c"] if clusters is not None else []), "r", "program", "prior")


def _longest(programs_: DataFrame) -> int:
    return programs_.agg(F.max(F.size(F.split("program", "/")))).first()[0] or 0


def with_relations(facts: DataFrame, table: DataFrame) -> DataFrame:
    """Facts whose relation the table (r, program) has; relations are far fewer than facts, so no fact is shuffled."""
    return facts.join(F.broadcast(table.select("r").distinct()), "r", "left_semi")


def _uses_own(table: DataFrame) -> bool:
    """Whether a program (r, program) has a step by the relation that is asked or its inverse."""
    own = lambda x: (x == step_name("r")) | (x == step_name(inverse("r")))
    return not table.filter(F.exists(F.split("program", "/"), own)).isEmpty()


def walk(starts: DataFrame, edges: DataFrame, branch: int | None = None, hidden: DataFrame | None = None, hops: int | None = None, table: DataFrame | None = None) -> DataFrame:
    """(h, r, program, end, n): ends of the programs of rows (h, r, program), with the number of walks to each.

    One join per hop; walks that meet at an entity go on as one row with a count, so the bag of ends isn't expanded. branch: at most so many
    successors of an entity and relation, those of smallest md5. hidden: facts (h, r, t) that walks of the query (h, r) must not use, nor
    their inverses. hops: those of the longest program, else counted in the rows. table: the programs (r, program) of the rows, with no row twice;
    then edges of relations that are in none of them are left out at once, and so is hidden where no program could use it.
    """
    steps = edges.select(F.col("h").alias("end"), F.col("r").alias("name"), step_name("r").alias("step"), "t")
    if table is not None:
        steps = steps.join(F.broadcast(table.select(F.explode(F.split("program", "/")).alias("step")).distinct()), "step", "left_semi")
        hidden = hidden if hidden is not None and _uses_own(table) else None
    if branch:
        # a step is the coded name, so this is a window over an entity's edges of a relation, dealt as the joins need it
        steps = steps.withColumn("k", F.row_number().over(Window.partitionBy("end", "step").orderBy(order_by_md5("end", "name", "t")))).filter(f"k <= {branch}").drop("k")
    now = starts.select("h", "r", "program", F.col("h").alias("end"), F.lit(1).cast("long").alias("n"))
    longest = _longest(starts if table is None else table) if hops is None else hops
    size = F.size(F.split("program", "/"))
    done = now.filter("false").select("h", "r", "program", "end", "n")
    for k in range(longest):
        rows = now.withColumn("step", F.get(F.split("program", "/"), F.lit(k))).join(steps, ["end", "step"])
        if hidden is not None:
            ahead, back = (F.col("end") == F.col("h")) & (F.col("name") == F.col("r")), (F.col("t") == F.col("h")) & (F.col("name") == inverse("r"))
            rows = rows.withColumn("own", F.when(ahead, F.col("t")).when(back, F.col("end")))
            rows = rows.join(hidden.select("h", "r", F.col("t").alias("own")).distinct(), ["h", "r", "own"], "left_anti")
        now = rows.groupBy("h", "r", "program", F.col("t").alias("end")).agg(F.sum("n").alias("n"))
        over = now.filter(size == k + 1)
        done = over if k == 0 else done.unionByName(over)
        now = now.filter(size > k + 1)
    return done


def execute(queries: DataFrame, program_table: DataFrame, edges: DataFrame, branch: int | None = None) -> DataFrame:
    """(h, r, program, end, n): ends of each (h, r)'s programs (r, program), with the number of walks to each; see walk."""
    table = materialize(program_table.select("r", "program").distinct(), "programs")
    return walk(with_relations(queries.select("h", "r"), table).distinct().join(table, "r"), edges, branch, table=table)


def precision(found: DataFrame, edges: DataFrame, facts: DataFrame, clusters: DataFrame | None = None, branch: int | None = None) -> DataFrame:
    """(c, r, program, precision): of all walks of a program from heads of its relation, the share that ends in an answer."""
    ends = execute(facts, found, edges, branch)
    facts = with_relations(facts, found)
    hit = ends.join(facts.select("h", "r", F.col("t").alias("end"), F.lit(1).alias("hit")).distinct(), ["h", "r", "end"], "left")
    if clusters is not None:
        hit = hit.join(clusters.withColumnRenamed("e", "h"), "h")
    by = (["c"] if clusters is not None else []) + ["r", "program"]
    return hit.groupBy(*by).agg((F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("precision"))


def precision_partials(ends: DataFrame, facts: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(h, r, program, good, total): each entity's walks of a program, of ends (h, r, program, end, n), and how many of them end in an answer. table: the programs (r, program) of the ends, where known."""
    if table is not None:
        facts = with_relations(facts, table)
    hit = ends.join(facts.select("h", "r", F.col("t").alias("end"), F.lit(1).alias("hit")).distinct(), ["h", "r", "end"], "left")
    return hit.groupBy("h", "r", "program").agg(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("total"))


def scores_of(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, program, score) of sums (by, program, uses, good, total): prior, the share of the uses, times precision; programs without uses or walks have none."""
    of = sums.withColumn("prior", F.col("uses") / F.sum("uses").over(Window.partitionBy(*by)))
    return of.filter("uses > 0 and total > 0").select(*by, "program", (F.col("prior") * (F.col("good") / F.col("total"))).alias("score"))


def with_fallback(pairs: DataFrame, by_cluster: DataFrame, overall: DataFrame, value: str) -> DataFrame:
    """Adds value to pairs (c, r, program, ...) from the cluster's table (c, r, program), else from the overall one (r, program), else 0.

    Scores of programs fall back as a whole (see scores_of): a prior of the cluster isn't multiplied by an overall precision.
    """
    a = by_cluster.select("c", "r", "program", F.col(value).alias("_c"))
    b = overall.select("r", "program", F.col(value).alias("_a"))
    return pairs.join(a, ["c", "r", "program"], "left").join(b, ["r", "program"], "left").withColumn(value, F.coalesce("_c", "_a", F.lit(0.0))).drop("_c", "_a")


def answer_scores(ends: DataFrame, scores: DataFrame) -> DataFrame:
    """(h, r, e, score): an answer's score is the sum over its distinct programs' (r, program, score)."""
    return ends.select("h", "r", "program", F.col("end").alias("e")).distinct().join(scores, ["r", "program"]).groupBy("h", "r", "e").agg(F.sum("score").alias("score"))
