"""One-hop signatures and nearest entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tables import materialize
from quern.operators.vocab import coded, plain


def signatures(edges: DataFrame) -> DataFrame:
    """(e, r, w): the relations that leave an entity, each weighing 1 / sqrt(their number), so that a signature has length 1."""
    own = edges.select(F.col("h").alias("e"), "r").distinct()
    return own.withColumn("w", 1 / F.sqrt(F.count("*").over(Window.partitionBy("e")).cast("double")))


def groups(signature: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with equal signatures together: (e, sig), the relations joined by commas (a comma in a name is percent-coded), and the distinct signatures in long form (sig, r, w). There are far fewer of them."""
    text = signature.groupBy("e").agg(F.array_join(F.array_sort(F.collect_list(coded("r", ","))), ",").alias("sig"))
    long = text.select("sig").distinct().select("sig", _relations())
    return text, long.withColumn("w", 1 / F.sqrt(F.count("*").over(Window.partitionBy("sig")).cast("double")))


def _relations() -> Column:
    """A signature's relations, a row each, as r."""
    return F.explode(F.transform(F.split("sig", ","), lambda r: plain(r, ","))).alias("r")


def cosine(long: DataFrame, key: str = "sig") -> DataFrame:
    """(a, b, sim) of all pairs of distinct keys that share a relation: a sparse product over the relations."""
    x, y = (long.select(F.col(key).alias(n), "r", F.col("w").alias(f"w{n}")) for n in ("a", "b"))
    return x.join(y, "r").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))


#: Similarities at which the nearest are looked for, one after the other; those who have enough neighbours at one don't go on to the next.
LEVELS = (1.0, 0.85, 0.7, 0.5, 0.0)


def indexed(long: DataFrame) -> DataFrame:
    """(sig, rs, n) of distinct signatures in long form (sig, r): the relations of each, those of the fewest signatures first, and how many they are."""
    rare = long.groupBy("r").agg(F.count("*").alias("_f"))
    own = long.join(rare, "r").groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("_f", "r"))).alias("_x"))
    return own.select("sig", F.transform("_x", lambda x: x["r"]).alias("rs"), F.size("_x").alias("n"))


def candidates(some: DataFrame, every: DataFrame, least: float) -> DataFrame:
    """(a, b, ra, rb): pairs of a signature of `some` and one of all (see indexed) that can have a cosine of `least` or more.

    Of sets of n and m relations with such a cosine, each has at least least * least of the other's size, so of each all but ceil(least * least * n) - 1 of its relations, the rarest, must hold a common one. Only those are joined.
    """
    few = lambda n: F.ceil(F.lit(least * least - 1e-9) * n) if least > 0 else F.lit(1)
    first = lambda df, c: df.select(F.col("sig").alias(c), F.col("rs").alias(f"r{c}"), F.col("n").alias(f"n{c}"), F.posexplode(F.slice("rs", 1, (F.col("n") - F.greatest(few(F.col("n")), F.lit(1)) + 1).cast("int"))).alias(f"p{c}", "r"))
    x, y = first(some, "a"), first(every, "b")
    rows = x.join(y, "r").filter((F.col("nb") >= F.col("na") * (least * least - 1e-9)) & (F.col("na") >= F.col("nb") * (least * least - 1e-9)))
    # from their rarest common relation on, the two must have enough relations left
    rows = rows.filter(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= (least - 1e-9) * F.sqrt((F.col("na") * F.col("nb")).cast("double")))
    # a pair is kept at that one only; both arrays are in the same order
    return rows.filter(F.array_intersect("ra", "rb")[0] == F.col("r")).select("a", "b", "ra", "rb")


def similar(some: DataFrame, every: DataFrame, least: float) -> DataFrame:
    """(a, b, sim): signatures of `some` and of all (see indexed) with a cosine of `least` or more; for 0, all that share a relation."""
    if least >= 1:
        return some.select(F.col("sig").alias("a"), F.col("sig").alias("b"), F.lit(1.0).alias("sim"))
    pairs = candidates(some, every, least)
    return pairs.select("a", "b", (F.size(F.array_intersect("ra", "rb")) / F.sqrt((F.size("ra") * F.size("rb")).cast("double"))).alias("sim")).filter(F.col("sim") >= least - 1e-9)


def neighbours(queries: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(h, r, e, sim, place) for each query (h, r): the k entities most like h that have relation r, without h itself.

    Signatures are compared once per distinct pair, and only as far as needed: first with equal ones, then with those above a falling bound, until a query's signature has enough entities above it. Of each signature and
    relation at most k + 1 entities, those first by name, can be among the nearest, so a common signature doesn't multiply the rows.
    """
    of = materialize(groups(signatures(edges))[0], "signatures")
    every = materialize(indexed(of.select("sig").distinct().select("sig", _relations())), "indexed")
    having = of.select("e", "sig", _relations())
    first = materialize(having.withColumn("i", F.row_number().over(Window.partitionBy("sig", "r").orderBy("e"))).filter(f"i <= {k + 1}").select("r", "e", F.col("sig").alias("b")), "first")
    near = queries.select("h", "r").distinct().join(of.withColumnRenamed("e", "h").withColumnRenamed("sig", "a"), "h")
    left = materialize(near.select("a", "r").distinct(), "asked")
    w = Window.partitionBy("a", "r").orderBy(F.round("sim", 9).desc(), "e")
    short = None
    for least in LEVELS:
        some = every.join(left.select(F.col("a").alias("sig")).distinct(), "sig", "left_semi")
        rows = left.join(similar(some, every, least), "a").join(first, ["b", "r"])
        rows = materialize(rows.withColumn("i", F.row_number().over(w)).filter(f"i <= {k + 1}").select("a", "r", "e", "sim"), "near")
        enough = rows.groupBy("a", "r").agg(F.count("*").alias("_n")).filter((F.col("_n") > k) | F.lit(least <= 0))
        part = rows.join(enough.select("a", "r"), ["a", "r"], "left_semi")
        short = part if short is None else short.unionByName(part)
        left = materialize(left.join(enough, ["a", "r"], "left_anti"), "asked")
        if left.isEmpty():
            break
    out = near.join(short, ["a", "r"]).filter("e != h")
    w = Window.partitionBy("h", "r").orderBy(F.round("sim", 9).desc(), "e")
    return out.withColumn("place", F.row_number().over(w)).filter(f"place <= {k}").select("h", "r", "e", "sim", "place")


def naive_neighbours(queries: DataFrame, edges: DataFrame, k: int = 5, seed: str = "nn") -> DataFrame:
    """(h, r, e, place) for each query (h, r): k entities that have the relation, without h itself, in an order of md5 that is the same for all queries of a relation."""
    from quern.operators.paths import order_by_md5

    having = edges.select("r", F.col("h").alias("e")).distinct()
    first = having.withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy(order_by_md5("r", "e", seed=seed)))).filter(F.col("i") <= k + 1)
    out = queries.select("h", "r").distinct().join(F.broadcast(first), "r").filter("e != h")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("h", "r").orderBy("i")).cast("long")).filter(F.col("place") <= k).select("h", "r", "e", "place")


def nearest_relations(edges: DataFrame, k: int = 3) -> DataFrame:
    """(a, b, sim, place): of each relation the k others whose sets of heads are most like its own, by cosine."""
    heads = edges.select("r", F.col("h").alias("e")).distinct()
    size = heads.groupBy("r").agg(F.count("*").cast("double").alias("n"))
    # heads with the same relations are counted together, so no head is expanded into pairs
    own = heads.groupBy("e").agg(F.array_sort(F.collect_list("r")).alias("rs")).groupBy("rs").agg(F.count("*").alias("heads"))
    pairs = own.select("heads", F.explode("rs").alias("a"), "rs").select("heads", "a", F.explode("rs").alias("b")).filter("a != b").groupBy("a", "b").agg(F.sum("heads").alias("both"))
    sim = pairs.join(size.select(F.col("r").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("r").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("both") / F.sqrt(F.col("na") * F.col("nb"))).alias("sim"))
    w = Window.partitionBy("a").orderBy(F.round("sim", 9).desc(), "b")
    return sim.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)
