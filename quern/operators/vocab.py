"""Vocabularies, names and inverse edges. Graphs are DataFrames with h, r, t (strings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tables import materialize

INVERSE = "_inv"


def inverse(r: Column | str, suffix: str = INVERSE) -> Column:
    """Name of the inverse relation; its own inverse is the name itself."""
    r = F.col(r) if isinstance(r, str) else r
    return F.when(r.endswith(suffix), F.substring(r, F.lit(1), F.length(r) - len(suffix))).otherwise(F.concat(r, F.lit(suffix)))


def coded(name: Column | str, mark: str) -> Column:
    """A name in which `mark`, and the percent sign, are percent-coded, so that names joined by that mark can be told apart; other names stay as they are."""
    name = F.col(name) if isinstance(name, str) else name
    return F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit(mark), F.lit(f"%{ord(mark):02X}"))


def plain(name: Column, mark: str) -> Column:
    """The name that coded() was given."""
    return F.replace(F.replace(name, F.lit(f"%{ord(mark):02X}"), F.lit(mark)), F.lit("%25"), F.lit("%"))


def key(*columns: str) -> Column:
    """Names joined by bars, as one text that no other names give."""
    return F.concat_ws("|", *(coded(c, "|") for c in columns))


def is_inverse(r: Column | str, suffix: str = INVERSE) -> Column:
    return (F.col(r) if isinstance(r, str) else r).endswith(suffix)


def with_inverses(edges: DataFrame, suffix: str = INVERSE) -> DataFrame:
    """Every edge and its inverse; other columns go along. One pass, no shuffle."""
    rest = [c for c in edges.columns if c not in ("h", "r", "t")]
    both = F.array(F.struct("h", "r", "t"), F.struct(F.col("t").alias("h"), inverse("r", suffix).alias("r"), F.col("h").alias("t")))
    return edges.select(F.explode(both).alias("e"), *rest).select("e.h", "e.r", "e.t", *rest)


def entities(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("h", "t")).alias("e")).distinct()


def heads_by_relation(edges: DataFrame) -> DataFrame:
    """(r, h, n): heads of each relation, with how often; long form instead of a list per relation, which would not be bounded."""
    return edges.groupBy("r", "h").agg(F.count("*").alias("n"))


def numbered(names: DataFrame, order: list[Column], first: int = 0) -> DataFrame:
    """Adds id, dense numbers in a global order. Rows are sorted by ranges and written once; each range numbers its own rows and adds the sizes of those before it.

    So the sort isn't planned again for the sizes, and no window has all rows; the sizes are a row for each range.
    """
    ranged = names.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged")
    # the id's low 33 bits count rows within a partition
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn("id", (F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + first).cast("long")).drop("_p", "_i", "_before")


def frequency_vocab(edges: DataFrame, reserved: int = 2, distinct: bool = False) -> DataFrame:
    """(name, freq, id): entities by frequency over distinct edges, then by name; ids start after the reserved ones. distinct: edges are known to be."""
    edges = edges.select("h", "r", "t")
    names = (edges if distinct else edges.distinct()).select(F.explode(F.array("h", "t")).alias("name")).groupBy("name").agg(F.count("*").alias("freq"))
    return numbered(names, [F.desc("freq"), F.asc("name")], reserved)


def relation_vocab(edges: DataFrame, reserved: int = 3) -> DataFrame:
    """(name, freq, id) of relations and their inverses."""
    names = with_inverses(edges.select("h", "r", "t").distinct()).groupBy(F.col("r").alias("name")).agg(F.count("*").alias("freq"))
    return numbered(names, [F.desc("freq"), F.asc("name")], reserved)


def lexical_vocab(edges: DataFrame) -> DataFrame:
    return numbered(entities(edges).select(F.col("e").alias("name")), [F.asc("name")], 0)


def first_seen_vocab(edges: DataFrame, order: list[str]) -> DataFrame:
    """Ids by first appearance in the given order of edges, heads before tails."""
    place = edges.select(F.posexplode(F.array("h", "t")).alias("side", "name"), F.struct(*order).alias("at")).groupBy("name").agg(F.min(F.struct("at", "side")).alias("at"))
    return numbered(place, [F.asc("at"), F.asc("name")], 0).select("name", "id")


def type_histogram(edges: DataFrame) -> DataFrame:
    """Entities by type; here the type is the name without its digits."""
    return entities(edges).groupBy(F.regexp_replace("e", "[0-9]+", "").alias("etype")).agg(F.count("*").alias("n"))


def type_by_token(name: str, token: int, sep: str = "_", other: str = "none") -> Column:
    """The given token of a name, from 1; names without one are of the type `other`."""
    return F.coalesce(F.nullif(F.get(F.split(name, sep), F.lit(token - 1)), F.lit("")), F.lit(other))


def index_lines(names: DataFrame, reserved: list[str]) -> DataFrame:
    """(id, line): a vocabulary's lines of name, tab and frequency; reserved names, of frequency -1, have the first ids."""
    first = names.sparkSession.createDataFrame([(k, f"{x}\t-1") for k, x in enumerate(reserved)], "id long, line string")
    return first.unionByName(names.select("id", F.concat_ws("\t", "name", F.col("freq").cast("string")).alias("line")))


def encode(edges: DataFrame, names: DataFrame, relations: DataFrame) -> DataFrame:
    """Names to ids; edges with an unknown name go. The relation table is small and is broadcast by the planner where it fits."""
    e = names.select("name", "id")
    out = edges.join(e.select(F.col("name").alias("h"), F.col("id").alias("h_id")), "h").join(e.select(F.col("name").alias("t"), F.col("id").alias("t_id")), "t")
    return out.join(relations.select(F.col("name").alias("r"), F.col("id").alias("r_id")), "r").select("h_id", "r_id", "t_id")


def decode(ids: DataFrame, names: DataFrame, relations: DataFrame) -> DataFrame:
    e = names.select("name", "id")
    out = ids.join(e.select(F.col("id").alias("h_id"), F.col("name").alias("h")), "h_id").join(e.select(F.col("id").alias("t_id"), F.col("name").alias("t")), "t_id")
    return out.join(relations.select(F.col("id").alias("r_id"), F.col("name").alias("r")), "r_id").select("h", "r", "t")


def repeated(edges: DataFrame) -> DataFrame:
    """Facts that occur more than once."""
    return edges.groupBy("h", "r", "t").agg(F.count("*").alias("n")).filter("n > 1")
