"""A labelled graph derived from the star-schema tables, as DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First hex digits of md5 that put an edge into a split; all others are train.
TEST, VALID = ("e", "f"), ("c", "d")


def _name(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def graph(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    """Distinct (h, r, t, split). typed: placed and contains are split by priority and return flag."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, supplier, nation, orders, lineitem = map(table, ("customer", "supplier", "nation", "orders", "lineitem"))
    edge = lambda df, h, r, t: df.select(h.alias("h"), (F.lit(r) if isinstance(r, str) else r).alias("r"), t.alias("t"))
    placed = F.concat(F.lit("placed_"), F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9]+", "_")) if typed else "placed"
    contains = F.concat(F.lit("contains_"), F.lower("l_returnflag")) if typed else "contains"
    parts = [
        edge(customer, _name("c", "c_custkey"), "in_nation", _name("n", "c_nationkey")),
        edge(supplier, _name("s", "s_suppkey"), "based_in", _name("n", "s_nationkey")),
        edge(nation, _name("n", "n_nationkey"), "in_region", _name("r", "n_regionkey")),
        edge(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), _name("c", "c_custkey"), "region_of", _name("r", "n_regionkey")),
        edge(orders, _name("c", "o_custkey"), placed, _name("o", "o_orderkey")),
        edge(lineitem, _name("o", "l_orderkey"), contains, _name("p", "l_partkey")),
        edge(orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey")), _name("c", "o_custkey"), "bought", _name("p", "l_partkey")),
        edge(lineitem, _name("s", "l_suppkey"), "supplies", _name("p", "l_partkey")),
    ]
    out = None
    for k, p in enumerate(parts):
        # relations have names of their own, and only orders' lines can repeat an edge: those three are made distinct, the others are keyed by their table
        p = p.distinct() if k in (5, 6, 7) else p
        out = p if out is None else out.unionByName(p)
    digit = F.substring(F.md5(F.concat_ws("|", "h", "r", "t").cast("binary")), 1, 1)
    return out.withColumn("split", F.when(digit.isin(*TEST), "test").when(digit.isin(*VALID), "valid").otherwise("train"))


def sql(typed: bool = False) -> str:
    """The same as common table expressions: edges (h, r, t, split), and its parts train, valid and test."""
    placed = "'placed_' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g')" if typed else "'placed'"
    contains = "'contains_' || lower(l_returnflag)" if typed else "'contains'"
    return f"""
    raw as (
      select 'c' || c_custkey as h, 'in_nation' as r, 'n' || c_nationkey as t from customer
      union select 's' || s_suppkey, 'based_in', 'n' || s_nationkey from supplier
      union select 'n' || n_nationkey, 'in_region', 'r' || n_regionkey from nation
      union select 'c' || c_custkey, 'region_of', 'r' || n_regionkey from customer join nation on c_nationkey = n_nationkey
      union select 'c' || o_custkey, {placed}, 'o' || o_orderkey from orders
      union select 'o' || l_orderkey, {contains}, 'p' || l_partkey from lineitem
      union select 'c' || o_custkey, 'bought', 'p' || l_partkey from orders join lineitem on o_orderkey = l_orderkey
      union select 's' || l_suppkey, 'supplies', 'p' || l_partkey from lineitem),
    edges as (select *, case when substr(md5(h || '|' || r || '|' || t), 1, 1) in ('e', 'f') then 'test' when substr(md5(h || '|' || r || '|' || t), 1, 1) in ('c', 'd') then 'valid' else 'train' end as split from raw),
    train as (select h, r, t from edges where split = 'train'), valid as (select h, r, t from edges where split = 'valid'), test as (select h, r, t from edges where split = 'test')"""
