"""Operator 6: URL filters as a cascade of Bloom filters over the corpus's complete set of keys.

The keys are the hosts' endings at dots, of as many labels as listed domains have, so a host is listed if one of its
keys is. The list is a table of any size that is joined with the distinct keys once.
Level 1 holds the listed keys; level 2 those other keys of the corpus that level 1 takes for listed; level 3 the
listed keys that level 2 takes for others; and so on until a level makes no mistake. For every key of the
corpus, the level at which it first isn't found tells exactly whether it is listed. Levels are arrays of
64-bit words that reach the expression as scalar subqueries, so testing a URL needs no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import materialize

#: Verdict, host and path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Listed domains; a host is listed if it is one of them or below one.
DOMAINS = ("ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")
BITS_PER_KEY, HASHES = 12, 4
#: Bits that a first level aims at (8 MB). Keys are dealt to as many cascades as that takes, by hash.
MOST_BITS = 1 << 26
#: Cascades that are tested in one go over the pages.
AT_ONCE = 8


def host(url: str = "url") -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str = "url") -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def below(name: Column, domain: str) -> Column:
    return (name == domain) | F.endswith(name, F.lit(f".{domain}"))


def _bits(key: Column, level: int, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(size)) for i in range(HASHES)]


class Cascade:
    """Exact membership of the keys of a universe in a list, by nested filters."""

    def __init__(self, universe: DataFrame):
        """universe: distinct (key, listed)."""
        self.levels: list[tuple[int, DataFrame]] = []
        rest, among = universe, True  # among: whether this level holds listed keys
        while True:
            mine = rest.filter(F.col("listed") == among)
            keys = mine.count()
            if not keys:
                break
            size = max(64, 1 << (keys * BITS_PER_KEY - 1).bit_length())
            bit = mine.select(F.explode(F.array(*_bits(F.col("key"), len(self.levels), size))).alias("bit"))
            words = bit.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits"))
            every = words.unionByName(universe.sparkSession.range(0, size // 64, numPartitions=1).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits")))
            level = every.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("level"))
            self.levels.append((size, materialize(level, "level")))
            # the other side's keys that this level takes for its own, and this side's keys, which the next level may take for them
            rest = materialize(rest.filter((F.col("listed") == among) | self._has(F.col("key"), len(self.levels) - 1)), "keys")
            among = not among
            if len(self.levels) > 40:
                raise ValueError("the filters don't converge")

    def _has(self, key: Column, level: int) -> Column:
        size, table = self.levels[level]
        words = table.scalar()
        return reduce(lambda a, b: a & b, (F.getbit(F.get(words, (b / 64).cast("int")), (b % 64).cast("int")) == 1 for b in _bits(key, level, size)))

    def listed(self, key: Column) -> Column:
        """For keys of the universe, whether they are listed."""
        out = F.lit(len(self.levels) % 2 == 1)  # found in all levels
        for k in reversed(range(len(self.levels))):
            out = F.when(self._has(key, k), out).otherwise(F.lit(k % 2 == 1))
        return out


def listing(spark: SparkSession, domains: tuple[str, ...] | DataFrame) -> DataFrame:
    """Distinct listed domains (key), lower-cased; a table's first column has them. Null and empty ones list nothing."""
    table = domains if isinstance(domains, DataFrame) else spark.range(1).select(F.explode(F.array(*map(F.lit, domains)).cast("array<string>")).alias("domain"))
    key = F.translate(F.col(table.columns[0]), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return table.select(key.alias("key")).filter("key != ''").distinct()


def judge(pages: DataFrame, domains: tuple[str, ...] | DataFrame = DOMAINS, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Pages (url; other columns stay, but for ones of these names) with host, path, rule, listed and verdict.

    A host is listed if it is one of the domains or below one. A null url, or one without ://, has an empty host and path, no rule, and
    isn't listed. A rule fits its host and all hosts below it if the path begins with the rule's; the longest decides, then its listed order. Without a rule the cascade decides: block if listed.
    Repeated rows are judged each; no rows give no rows. A list that is too long for one cascade is dealt to several by its keys' hashes, of which AT_ONCE
    are tested in one pass over the pages; so what a task holds is bounded.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    table = pages.select(*keep, host().alias("host"), path().alias("path"))
    listed = listing(pages.sparkSession, domains)
    labels = sorted(r[0] for r in listed.select(F.size(F.split("key", "\\.")).alias("labels")).distinct().collect())
    keys = [F.substring_index("host", ".", -n) for n in labels]
    ends = table.select("host").distinct().select("host", F.explode(F.array(*keys).cast("array<string>")).alias("key"))
    universe = ends.select("key").distinct().join(listed.withColumn("listed", F.lit(True)), "key", "left")
    universe = materialize(universe.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [below(F.col("host"), h) & F.startswith("path", F.lit(p)) for _, h, p in order]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    table = table.withColumn("rule", pick([h + p for _, h, p in order]))
    table = table.withColumn("listed", F.lit(False))
    size = universe.filter("listed").count() * BITS_PER_KEY
    shards = max(1, -(-size // MOST_BITS))
    shard = lambda key: F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards))
    for k in range(shards):
        cascade = Cascade(universe.filter(shard(F.col("key")) == k) if shards > 1 else universe)
        here = [(shard(key) == k) & cascade.listed(key) if shards > 1 else cascade.listed(key) for key in keys]
        table = table.withColumn("listed", reduce(lambda a, b: a | b, here, F.col("listed")))
        if (k + 1) % AT_ONCE == 0 and k + 1 < shards:
            table = materialize(table, "pages")
    return table.withColumn("verdict", F.coalesce(pick([v for v, _, _ in order]), F.when(F.col("listed"), "block").otherwise("allow")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fit = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"when {fit(h, p)} then '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"when {fit(h, p)} then '{v}'" for v, h, p in order)
    listed = " or ".join(f"host = '{d}' or ends_with(host, '.{d}')" for d in DOMAINS)
    return f"""
        with rest as (select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest)
        select page_id, host, path, case {rule} end as rule, case {verdict} when {listed} then 'block' else 'allow' end as verdict from parts"""


SQL = _sql()
