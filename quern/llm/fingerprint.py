"""Operator 9: document fingerprints of closed syncmers.

A k-mer (k code points) is kept if the smallest hash of its inner s-mers belongs to the first or the last of
them. That depends on the k-mer alone, so equal passages give equal anchors wherever they stand. A fingerprint
is all anchors of a text, places and hashes in the text's order: likeness and containment of two texts are counted
from it, and common hashes tell where their passages agree. Texts are cut as UTF-32 bytes, where a code point's place is a multiplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import documents, materialize

K, S = 16, 9


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _anchors(text: Column, use, k: int = K, s: int = S) -> Column:
    """Array of use(i, hash) of the text's closed syncmers, i their position in code points.

    A k-mer's hash is made of its first and last s-mer's, which cover it (2 * s >= k). A text shorter than k is one anchor; an empty
    or null one has none.
    """

    def anchors(b: Column) -> Column:
        def closed(h: Column) -> Column:
            inner = lambda i: [F.get(h, i + j) for j in range(k - s + 1)]
            at = F.filter(F.sequence(F.lit(0), F.size(h) - (k - s + 1)), lambda i: F.least(*inner(i)) == F.least(F.get(h, i), F.get(h, i + (k - s))))
            return F.transform(at, lambda i: use(i, F.xxhash64(F.get(h, i), F.get(h, i + (k - s)))))

        smers = F.transform(F.sequence(F.lit(1), F.length(b) - (4 * s - 1), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * s))))
        whole = F.array(use(F.lit(0), F.xxhash64(b)))
        return F.when(F.length(b) >= 4 * k, _let(smers, closed)).when(F.length(b) > 0, whole).otherwise(F.slice(whole, 1, 0))

    return _let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), anchors)


def syncmers(text: Column) -> Column:
    """Array of (pos, hash) of the text's closed syncmers, by position."""
    return _anchors(text, lambda i, h: F.struct(i.alias("pos"), h.alias("hash")))


def fingerprint(text: Column) -> Column:
    """Struct of the arrays pos and hash: all closed syncmers of the text, by position."""
    return _let(syncmers(text), lambda a: F.struct(a["pos"].alias("pos"), a["hash"].alias("hash")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of hashes in two arrays. Two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def _before(ranges: DataFrame, most: int, step: int = 1024) -> DataFrame:
    """(range, before) of distinct ranges: the one before each; the first has null.

    `step` ranges at a time are sorted; of the groups of ranges, which are far fewer where ranges are dense and wider at each level, the ones before
    are found alike, until at most `most` are left.
    """
    if ranges.count() <= most:
        return ranges.select("range", F.lag("range").over(Window.orderBy("range")).alias("before"))
    up = materialize(ranges.select("range", F.floor(F.col("range") / step).cast("long").alias("up")), "ranges")
    last = up.groupBy("up").agg(F.max("range").alias("last"))
    above = _before(up.select(F.col("up").alias("range")).distinct(), most, step)
    into = above.select(F.col("range").alias("up"), F.col("before").alias("up_before")).join(last.select(F.col("up").alias("up_before"), "last"), "up_before", "left").select("up", "last")
    return up.join(into, "up").select("range", F.coalesce(F.lag("range").over(Window.partitionBy("up").orderBy("range")), "last").alias("before"))


def with_next(docs: DataFrame, columns: list[str], late: dict[str, Column] | None = None, width: int = 32, most: int = 100_000) -> DataFrame:
    """Adds next_<c> for each column or field, of the row with the next doc_id (after the last: the first); equal ids go by text, a null id is the lowest.

    Rows are dealt by ranges of ids, `width` wide or wider, so that there are at most about `most` ranges in dense ids. A range's first
    row is also dealt to the range before it, where it is looked at and dropped. The table of ranges is broadcast if it is small. `late` has further
    columns by name, computed where rows have been dealt and so not shuffled; `columns` may name them.
    """
    n = docs.count()
    width = max(width, n // most)
    low = F.lit(-(2**62))
    at = F.floor(F.coalesce("doc_id", low) / width).cast("long")
    firsts = materialize(docs.select("doc_id").groupBy(at.alias("range")).agg(F.min(F.coalesce("doc_id", low)).alias("first")), "firsts")
    around = firsts.agg(F.max("range")).first()[0]
    firsts = firsts.join(_before(firsts.select("range"), most), "range").select("first", F.coalesce("before", F.lit(around)).alias("before"))
    firsts = materialize(firsts, "ranges")
    if firsts.count() <= 10 * most:
        firsts = F.broadcast(firsts)
    rows = docs.join(firsts, F.coalesce("doc_id", low) == F.col("first"), "left").drop("first")
    own = F.struct(at.alias("range"), F.lit(False).alias("ahead"))
    dealt = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead"))))
    rows = rows.withColumn("deal", F.explode(dealt)).select(*docs.columns, "deal.range", "deal.ahead")
    rows = rows.repartition("range").withColumns(late or {})
    by = Window.partitionBy("range").orderBy("ahead", F.col("doc_id").asc_nulls_first(), "text")
    return rows.select("*", *(F.lead(c).over(by).alias(f"next_{c.split('.')[-1]}") for c in columns)).filter(~F.col("ahead")).drop("range", "ahead")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint for each row of docs (doc_id, text; others are ignored).

    Equal texts have equal fingerprints, of whole texts however long; an empty or null text's has empty arrays. Repeated rows get one each, whatever their ids; no rows give no rows.
    """
    return docs.select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, ["text", "fingerprint.hash"], {"fingerprint": fingerprint(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_hash")
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint.hash"), F.col("edited_fingerprint.hash")).alias("near_edited"), likeness(F.col("fingerprint.hash"), F.col("next_hash")).alias("near_next"),
    )
