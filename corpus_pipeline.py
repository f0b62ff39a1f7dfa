"""The corpus pipeline: five stages, each of one operator of quern.llm, from documents to packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontaminate import matched
from quern.llm.ngram_join import jaccard_join, with_own_ids
from quern.llm.packing import best_fit_pack
from quern.llm.pii import personal_data
from quern.llm.shared import documents, materialize, release, small_batches
from quern.llm.toxicity import fit, score

#: A document is rejected from this score on.
TOXIC = 0.5


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of TOXIC or more; learns from labelled documents outside the held-out fold.

    Whole texts are scored, each row by itself, whatever its id. Null and empty texts, and those without words, score 0 and stay, as do repeated rows. No rows
    give no rows. All columns stay, also ones named score or sentences.
    """
    small_batches(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole, text = _fresh(docs, "whole"), F.col("text")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "text")).alias(whole), text) if len(docs.columns) > 1 else docs.select(F.lit(0).alias(whole), text)
    kept = score(rows, model).filter(F.col("score") < TOXIC)
    return kept.select(*(text if c == "text" else F.col(whole)[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by sets of five-word shingles with a similarity of 0.8 or more: that with the smallest doc_id.

    Rows that share a doc_id, or have none, are documents of their own, after all others; so a repeated row goes because its text is there already, and a
    text isn't lost because another has its id. Documents without words (null or empty texts, too) are linked with nothing and stay. Texts of
    any length count whole. No rows give no rows. All columns stay.
    """
    small_batches(spark)
    own, gone = _fresh(docs, "own_id"), _fresh(docs, "gone_id")
    rows, _ = with_own_ids(docs, own)
    members = jaccard_join(rows.select(F.col(own).alias("doc_id"), "text"), n=5, percent=80, own=True)[0]
    copies = members.filter("component_id != doc_id").select(F.col("doc_id").alias(gone))
    return rows.join(copies, F.col(own) == F.col(gone), "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage that aligns with a benchmark item.

    Whole texts are searched, each row by itself, whatever its id, so rows without one or with a repeated one are judged, too. Null and empty texts match nothing
    and stay. No rows or no items: all rows. All columns stay.
    """
    small_batches(spark)
    found = _fresh(docs, "found")
    rows = matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), found)
    return rows.filter(F.size(found) == 0).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows where it is a column.

    Whole texts are searched, each row by itself. Null and empty texts, and those without personal data, stay as they are; no rows give no rows. All columns
    stay, also ones named pii or redacted.
    """
    small_batches(spark)
    whole, text = _fresh(docs, "whole"), F.col("redacted")
    rest = [c for c in docs.columns if c != "text"]
    out = personal_data(docs.select(F.struct(*(docs[c] for c in rest)).alias(whole), "text") if rest else docs)
    values = {c: F.col(whole)[c] for c in rest} | {"text": text}
    if "n_chars" in rest:
        values["n_chars"] = F.when(F.size("pii") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(values["n_chars"])
    return out.select(*(values[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' tokens into sequences: a row per piece, as best_fit_pack returns them.

    Whole texts are encoded. A null or empty text is one piece of the end token; a null doc_id stays null; repeated rows are packed each. No rows give
    no rows. Of the columns, doc_id stays.
    """
    small_batches(spark)
    return best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Learned scores and a tokenizer's ids can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and reread as the next one's input."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            release(before)
    return docs
