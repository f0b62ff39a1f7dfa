"""Operator 10: secrets, told apart by how many own them.

Candidates are found with regular expressions inside the engine. A candidate's hash is then counted over the
whole corpus by distinct repositories (documents) and owners (sources): values that many owners carry are
examples, values of a few owners that look random are live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import documents, materialize

#: Kinds in the order of their reports, with their patterns; the first three are the base.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "key": r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|[rs]k_live_[A-Za-z0-9]{24,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
KINDS = tuple(PATTERNS)
_OPEN, _CLOSE, _NONE = "﷐", "﷑", "﷒"  # noncharacters; a text that holds the first two has them replaced, one code point each


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Parts that one fold adds up; it copies what it has for each, so that many squared is the cost of so many parts, whatever their number.
_RUN = 128


def _places(lengths: Column) -> Column:
    """Array of the sums of the entries before each. Runs of entries are folded by themselves and then lifted by the runs before them."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    none = F.array().cast("array<int>")

    def within(run: Column) -> Column:
        return F.aggregate(run, F.struct(F.lit(0).alias("sum"), none.alias("out")), lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out")))["out"]

    def lifted(runs: Column) -> Column:
        return _let(within(F.transform(runs, total)), lambda before: F.flatten(F.transform(runs, lambda run, i: F.transform(within(run), lambda x: x + F.get(before, i)))))

    runs = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(_RUN)), lambda i: F.slice(lengths, i, F.lit(_RUN)))
    return _let(runs, lifted)


def _matches(text: Column, kind: str) -> Column:
    """Array of (start, no, end, kind, value) of the kind's matches: marks are put around them, and the parts' lengths give their places."""
    pattern, no = PATTERNS[kind], KINDS.index(kind)
    value = (lambda m: F.regexp_extract(m, pattern, 2)) if kind == "assign" else (lambda m: m)

    def spans(parts: Column) -> Column:
        # every part but the first begins with a match and has one mark more than the text
        def of(places: Column) -> Column:
            def span(part: Column, i: Column) -> Column:
                found, start = F.substring_index(part, _CLOSE, 1), F.get(places, i + 1) - i
                return F.struct(start.alias("start"), F.lit(no).alias("no"), (start + F.length(found)).alias("end"), F.lit(kind).alias("kind"), value(found).alias("value"))

            return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), span)

        return _let(_places(F.transform(parts, lambda p: F.length(p))), of)

    out = _let(F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN), spans)
    return F.filter(out, lambda s: F.length(s["value"]) >= 6) if kind == "assign" else out


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, owner and spans: all matches by start, then kind. Null or empty text: none."""
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), F.translate(text, _OPEN + _CLOSE, _NONE * 2)).otherwise(text)
    columns = [F.col(owner).cast("string").alias("owner") if owner in docs.columns else F.lit(None).cast("string").alias("owner")]
    found = docs.select("doc_id", *columns, text.alias("text")).select("doc_id", "owner", *(_matches(F.col("text"), k).alias(k) for k in KINDS))
    return found.select("doc_id", "owner", F.array_sort(F.concat(*KINDS)).alias("spans"))


def secrets(docs: DataFrame, owner: str = "source", shared_by: int = 3) -> DataFrame:
    """doc_id, spans (start, no, end, kind, value), n_live and n_shared for each row of docs (doc_id, text, owner; others are ignored).

    A value that at least `shared_by` owners have in the corpus is a shared example. Of the rest, those of 16 characters or more with
    letters and digits count as live. Rows without an owner count as one owner's, rows without a doc_id as one repository's (of no count where all have none).
    Repeated rows are judged each and count as one repository. Null and empty texts have no spans; texts of any length are searched whole; no rows give no rows.
    """
    table = materialize(candidates(docs, owner).withColumn("row", F.monotonically_increasing_id()), "candidates")
    seen = table.filter(F.size("spans") > 0).select("row", "doc_id", F.coalesce("owner", F.lit("")).alias("owner"), F.explode("spans").alias("s"))
    seen = seen.select("row", "doc_id", "owner", F.sha2("s.value", 256).alias("hash"), ((F.length("s.value") >= 16) & F.col("s.value").rlike("[A-Za-z]") & F.col("s.value").rlike("[0-9]")).alias("random")).distinct()
    # aggregates with partial sums, so a value in every document is no hot key
    count = lambda column, name: seen.select("hash", column).distinct().groupBy("hash").agg(F.count("*").alias(name))
    use = count("doc_id", "n_repos").join(count("owner", "n_owners"), "hash")
    verdict = seen.join(use, "hash").groupBy("row").agg(
        F.count_if(F.col("random") & (F.col("n_owners") < shared_by)).alias("n_live"), F.count_if(F.col("n_owners") >= shared_by).alias("n_shared"), F.max("n_repos").alias("most_repos")
    )
    return table.join(verdict, "row", "left").select("doc_id", "spans", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_shared", "most_repos")))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir).select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["no"] < 3)
    number = lambda no: F.size(F.filter("spans", lambda s: s["no"] == no)).cast("long")
    return found.select(
        "doc_id", *(number(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"), "n_live", "n_shared", "most_repos",
    )
