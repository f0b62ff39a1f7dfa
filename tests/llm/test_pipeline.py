"""Every stage of the pipeline: its effect, odd rows, clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quern.llm import ngram_join, shared

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lamda", "mu", "nu", "xi", "omicron", "pi"]


def prose(k, n=40):
    return " ".join(f"{WORDS[(k + i) % 16]}{k}x{i}" for i in range(n))


ITEM = " ".join(f"item{i}" for i in range(25))
SCHEMA = "doc_id long, text string, score string, sentences int, whole string, found string, own_id int, pii string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (None, "ab")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(i, prose(i) + (". you vile worm go away now." if i % 3 == 0 else ".")) for i in range(90)]
    rows += [(None, prose(200)), (None, prose(201)), (None, None), (500, ""), (501, "   "), (502, f"{prose(210)} {ITEM}"), (None, f"{prose(211)} {ITEM}")]
    rows += [(600, prose(220)), (601, prose(220)), (600, prose(221)), (602, prose(221)), (603, "mail a.b@c.example.org now"), (None, "ring +1 (555) 010-9999 now"), (604, "long " * 30_000), (604, "long " * 30_000)]
    spark.createDataFrame([(i, t, "s", 1, "w", "f", 3, "p", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    return d


def stage(spark, tables, name, docs=None):
    return dict(cp.STAGES)[name](spark, spark.read.parquet(f"{tables}/documents.parquet") if docs is None else docs, tables)


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "pii"])
def test_columns_stay_and_empty_tables_are_empty(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = stage(spark, tables, name)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert {tuple(r) for r in out.select("score", "sentences", "whole", "found", "own_id", "pii").distinct().collect()} == {("s", 1, "w", "f", 3, "p")}
    assert stage(spark, tables, name, docs.filter("false")).count() == 0
    only = docs.select("doc_id", "text")
    assert stage(spark, tables, name, only).columns == ["doc_id", "text"]


def test_packing_of_empty_and_odd_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert stage(spark, tables, "packing", docs.filter("false")).count() == 0
    got = stage(spark, tables, "packing")
    firsts = got.filter("piece = 0")
    assert firsts.count() == docs.count() and firsts.filter("doc_id is null").count() == docs.filter("doc_id is null").count()
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_toxic_documents_go(spark, tables):
    kept = {r.doc_id for r in stage(spark, tables, "toxicity").collect()}
    assert not {i for i in range(90) if i % 3 == 0} & kept and {i for i in range(90) if i % 3} <= kept and {500, 501, None} <= kept


def test_one_of_each_group_stays_and_no_text_is_lost(spark, tables):
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), stage(spark, tables, "near_duplicates")
    texts = lambda df: {r.text for r in df.select("text").collect()}
    assert texts(out) == texts(docs)  # all groups here are of equal texts
    by = {}
    for r in out.collect():
        by.setdefault(r.text, []).append(r.doc_id)
    assert by[prose(220)] == [601] or by[prose(220)] == [600]
    assert len(by[prose(221)]) == 1 and len(by["long " * 30_000]) == 1 and by[None] == [None] and by[""] == [500]


def test_texts_under_one_id_are_kept_apart(spark):
    docs = spark.createDataFrame([(1, prose(1)), (1, prose(2)), (2, prose(2)), (None, prose(3)), (3, prose(3)), (None, prose(3))], "doc_id long, text string").repartition(2)
    out = cp.near_duplicates(spark, docs, "")
    assert found(out) == sorted((False, i, prose(k)) for i, k in ((1, 1), (2, 2), (3, 3))) or found(out) == sorted((False, i, prose(k)) for i, k in ((2, 2), (3, 3), (1, 1)))
    members = ngram_join.jaccard_join(docs)[0].collect()
    assert len(members) == 6 and {r.component_id for r in members if r.doc_id in (2, 3)} == {1, 3}


def test_contaminated_rows_go_whatever_their_ids(spark, tables):
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), stage(spark, tables, "decontamination")
    assert out.filter(F.contains("text", F.lit("item5"))).count() == 0 and out.count() == docs.count() - 2


def test_personal_data_is_replaced(spark, tables):
    out = stage(spark, tables, "pii")
    changed = {r.text: r.n_chars for r in out.filter("text like '%<%'").collect()}
    assert changed == {"mail <EMAIL> now": 16, "ring <PHONE> now": 16}
    assert out.filter("text is null").count() == 1


def test_all_stages_together(spark, tables):
    got = cp.run(spark, tables).collect()
    ids = {r.doc_id for r in got}
    assert not {i for i in range(90) if i % 3 == 0} & ids and 502 not in ids and {1, 2, 500, 603} <= ids


def test_tables_are_deleted(spark):
    t = shared.materialize(spark.range(5).toDF("x"), "gone")
    path = spark._jvm.org.apache.hadoop.fs.Path(t.inputFiles()[0]).getParent()
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(path)
    shared.release(t)
    assert not files.exists(path)


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())
