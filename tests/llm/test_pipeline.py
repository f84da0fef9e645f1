"""The corpus pipeline and the registered queries on the smallest tables."""

import __spark_entry__
import corpus_pipeline
import pytest
from planewise.llm import common, queries


@pytest.fixture
def uncoalesced(spark):
    """Spark may not coalesce the partitions of a shuffle."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_every_operator_has_one_query():
    names = [q for q in queries.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11))
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, count = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, sf_dir), name)
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
        count.append(kept.count())
    assert count == sorted(count, reverse=True) and count[0] > count[2] > count[3] == count[4] > 0
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(3).selectExpr("doc_id", "text", "NULL AS lang", "NULL AS source", "n_chars").union(docs.limit(2).selectExpr("NULL", "NULL", "lang", "source", "NULL"))
    odd = docs.union(extra).selectExpr("*", "1 AS k", "'x' AS component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = corpus_pipeline.written(stage(spark, odd, sf_dir), name)
        assert odd.columns == [*docs.columns, "k", "component_id"]
    ids = [r.doc_id for r in odd.collect()]
    assert len(ids) == len(set(ids))
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_near_duplicates_without_or_with_repeated_ids(spark, sf_dir):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a"))] * 3 + [(None, text("a") + " more"), (None, text("b")), (7, text("b")), (8, text("b")), (9, text("c")), (9, text("c").upper()), (9, text("c") + " more"), (9, text("d")), (5, "short"), (6, "short")]
    docs = spark.createDataFrame([(i, t, "xx", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    assert len(got) == len(set(got)) == 5
    assert {(7, text("b")), (9, text("d")), (5, "short")} <= set(got)
    assert sum(i is None and t.startswith("a0 ") for i, t in got) == 1 and sum(i == 9 and t.lower().startswith("c0 ") for i, t in got) == 1


def test_written_tables_have_few_files(spark, uncoalesced, monkeypatch):
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    df, none = spark.range(5000).selectExpr("id", "id % 7 AS m").repartition(50, "id"), cached()
    made = common.written(df, "few")
    assert 1 < len(made.inputFiles()) <= 8 and sorted(made.collect()) == sorted(df.collect())
    assert common.written(df.where("id < 0"), "few").count() == 0
    monkeypatch.setattr(common, "_FILE_BYTES", 4000)
    made = common.written(df, "few")
    assert 8 < len(made.inputFiles()) < 25 and sorted(made.collect()) == sorted(df.collect())
    assert cached() == none
    df.cache()
    assert common.written(df, "few").count() == 5000 and df.storageLevel.useMemory
    df.unpersist()


def test_near_duplicates_where_spark_may_not_coalesce(spark, sf_dir, uncoalesced):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert 0 < len(got) < docs.count()
