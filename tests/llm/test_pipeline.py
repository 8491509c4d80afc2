"""The pipeline's stages on a small corpus, each against what it should keep."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import _common as C
from gradeloom.llm import decontaminate, mixing, pii
from tests.llm.test_llm import DOCS, brute_links, clash, labelled, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    table, labels, _ = labelled(spark, 400)
    rng = random.Random(9)
    item = words(rng, 30, 10**6)
    more = [(1000, f"{words(rng, 30, 5000)} {item} {words(rng, 30, 5000)}", "en", "s", 0), (1001, f"Call +1 (212) 555-0100 {words(rng, 60, 5000)}", "en", "t", 0), (1002, None, None, None, None)]
    more += [(1003 + k, more[1][1], "en", "t", 0) for k in range(3)]
    table.withColumns({"source": F.when(F.col("doc_id") % 3 == 0, "s").otherwise("t")}).unionByName(spark.createDataFrame(more, DOCS)).write.parquet(f"{base}/documents.parquet")
    labels.write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == columns, name
            assert [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        if name == "quality":
            assert after.filter("doc_id < 1000 and text like '%$$$%'").count() == 0 and after.count() > 250
        if name == "near_duplicates":
            rows = [tuple(r) for r in before.collect()]
            _, root = brute_links(rows)
            assert after.count() == len(set(root))
            assert after.filter("doc_id in (1001, 1003, 1004, 1005)").count() == 1
        if name == "decontamination":
            lost = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
            assert lost == {1000}
        if name == "pii":
            assert after.count() == before.count() and after.filter("text like '%555-0100%'").count() == 0
            assert pii.Pseudonyms(back=True).apply(after.filter("doc_id = 1001").first().text)[0] == before.filter("doc_id = 1001").first().text
        if name == "mixing":
            assert after.columns == [*columns, "copy"] and 0 < after.count() and after.agg(F.max("copy")).first()[0] <= 3
        before = after
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, before.collect()))
    assert corpus_pipeline.ORACLE_SQL is None
    kept = len(whole.collect())
    whole.write.parquet(str(tmp_path / "whole"))
    assert C.drop_staged(spark) > 5 and C.drop_staged(spark) == 0
    whole = spark.read.parquet(str(tmp_path / "whole"))
    assert whole.count() == kept
    assert decontaminate.scan(whole, spark.read.parquet(f"{folder}/benchmark.parquet")).filter("size(hits) > 0").count() == 0


def test_clashing_columns_and_repeated_rows(spark, folder, tmp_path):
    """Further columns of whatever name pass through; one id in two sources, repeated rows and null ids are treated as what they are."""
    rng = random.Random(10)
    two = words(rng, 80, 5000)
    rows = [(2000, two, "en", "s", 0), (2000, two, "en", "t", 0)] + [(None, words(rng, 70, 5000), "en", "t", 0)] * 5 + [(None, None, None, None, None)] * 3 + [(2001, "", "en", "s", 0)] * 2
    docs = clash(spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.createDataFrame(rows, DOCS)))
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, folder).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert set(after.columns) == set(docs.columns) and (k == 4 or after.columns == docs.columns), name
        if name == "quality":
            assert after.filter("doc_id = 2000").count() == 2 and after.filter("doc_id is null and text is not null").count() == 5
        if name == "near_duplicates":
            assert after.filter("doc_id = 2000").count() == 1 and after.filter("doc_id is null and text is not null").count() == 1
        if name == "mixing":
            plan = mixing.plan_mix(before).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
            got = after.groupBy("source").agg(F.sum(mixing.n_tokens(F.col("text"))).alias("n")).collect()
            assert {r.source: r.n for r in plan if r.n} == {r.source: r.n for r in got}
            assert after.schema["copy"].dataType.simpleString() == "int" and after.filter("bucket = 'own bucket'").count() == after.count()
        before = after


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in queries) for k in range(1, 11)) and "pipeline" in queries
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


def staged_tables(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{C.checkpoint_dir(spark)}/gradeloom")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName().rpartition("-")[0] for s in files.listStatus(path)} if files.exists(path) else set()


def test_what_a_stage_staged_is_dropped(spark, folder, monkeypatch):
    C.drop_staged(spark)
    other = C.stage(spark.range(5), "other")
    before = staged_tables(spark)
    whole = corpus_pipeline.run(spark, folder)
    left = staged_tables(spark) - before
    assert "pipeline-pii" in left and not {x for x in left if x.startswith("near-") or x.startswith("quality-")} and not left & {"pipeline-quality", "pipeline-near_duplicates", "pipeline-decontamination"}
    assert whole.count() > 0 and other.count() == 5
    C.drop_staged(spark)
    before = staged_tables(spark)

    def fails(spark, docs, sf_dir):
        F.broadcast(C.stage(docs, "half")).count()
        return docs.withColumn("text", F.raise_error(F.lit("no")).cast("string"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("decontamination", fails), *corpus_pipeline.STAGES[2:]])
    with pytest.raises(Exception, match="no"):
        corpus_pipeline.run(spark, folder)
    assert staged_tables(spark) == before and C.drop_staged(spark) == 0


def test_a_cluster_session_that_names_no_key_gets_one_of_its_own(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "write to ann@example.org", "en", "s", 24), (2, "ask ann@example.org", "en", "s", 19)], DOCS)
    demo = [r.text for r in corpus_pipeline.pii_stage(spark, docs, "").orderBy("doc_id").collect()]
    monkeypatch.setattr(spark.sparkContext, "master", "spark://far:7077")
    own, again = ([r.text for r in corpus_pipeline.pii_stage(spark, docs, "").orderBy("doc_id").collect()] for _ in range(2))
    assert own == again and own[0].split()[-1] == own[1].split()[-1] and "ann@example" not in own[0] and own != demo
    assert [pii.Pseudonyms(pii.session_key(spark), back=True).apply(x)[0] for x in own] == ["write to ann@example.org", "ask ann@example.org"]
    assert corpus_pipeline.pii_stage(spark, docs, "", b"secret").orderBy("doc_id").first().text == pii.Pseudonyms(b"secret").apply("write to ann@example.org")[0]
    with pytest.raises(ValueError, match="secret key"):
        pii.pseudonymise(docs)


def test_scopes(spark):
    with C.scope(spark) as outer:
        with C.scope(spark) as inner:
            kept = C.stage(spark.range(3), "kept")
            C.stage(spark.range(3), "gone")
            last = [inner.pop(0)]
        C.outlive(last)
        assert kept.count() == 3 and outer == last
    assert not {"kept", "gone"} & staged_tables(spark)
