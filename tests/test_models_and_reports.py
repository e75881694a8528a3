from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import models, reports


def results(spark):
    return spark.createDataFrame([(1, 10, "a b", "a", 0.9, 1), (1, 11, "a b", "a b", 0.5, 2), (1, 12, "a b", None, 0.4, 3)], "query_id int, doc_id int, q string, t string, score double, rank int")


def shared(queries, texts):
    return [float(len(set(q.split()) & set(t.split()))) for q, t in zip(queries, texts)]


def test_pair_rerank(spark):
    got = models.pair_rerank(results(spark), shared, "q", "t").orderBy("rank").collect()
    assert [(r.doc_id, r.score, r.original_score, r.original_rank) for r in got] == [(11, 2.0, 0.5, 2), (10, 1.0, 0.9, 1), (12, 0.0, 0.4, 3)]
    assert models.pair_rerank(results(spark), shared, "q", "t", 1, activate=True).first().score == pytest.approx(0.880797, abs=1e-6)


def test_semantic_and_late_interaction(spark):
    rows = results(spark).withColumns({"a": F.array(F.lit(1.0), F.lit(0.0)), "b": F.when(F.col("doc_id") == 12, F.array(F.lit(2.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0)))})
    assert models.semantic_rerank(rows, F.col("a"), F.col("b"), 1, "doc_id").first().doc_id == 12
    tokens = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    document = F.array(F.array(F.lit(0.5), F.lit(0.25)))
    assert spark.range(1).select(models.max_sim(tokens, document)).first()[0] == 0.75
    assert spark.range(1).select(models.max_sim(tokens, F.array().cast("array<array<double>>"))).first()[0] == 0.0


def test_providers(spark):
    embed = models.provider({"provider": "hashed", "dims": 4})
    assert embed(["a a", ""]) == embed(["a a", ""]) and sum(embed(["a a"])[0]) == 2.0
    with pytest.raises(ValueError):
        models.provider({"provider": "none"})
    assert spark.createDataFrame([("b A a",), (None,)], "t string").select(models.sparse_weights("t").alias("w")).collect()[0].w == {"a": 2.0, "b": 1.0}


def test_scans_and_names(spark):
    rows = spark.createDataFrame([(1, "The Licence", None), (2, None, "x")], "id int, text string, k string")
    assert [r.id for r in reports.scan(rows, contains="licence").collect()] == [1]
    assert [r.id for r in reports.scan(rows, {"k": None}).collect()] == [1] and reports.scan(rows, limit=1).first().id == 1
    assert [r[0] for r in rows.select(reports.document_name(F.col("k"), F.lit(""))).collect()] == ["unknown", "x"]


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "total int, successful int, failed int")
    assert tuple(reports.ingest_summary(none).first()) == (0, 0, 0, 0, 0.0)
    judged = spark.createDataFrame([(0, 5, 5), (4, 2, 3)], "faithfulness int, relevance int, helpfulness int")
    assert tuple(reports.judge_summary(judged).first()) == (2, 1, 4.0, 2.0, 3.0, 3.0)


def test_paired_effect_by_hand(spark):
    rows = spark.createDataFrame([("x", 1.0, 2.0), ("x", 2.0, 3.0), ("x", 3.0, 5.0)], "k string, a double, b double")
    got = reports.paired_effect(rows, ["k"], "a", "b").first()
    assert got.t == pytest.approx(-4.0) and got.effect == pytest.approx(-2.828427, abs=1e-6)
    assert [tuple(r) for r in reports.improvements(rows, "k", "a", "b").collect()][0] == ("x", -1.0, -50.0)


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}"
    reports.write_lineage(spark, f"{path}/lineage", {"run": 1})
    reports.write_lineage(spark, f"{path}/lineage", {"run": 2})
    assert sorted(r.run for r in reports.read_json(spark, f"{path}/lineage", "run int").collect()) == [1, 2]
    reports.write_jsonl(spark.createDataFrame([("t",)], "text string"), f"{path}/jsonl", text="inputText")
    assert reports.read_json(spark, f"{path}/jsonl").first().inputText == "t"
    metrics = spark.createDataFrame([("m", 1, "map", 0, 0.5)], "method string, query_id int, metric string, k int, value double")
    reports.export_metrics(metrics, f"{path}/out")
    assert spark.read.csv(f"{path}/out/summary", header=True).first()["map"] == "0.5"
