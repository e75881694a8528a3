from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import student
from millrace.operators import agent
from millrace.operators import evaluation as ev
from millrace.operators import experiments as ex


def frames(spark, ranked, relevant, queries=(1,)):
    r = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ranked)], "query_id int, vec_id string, rank int")
    q = spark.createDataFrame([(1, d) for d in relevant], "query_id int, vec_id string")
    return r, q, spark.createDataFrame([(x,) for x in queries], "query_id int")


def values(df):
    return {(r.metric, r.k): r.value for r in df.collect()}


def test_metrics_by_hand(spark):
    got = values(ev.retrieval_metrics(*frames(spark, "abcd", "bdx"), ks=(1, 5)))
    assert got[("precision", 1)] == 0 and got[("precision", 5)] == 0.5 and got[("recall", 5)] == pytest.approx(2 / 3, abs=1e-6)
    assert got[("mrr", 0)] == 0.5 and got[("map", 0)] == pytest.approx(1 / 3, abs=1e-6) and got[("r_precision", 0)] == pytest.approx(1 / 3, abs=1e-6)
    assert got[("success", 1)] == 0 and got[("success", 5)] == 1 and got[("ndcg", 5)] == pytest.approx(0.498189, abs=2e-6)


def test_repeated_documents_and_no_truth(spark):
    assert values(ev.retrieval_metrics(*frames(spark, "aab", "b")))[("mrr", 0)] == 0.5
    assert set(values(ev.retrieval_metrics(*frames(spark, "ab", ""))).values()) == {None}
    assert values(ev.retrieval_metrics(*frames(spark, "", "b")))[("precision", 5)] == 0.0


def test_evaluator_variant(spark):
    got = values(ev.eval_metrics(*frames(spark, "ab", "b"), ks=(5,)))
    assert got[("eval_precision", 5)] == 0.2 and got[("eval_ndcg", 5)] == 1.0 and got[("eval_mrr", 0)] == 0.5


def test_metrics_against_plain_python(spark):
    rng = random.Random(3)
    for _ in range(4):
        ranked = rng.sample("abcdefghijkl", rng.randint(1, 12))
        rel = set(rng.sample("abcdefghijkl", rng.randint(1, 8)))
        got = values(ev.retrieval_metrics(*frames(spark, ranked, rel)))
        hits = [d in rel for d in ranked]
        dcg = sum(h / math.log2(i + 2) for i, h in enumerate(hits[:5]))
        ideal = sum(1 / math.log2(i + 2) for i in range(min(5, len(rel))))
        ap = sum(sum(hits[: i + 1]) / (i + 1) for i, h in enumerate(hits) if h) / len(rel)
        assert got[("ndcg", 5)] == pytest.approx(dcg / ideal, abs=1e-6) and got[("map", 0)] == pytest.approx(ap, abs=1e-6)


def test_student():
    assert student.quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert student.two_sided_p(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert student.two_sided_p(0.0, 3) == pytest.approx(1.0) and student.two_sided_p(math.inf, 3) == 0.0


def test_intervals_of_few_values(spark):
    df = spark.createDataFrame([("a", 0, 0.4), ("b", 0, None)], "metric string, k int, value double")
    got = {r.metric: r for r in ev.confidence_intervals(df).collect()}
    assert (got["a"].ci_low, got["a"].ci_high) == (0.4, 0.4) and got["b"].mean == 0.0 and got["b"].n == 0


def test_paired_test_signs_and_effect(spark):
    rows = [(m, q, "map", 0, float(v)) for m, vs in (("a", (1, 2, 4)), ("b", (2, 3, 4))) for q, v in enumerate(vs)]
    got = ev.with_p_values(ev.paired_tests(spark.createDataFrame(rows, "method string, query_id int, metric string, k int, value double"))).first()
    assert got.mean_diff == pytest.approx(2 / 3, abs=1e-6) and got.t == pytest.approx(-2.0, abs=1e-6) and 0.18 < got.p_value < 0.19
    one = spark.range(1).select(ev.effect_size(F.lit(-0.9))).first()[0]
    assert one == "large"


def test_objective_and_grid(spark):
    score = spark.range(1).select(ev.grid_objective(*(F.lit(x) for x in (0.9, 0.6, 0.5, 0.4, 750.0)))).first()[0]
    assert score == pytest.approx(0.630)
    assert ev.parse_grid("0.0:1.0:0.2") == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0] and ev.parse_grid("1,2") == [1.0, 2.0]
    grid = spark.createDataFrame([(0.1, 60, 0.5), (0.5, 60, 0.5), (0.5, 20, 0.499)], "alpha double, rrf_k int, score double")
    assert [(r.alpha, r.rrf_k) for r in ex.grid_winner(grid).where("is_winner").collect()] == [(0.5, 60)]


def test_bins_and_split(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 6, 7)], "n int")
    assert [r[0] for r in df.select(ex.count_bin(F.col("n"))).collect()] == ["none", "low", "low", "medium", "medium", "high"]
    rows = spark.range(10).withColumn("c", F.lit("c"))
    split = ex.stratified_split(ex.strata(rows, F.lit("t"), F.col("c"), F.lit("low")), "id")
    assert split.where("split = 'test'").count() == 2
    assert ex.strata(rows.limit(4), F.lit("t"), F.col("c"), F.lit("low")).count() == 0


def test_overlap_of_an_empty_reference(spark):
    got = spark.range(1).select(*(c.alias(n) for n, c in ev.overlap(F.lit(""), F.lit("x")).items())).first()
    assert tuple(got) == (0.0, 0.0, 0.0)


def test_self_rag_stops_on_a_confident_minor_flaw(spark):
    minor = '{"is_faithful": false, "hallucination_detected": true, "confidence": 0.81, "severity": "minor"}'
    states = spark.createDataFrame([("q", "c")], "question string, context string")
    got = agent.self_rag(states, lambda q, c, i, f: F.concat(q, i.cast("string")), lambda q, c, a: F.lit(minor)).first()
    assert (got.iterations, got.converged, got.answer) == (1, False, "q1")
    later = agent.self_rag(states, lambda q, c, i, f: i.cast("string"), lambda q, c, a: F.when(a == "2", '{"is_faithful": true, "hallucination_detected": false}').otherwise("?")).first()
    assert (later.iterations, later.converged, later.corrected) == (2, True, True)


def test_memory_keeps_the_last_twenty(spark):
    df = spark.range(1).select(agent.remember(F.transform(F.sequence(F.lit(1), F.lit(21)), lambda i: i.cast("string")), F.lit("x"), F.lit("y")).alias("m"))
    assert df.first().m == [str(i) for i in range(4, 22)] + ["x", "y"]
