from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import fusion, ranking, search
from millrace.operators.pipeline import RetrievalPipeline, from_config, retriever_type


def ranked(spark, rows):
    return spark.createDataFrame([(q, d, float(s), r) for q, d, s, r in rows], "query_id long, vec_id string, score double, rank int")


def test_rrf_value_and_tie_by_id_down(spark):
    dense = ranked(spark, [(1, "d1", 0.9, 1), (1, "d2", 0.8, 2)])
    sparse = ranked(spark, [(1, "d2", 9, 1), (1, "d1", 8, 2)])
    assert [r.vec_id for r in fusion.rrf(dense, sparse).orderBy("rank").collect()] == ["d2", "d1"]
    one = spark.range(1).select(fusion.rrf_score(0.7, 60, F.lit(1), F.lit(3))).first()[0]
    assert one == pytest.approx(0.7 / 61 + 0.3 / 63)


def test_rrf_of_one_side_and_null_ids(spark):
    dense = ranked(spark, [(1, "a", 1, 1), (1, None, 1, 2)])
    got = fusion.rrf(dense, ranked(spark, [])).collect()
    assert [(r.vec_id, r.rank) for r in got] == [("a", 1)]


def test_min_max_of_equal_scores(spark):
    same = ranked(spark, [(1, "a", 2, 1), (1, "b", 2, 2)])
    values = lambda how: [r.norm_score for r in ranking.min_max(same, how).orderBy("rank").collect()]
    assert values("one") == [1, 1] and values("keep") == [2, 2] and values("reciprocal_rank") == [1, 0.5]


def test_score_filter_and_limit(spark):
    rows = ranked(spark, [(1, "a", 0.8, 1), (1, "b", 0.3, 2)])
    assert [r.vec_id for r in ranking.score_filter(rows, 0.5).collect()] == ["a"]
    assert ranking.limit_results(rows, 1).count() == 1


def test_metadata_operators(spark):
    rows = spark.createDataFrame([(5,), (None,)], "value int")
    both = {"value": {">=": 1, "<": 3}}
    assert ranking.metadata_filter(rows, both).count() == 0
    assert ranking.metadata_filter(rows, both, first_operator_only=True).count() == 1
    assert ranking.metadata_filter(rows, {"value": [5, 6]}).count() == 1


def test_tags(spark):
    rows = spark.createDataFrame([(["a", "b"],), (None,)], "tags array<string>")
    assert ranking.tag_filter(rows, ["a"], ["c"]).count() == 1
    assert ranking.tag_filter(rows, [], ["b"]).count() == 1


def test_duplicates_keep_first_and_null_is_one_key(spark):
    rows = spark.createDataFrame([(1, None, "x", 1), (1, None, "y", 2), (1, "e", "x", 3)], "query_id int, external_id string, text string, rank int")
    keep = lambda by: sorted(r["rank"] for r in ranking.duplicate_filter(rows, by).collect())
    assert keep("external_id") == [1, 3] and keep("content") == [1, 2] and keep("both") == [1, 2, 3]


def test_answer_quality(spark):
    long_code = "x" * 201 + " def "
    got = spark.range(1).select(ranking.answer_quality(F.lit(long_code), F.lit(False), F.lit(2)), ranking.answer_quality(F.lit("x"), F.lit(False), F.lit(0))).first()
    assert tuple(got) == ("high", "low")


def test_routes(spark):
    texts = ["fix null pointer", "please explain the gil semantics", "best sort for nearly sorted data"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0][0] for r in df.select(search.route(F.col("t"))).collect()] == ["sparse", "dense", "hybrid"]
    assert df.select(search.route(F.col("t"), ["dense"], {"SORT": ["sparse"]})).collect()[2][0] == ["dense"]


def test_merge_averages_with_the_last_weight(spark):
    a, b = ranked(spark, [(1, "x", 0.8, 1)]), ranked(spark, [(1, "x", 0.2, 1), (1, "y", 0.9, 2)])
    got = {r.vec_id: r.score for r in fusion.merge_strategies([("a", a), ("b", b)], {"a": 1.0, "b": 0.5}).collect()}
    assert got == {"x": pytest.approx(0.6), "y": 0.9}


@pytest.mark.parametrize("block", [2, 4096])
def test_dense_search_in_blocks(spark, block):
    rows = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5)]) for i in range(40)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = sorted(map(tuple, search.dense_top_k(rows, queries, 3, block=block).select("query_id", "vec_id", "rank").collect()))
    assert got == sorted(map(tuple, search.dense_top_k(rows, queries, 3).select("query_id", "vec_id", "rank").collect()))
    assert len(got) == 12 and all(q != v for q, v, _ in got)


def test_lexical_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a z")], "query_id long, text string")
    assert [tuple(r)[:2] for r in search.bm25_top_k(docs, queries).collect()] == [(7, 1)]
    assert search.bm25_top_k(docs.limit(0), queries).count() == 0
    assert search.bm25_top_k(docs, queries.limit(0)).count() == 0


def test_lexical_search_in_blocks(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(20)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"b{i % 3} c{i} zz") for i in range(7)], "query_id long, text string")
    once, blocks = (sorted(map(tuple, search.bm25_top_k(docs, queries, 3, block=b).collect())) for b in (256, 2))
    assert once == blocks and len(once) == 21
    flat = search.bm25_top_k(docs, queries, 3, idf=False).where("query_id = 0 AND rank = 1").first()
    assert flat.doc_id == 0
    assert search.sparse_top_k(docs, queries, 1).where("query_id = 4").first().doc_id == 4


def test_pipeline_from_config(spark):
    rows = ranked(spark, [(1, "a", 0.8, 1), (1, "b", 0.3, 2)])
    config = {"retrieval": {"type": "dense", "stages": [{"type": "score_filter", "config": {"min_score": 0.5}}]}}
    built = from_config(config, {"dense": lambda queries, results, **_: rows})
    assert built.run(rows).count() == 1
    assert built.run(rows, {"score_filter": {"min_score": 0.1}}).count() == 2
    assert built.remove("score_filter") and built.run(rows).count() == 2
    assert retriever_type({"embedding": {"dense": {}, "sparse": {}}}) == "hybrid"
    with pytest.raises(ValueError):
        RetrievalPipeline().run(rows)
