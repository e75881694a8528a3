from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import agent, models, pipeline, ranking, store
from millrace.operators.pipeline import RetrievalPipeline


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, "red apples and green pears", [1.0, 0.0], "en"),
        (2, "green pears in a bowl", [0.9, 0.1], "en"),
        (3, "a bowl of soup", [0.0, 1.0], "de"),
        (4, "red apples and green pears", [0.5, 0.5], "de"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>, lang string").withColumn("external_id", F.col("lang"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(101, "green pears", [1.0, 0.0]), (102, "explain how soup gets into a bowl", [0.0, 1.0])], "query_id long, text string, embedding array<double>")


@pytest.fixture(scope="module")
def retrievers(corpus):
    payload = ["text", "embedding", "external_id"]
    made = {"dense": pipeline.dense_retriever(corpus, payload=payload), "sparse": pipeline.sparse_retriever(corpus, payload=payload)}
    made["hybrid"] = pipeline.hybrid_retriever(made["dense"], made["sparse"], corpus=corpus, payload=payload)
    return made | {"semantic": pipeline.semantic_retriever({k: made[k] for k in ("dense", "sparse", "hybrid")})}


def shared(asked, texts):
    return [float(len(set(q.split()) & set(t.split()))) for q, t in zip(asked, texts)]


def ids(df, query):
    return [r.doc_id for r in df.where(F.col("query_id") == query).orderBy("rank").collect()]


@pytest.mark.parametrize("kind", pipeline.RETRIEVER_TYPES)
def test_each_retriever(kind, retrievers, queries):
    found = pipeline.simple(kind, retrievers).run(queries, k=3)
    assert {r.retrieval_method for r in found.collect()} == {kind}
    assert set(ids(found, 101)) <= {1, 2, 4} and ids(found, 102)[0] == 3


def test_semantic_routes_by_text(retrievers, queries):
    found = pipeline.simple("semantic", retrievers).run(queries, k=2)
    assert ids(found, 102) == ids(retrievers["dense"](queries, None, k=2), 102)
    assert ids(found, 101) == ids(retrievers["sparse"](queries, None, k=2), 101)


def test_threshold_counts_only_above_zero(retrievers, queries):
    assert retrievers["dense"](queries, None, k=4, min_score=0.99).count() < retrievers["dense"](queries, None, k=4, min_score=0.0).count() == 8


RERANKERS = {
    "cross_encoder": {"model_type": "cross_encoder", "top_k": 2},
    "bge": {"model_type": "bge", "top_k": 2},
    "bm25": {"model_type": "bm25", "top_k": 2},
    "semantic": {"model_type": "semantic", "top_k": 2},
    "multistage": {"model_type": "multistage", "stage1": {"model_type": "cross_encoder", "top_k": 3}, "stage2": {"model_type": "bm25", "top_k": 2}},
    "ensemble": {"model_type": "ensemble", "top_k": 2, "rerankers": [{"model_type": "cross_encoder", "weight": 0.7}, {"model_type": "bm25", "weight": 0.3}]},
}


@pytest.mark.parametrize("name", RERANKERS)
def test_each_reranker_of_a_config(name, retrievers, queries):
    config = {"retrieval_pipeline": {"retriever": {"type": "dense"}, "stages": [{"type": "reranker", "config": RERANKERS[name]}]}}
    found = pipeline.from_config(config, retrievers, scorers={"default": shared}).run(queries, k=4)
    assert found.count() == 4 and {r["rank"] for r in found.select("rank").collect()} == {1, 2}
    if name not in ("semantic", "ensemble"):
        assert ids(found, 101)[0] in (1, 2, 4) and ids(found, 102)[0] == 3
    if name == "bge":
        assert all(0.5 <= r.score < 1 for r in found.collect())


def test_late_interaction_of_a_config(spark):
    rows = spark.createDataFrame([(1, 10, [[0.0, 1.0]], 0.9, 1), (1, 11, [[1.0, 0.0]], 0.5, 2)], "query_id long, doc_id long, token_vectors array<array<double>>, score double, rank int")
    asked = spark.createDataFrame([(1, [[1.0, 0.0]])], "query_id long, token_vectors array<array<double>>")
    assert ids(pipeline.reranker({"model_type": "colbert"})(asked, rows), 1) == [11, 10]


def test_stages_and_their_order(retrievers, queries):
    stages = [{"type": "duplicate_filter", "config": {"dedup_by": "content"}}, {"type": "metadata_filter", "config": {"criteria": {"external_id": ["en", "de"]}}}, {"type": "answer_enhancer"}, {"type": "context_enricher"}, {"type": "result_limiter", "config": {"max_results": 2}}]
    built = pipeline.from_config({"retrieval_pipeline": {"retriever": {"type": "dense"}, "stages": stages}}, retrievers)
    rows = built.run(queries, k=4).where("query_id = 101").collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2] and all(r.retrieval_method == "dense+enhanced" and r.query_used == "green pears" for r in rows)
    assert [n for n, _ in built.stages] == ["retriever", *(s["type"] for s in stages)] and built.get("answer_enhancer")
    built.add("first_two", lambda queries, results, **_: results.where("rank <= 2"), position=1)
    assert built.stages[1][0] == "first_two" and built.remove("answer_enhancer") and not built.remove("answer_enhancer")


@pytest.mark.parametrize(
    "stage",
    [
        {"type": "score_filter", "config": {"min_scor": 1}},
        {"type": "unknown"},
        {"type": "reranker", "config": {"model_type": "cross_encoder", "model_name": "absent"}},
        {"type": "reranker", "config": {"model_type": "unknown"}},
        {"type": "reranker", "config": {"model_type": "ensemble"}},
        {"type": "reranker", "config": {"model_type": "bm25", "k9": 1}},
    ],
)
def test_what_cannot_be_built_fails(stage, retrievers):
    with pytest.raises(ValueError):
        pipeline.from_config({"retrieval_pipeline": {"stages": [stage]}}, retrievers, scorers={"default": shared})


def test_a_pipeline_without_retriever_fails(queries, retrievers):
    built = pipeline.from_config({"retrieval_pipeline": {"stages": [{"type": "answer_enhancer"}]}}, retrievers)
    built.remove("retriever")
    for broken in (built, RetrievalPipeline()):
        with pytest.raises(ValueError):
            broken.run(queries)
    with pytest.raises(ValueError):
        pipeline.simple("dense", retrievers).run(queries, {"absent": {}})
    with pytest.raises(ValueError):
        pipeline.simple("other", retrievers)


def test_factories(retrievers, queries, tmp_path):
    assert [n for n, _ in pipeline.reranked({"embedding": {"sparse": {}}}, retrievers, shared, top_k=1).stages] == ["retriever", "reranker"]
    assert pipeline.reranked({}, retrievers).run(queries).first().retrieval_method == "dense"
    assert pipeline.from_unified_config({"embedding": {"strategy": "sparse"}}, retrievers).run(queries).first().retrieval_method == "sparse"
    assert pipeline.from_unified_config({"retrieval": {"type": "dense"}}, retrievers, "hybrid").run(queries).first().retrieval_method == "hybrid"
    (tmp_path / "fast.json").write_text(json.dumps({"retriever": {"type": "sparse"}, "retrieval_pipeline": {"retriever": {"type": "sparse"}, "stages": [{"type": "answer_enhancer"}]}}))
    (tmp_path / "broken.json").write_text("{")
    listed = {name: said for name, said, _ in pipeline.list_configs(str(tmp_path))}
    assert listed["fast"] == "sparse retrieval with 1 stages" and listed["broken"].startswith("can't be read")
    built = pipeline.from_retriever_config(str(tmp_path), "fast", retrievers, {"retriever": {"top_k": 3}})
    assert built.config["retriever"] == {"type": "sparse", "top_k": 3} and built.run(queries).first().retrieval_method == "sparse"
    main = tmp_path / "main" / "config.json"
    main.parent.mkdir()
    main.write_text(json.dumps({"llm": "x"}))
    pipeline.switch_config(str(tmp_path), "fast", str(main))
    assert json.loads(main.read_text()) == {"llm": "x", "retrieval_config": "fast", "retrieval_pipeline": {"retriever": {"type": "sparse"}, "stages": [{"type": "answer_enhancer"}]}}
    for name in ("absent",):
        with pytest.raises(ValueError):
            pipeline.switch_config(str(tmp_path), name, str(main))
        with pytest.raises(ValueError):
            pipeline.from_retriever_config(str(tmp_path), name, retrievers)


def test_documents_without_ranking(retrievers, queries):
    docs = pipeline.as_documents(retrievers["dense"](queries, None, k=1))
    assert docs.columns == ["query_id", "rank", "text", "metadata"] and docs.first().metadata.retrieval_method == "dense"


def test_labels_before_metadata(spark):
    rows = spark.createDataFrame([(1, {"a": "x"}, {"a": "y"}), (2, {"a": ""}, {"a": "y"}), (3, None, {"a": "y"}), (4, {}, {})], "id int, labels map<string,string>, metadata map<string,string>")
    assert [r[0] for r in rows.orderBy("id").select(ranking.label_or_metadata(rows, "a")).collect()] == ["x", "y", "y", None]
    keys = spark.createDataFrame([("e", "t"), (None, "t")], "e string, t string").select(ranking.document_key(F.col("e"), F.col("t"))).collect()
    assert sorted(k[0] for k in keys) == sorted(["e", "e358efa489f58062f10dd7316b65649e"])
    assert rows.transform(ranking.stamped).select("processed_at").distinct().count() == 1


def test_collections_know_their_vectors(spark, tmp_path):
    points = store.PointStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", [1.0, 2.0], None), ("b", None, {"x": 1.0})], "id string, dense array<double>, sparse map<string,double>")
    assert points.spec("c") is None and points.ensure("c", rows) == points.spec("c") == {"dim": 2, "metric": "cosine", "sparse": True}
    points.write("c", rows)
    assert points.read("c").count() == 2 and points.ensure("c", rows.where("dense IS NULL"))["dim"] == 2
    assert points.ensure("empty", rows.where("false").drop("sparse"))["dim"] == 384
    wrong = spark.createDataFrame([("c", [1.0])], "id string, dense array<double>")
    for bad in (lambda: points.ensure("c", wrong), lambda: points.ensure("c", rows, metric="dot"), lambda: points.ensure("d", rows.select("id", "dense").unionByName(wrong))):
        with pytest.raises(ValueError):
            bad()
    keyed = store.keyed_points(spark.createDataFrame([("e",), ("e",), (None,), ("",)], "external_id string")).collect()
    assert len({r.id for r in keyed}) == 3 and all(len(r.id) == 36 for r in keyed)


def test_embedding_strategies_and_the_cache(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "id int, text string")
    calls = models.hashed_embedder(4)
    both = store.embed_as("hybrid", rows, calls, models.sparse_weights, "m", dims=4)
    assert {r.id: r.sparse for r in both.collect()} == {1: {"one": 1.0, "two": 1.0}, 2: {"one": 1.0, "two": 1.0}, 3: {}}
    cache = store.grown_cache(None, both)
    assert cache.count() == 1 and store.grown_cache(cache, both).count() == 1

    def fails(texts):
        raise RuntimeError("no model")

    again = store.embed_as("dense", rows, fails, name="m", cache=cache, dims=4, retries=1)
    assert {r.id: sum(r.embedding) for r in again.collect()} == {1: 2.0, 2: 2.0, 3: 0.0}
    assert rows.select(models.sparse_ids(8)("text").alias("s")).first().s and all(0 <= k < 8 for k in rows.select(models.sparse_ids(8)("text").alias("s")).first().s)
    for bad in (lambda: store.embed_as("other", rows), lambda: store.embed_as("dense", rows), lambda: store.embed_as("hybrid", rows, calls)):
        with pytest.raises(ValueError):
            bad()


def test_self_rag_keeps_its_history(spark):
    states = spark.createDataFrame([(1, "q", "c"), (2, "r", "c")], "id int, question string, context string")
    generate = lambda q, c, i, feedback: F.concat(q, i.cast("string"), feedback)
    verify = lambda q, c, a: F.when(a.contains("2") | (q == "q"), F.lit('{"is_faithful": true, "hallucination_detected": false}')).otherwise('{"is_faithful": false, "hallucination_detected": true, "issues": ["wrong"]}')
    first, second = agent.self_rag(states, generate, verify).orderBy("id").collect()
    assert [(h.iteration, h.answer, h.action) for h in first.history] == [(1, "q1", "initial")] and not first.corrected
    assert [(h.iteration, h.answer, h.action, h.verification.is_faithful) for h in second.history] == [(1, "r1", "initial", False), (2, "r2wrong", "revision", True)]
    assert second.iterations == 2 and second.corrected and second.answer == "r2wrong"


def test_prompts_and_models(spark):
    rows = spark.createDataFrame([("why?", None), ("how?", "so")], "q string, c string")
    made = rows.select(agent.prompt("strict", F.col("q"), F.col("c")).alias("p")).collect()
    assert "No context available" in made[0].p and made[1].p.endswith("Question: how?\\nAnswer:") or "Question: how?" in made[1].p
    said = rows.select(agent.answers(lambda texts: [t.upper() for t in texts], F.when(F.col("c").isNotNull(), F.col("q"))).alias("a")).collect()
    assert [r.a for r in said] == [None, "HOW?"]
    with pytest.raises(ValueError):
        agent.prompt("absent", F.lit(""), F.lit(""))
    read = rows.limit(1).select(agent.interpretation(F.lit('{"query_type": "fact", "next_node": "retriever", "plan": ["look"]}')).alias("i"), agent.interpretation(F.lit("nonsense")).alias("j")).first()
    assert (read.i.query_type, read.i.next_node, read.i.plan, read.j.query_type, read.j.next_node) == ("fact", "retriever", ["look"], "none", "generator")
    checked = agent.verified(spark.createDataFrame([("q", "c", "a")], "question string, context string, answer string"), lambda q, c, a: F.lit('{"is_faithful": true}')).first()
    assert checked.verification.is_faithful and checked.verification.hallucination_detected


def test_judge_out_of_range_and_failing(spark):
    rows = spark.createDataFrame([("a", "x", "c"), ("b", "y", None), ("c", "z", "")], "question string, answer string, context string")

    def model(question, answer, context, attempt):
        if question == "a":
            return '{"faithfulness": 9, "relevance": 1, "helpfulness": 1}'
        if question == "b":
            raise TimeoutError("too slow")
        return '{"faithfulness": 5, "relevance": 4, "helpfulness": 3, "justification": "fine"}' if attempt == 2 else "{"

    got = {r.question: r for r in agent.judge(rows, model).collect()}
    assert (got["a"].faithfulness, got["a"].attempts, got["a"].has_context) == (0, 3, True) and "9" in got["a"].justification
    assert got["b"].relevance == 0 and "too slow" in got["b"].justification
    assert (got["c"].faithfulness, got["c"].relevance, got["c"].helpfulness, got["c"].justification, got["c"].attempts) == (5, 4, 3, "fine", 2)


def test_text_and_vectors_are_joined_once(spark, sf_dir):
    """What a search reads once for each block of queries is a table, no join."""
    from millrace.plans import posts

    for rows in posts._text_and_vector(spark, sf_dir):
        assert "Join" not in rows._jdf.queryExecution().toString()
