from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import chunking
from millrace.functions import text as tx
from millrace.functions.llm_json import extract_json, verdict
from millrace.operators import documents, store


def column(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


def test_entities_are_decoded_in_order(spark):
    assert column(spark, "<b>&amp;lt;</b>", tx.clean_text) == "<"


def test_duplicate_of_an_invalid_first_is_invalid(spark):
    rows = spark.createDataFrame([(1, "too short", "s"), (2, " too  short ", "s"), (3, None, "")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in documents.validate(rows).collect()}
    assert "duplicate" not in got[1].errors and "duplicate" in got[2].errors and not got[1].valid
    assert {"empty", "missing source"} <= set(got[3].errors)


def test_repeated_and_placeholder_texts(spark):
    assert column(spark, "a" * 60, tx.suspicious) == ["repeated"]
    assert column(spark, "Lorem Ipsum dolor", tx.suspicious) == ["placeholder"]
    assert column(spark, "short", tx.suspicious) == ["too short"]
    assert column(spark, "aab", tx.max_char_ratio) == 2 / 3 and column(spark, "", tx.max_char_ratio) == 0.0


def test_code_and_tables(spark):
    assert column(spark, "def f(x):\n  pass", tx.has_code) and not column(spark, "the class struggle", tx.has_code)
    assert column(spark, "a | b\n| x | y |", tx.has_table) and column(spark, "class x", tx.content_strategy) == "code_aware"


def test_sentence_chunks():
    assert chunking.by_sentences("Aaaaa. Bbbbb. Ccccc.", 13) == ["Aaaaa. Bbbbb.", "Bbbbb. Ccccc."]
    assert chunking.by_sentences("") == []


def test_code_preamble_is_left_out():
    assert chunking.by_code("import os\n\ndef f():\n    return 1\n\ndef g():\n    return 2") == ["def f():\n    return 1\n", "def g():\n    return 2"]


def test_fenced_code_stays_whole():
    text = "Before.\n```python\nx = 1\n```\nAfter."
    assert chunking.by_code(text) == ["Before.", "```python\nx = 1\n```", "After."]


def test_overflowing_row_is_in_both_parts():
    head = ["| a | b |", "|---|---|"]
    rows = [f"| {i} | {'x' * 30} |" for i in range(6)]
    parts = chunking.by_tables("\n".join(head + rows), size=100, max_table=50)
    assert len(parts) > 1 and all(p.startswith("\n".join(head)) for p in parts)
    assert parts[0].split("\n")[-1] == parts[1].split("\n")[2]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60))
def test_recursive_chunks_fit_and_cover(text, size):
    chunks = chunking.recursive(text, size, size // 5)
    assert all(0 < len(c) <= size for c in chunks)
    at = 0
    for word in text.split():
        # every word is found in order, whole or in pieces of a long one
        assert any(word in c for c in chunks) or len(word) > size - size // 5
        at += 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="xyz", min_size=1, max_size=12), max_size=30), st.integers(5, 40))
def test_sentence_chunks_keep_every_sentence(words, target):
    text = ". ".join(words) + "."
    joined = chunking.by_sentences(text, target)
    assert [s for s in chunking.sentences(text) if not any(s in c for c in joined)] == []


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, " ")], "doc_id long, text string")
    assert [tuple(r) for r in documents.chunk(docs, "semantic").collect()] == [(1, 0, "One. Two.")]
    assert documents.chunk_by_content(docs, scope="first_doc").count() == 1
    assert documents.count_chunks(documents.chunk(docs, "semantic", target=4)).first()["num_chunks"] == 2


def test_llm_json(spark):
    texts = ['x\n```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', ' {"a": 1} ', 'so {"a": 1} yes']
    assert [column(spark, t, extract_json).strip() for t in texts] == ['{"a": 1}'] * 4
    assert column(spark, "garbage", extract_json) is None and column(spark, "garbage", verdict).hallucination_detected


def test_containment(spark):
    docs = spark.createDataFrame([(1, "xa b c d e f gh i"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g"), (8, "a b")], "item_id long, item string")
    assert sorted(map(tuple, documents.containment(docs, items).collect())) == [(7, 1), (8, 1), (8, 2)]


def test_upsert_is_idempotent(spark, tmp_path):
    points = store.PointStore(spark, f"file://{tmp_path}")
    first = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, v int")
    points.write("c", first)
    again = sorted(map(tuple, points.write("c", first).collect()))
    assert again == sorted(map(tuple, points.read("c").collect())) and [r[0] for r in again] == ["a", "b"]
    points.write("c", spark.createDataFrame([("a", 9)], "id string, v int"))
    assert dict(map(tuple, points.read("c").collect()))["a"] == 9
    points.write(points.canary("c"), first)
    assert points.drop_canaries() == ["c_canary"] and points.read("c_canary") is None


def test_points_and_embeddings(spark):
    chunks = spark.createDataFrame([("k", "t", [1.0], {2: 0.5, 1: 0.25}), ("l", "t", None, None)], "key string, text string, d array<double>, s map<int,double>")
    got = {r.payload.key: r for r in store.to_points(chunks, F.col("key"), ["key"], "d", "s").collect()}
    assert got["k"].sparse.indices == [1, 2] and got["k"].embedding_types == ["dense", "sparse"] and not got["l"].has_dense

    def broken(texts):
        raise RuntimeError

    assert [r.embedding for r in store.embed(chunks, broken, "m", dims=2).collect()] == [[0.0, 0.0]] * 2
    cache = store.embed(chunks, lambda ts: [[float(len(t))] for t in ts], "m").select("cache_key", "embedding").distinct()
    assert [r.embedding for r in store.embed(chunks, broken, "m", cache).collect()] == [[1.0], [1.0]]


def test_smoke_and_verify(spark):
    docs = spark.createDataFrame([(1, "long enough text", "s")], "doc_id long, text string, source string")
    assert store.smoke_summary(store.smoke_tests(docs)).first().passed
    assert not store.smoke_summary(store.smoke_tests(docs.limit(0))).first().passed
    assert store.verify_upload(docs, docs.limit(0), "doc_id").first().missing == 1
