from __future__ import annotations

import pytest

from millrace.operators.store import PointStore
from millrace.sources import config, qa
from millrace.streaming.ingest import ingest, windowed_latency


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture
def posts(spark, tmp_path):
    q = write(tmp_path / "question.csv", 'Question Id,Question Title,Question Body,Tags,Question Type,Answer Posts\n1,How to sort a list fast,"[\'First part.\', ""it\'s second""]","[\'python\', \'sorting\']",2,"[10, 11]"\n11,Other thing here now,plain body,"a, b",x,\n')
    a = write(tmp_path / "answer.csv", "Answer Id,Answer Body,Summary\n10,\"['Use sorted.']\",\"['Sorted.']\"\n11,Body two,\n12,,\n")
    return qa.questions(qa.read_csv(spark, q)), qa.answers(qa.read_csv(spark, a))


def test_question_parsing(posts):
    first, second = posts[0].orderBy("external_id").collect()
    assert first.external_id == "q_1" and first.body == "First part. it's second" and first.tags == ["python", "sorting"]
    assert first.question_type == 2 and first.related_posts == ["10", "11"]
    assert second.tags == ["a", "b"] and second.question_type is None and second.related_posts == []


def test_answers_become_documents(posts):
    got = {r.external_id: r for r in qa.answer_documents(*posts).collect()}
    assert set(got) == {"a_10", "a_11"}
    assert got["a_10"].text == "Use sorted.\n\nSummary: Sorted." and got["a_10"].has_question_context
    assert got["a_11"].question_title == "How to sort a list fast"


def test_queries_and_qrels(spark, posts):
    docs = qa.answer_documents(*posts)
    queries = qa.evaluation_queries(posts[0], docs)
    assert {r.kind for r in queries.collect()} == {"title", "short"} and queries.first().relevant == ["a_10", "a_11"]
    chunks = spark.createDataFrame([("a_10", "c0"), ("a_10", "c1")], "external_id string, chunk_id string")
    assert qa.qrels(queries.where("kind = 'title'"), chunks).count() == 2


def test_config(tmp_path):
    base = {"a": {"b": 1, "c": 2}, "d": [1]}
    assert config.deep_merge(base, {"a": {"b": 3}, "d": [2]}) == {"a": {"b": 3, "c": 2}, "d": [2]}
    assert config.with_overrides(base, {"a.b": 5})["a"] == {"b": 5, "c": 2}
    assert config.config_hash({"x": 1, "y": 2}) == config.config_hash({"y": 2, "x": 1})
    assert config.load(write(tmp_path / "c.json", '{"k": 1}')) == {"k": 1}
    config.register_adapter("mine", dict)
    assert config.load_adapter("mine", x=1) == {"x": 1} and config.load_adapter("collections.OrderedDict") == {}
    with pytest.raises(ValueError):
        config.load_adapter("unknown")


def test_streamed_ingest_is_idempotent(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.limit(20).write.parquet(str(tmp_path / "in"))
    points = PointStore(spark, f"file://{tmp_path}/store")
    for run in ("a", "b"):
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        ingest(stream, points, "c", str(tmp_path / f"checkpoint-{run}")).awaitTermination()
        count = points.read("c").count()
        assert count == points.read("c").select("id").distinct().count() > 0


def test_windows_of_a_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = windowed_latency(stream, window="1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").count() == windowed_latency(events, window="1 day").count()


def test_a_cluster_must_name_the_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from millrace import session

    settings = {}
    conf = SimpleNamespace(get=settings.get, set=settings.__setitem__)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_folder(cluster)
    settings["spark.checkpoint.dir"] = "hdfs://there/"
    assert session.shared_folder(cluster) == "hdfs://there"
    settings.clear()
    alone = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))
    assert session.shared_folder(alone) == session.shared_folder(alone) == settings["spark.checkpoint.dir"]
