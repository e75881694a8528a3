from __future__ import annotations

import os

import pytest

from millrace.operators.embedding_cache import EmbeddingCache
from millrace.operators.models import hashed_embedder
from millrace.session import new_folder


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def logging(folder, fail=""):
    """A factory whose models note when they are made and which texts they see."""

    def make():
        with open(f"{folder}/made", "a") as out:
            out.write(f"{os.getpid()}\n")

        def embed(batch):
            if fail and any(fail in t for t in batch):
                raise RuntimeError("the provider is down")
            with open(f"{folder}/seen", "a") as out:
                out.writelines(f"{t}\n" for t in batch)
            return [[float(len(t)), 1.0] for t in batch]

        return embed

    return make


def seen(folder):
    path = f"{folder}/seen"
    return sorted(open(path).read().splitlines()) if os.path.exists(path) else []


def test_each_distinct_text_is_embedded_once(spark, tmp_path):
    cache = EmbeddingCache(spark, new_folder(spark, "cache"), "m")
    docs = texts(spark, ["a", "bb", "a", "ccc", None, "", "bb"])
    assert cache.misses(docs).count() == 4 and cache.fill(docs, logging(tmp_path)) == 4
    assert seen(tmp_path) == ["", "a", "bb", "ccc"]
    assert cache.fill(docs, logging(tmp_path)) == 0 and len(seen(tmp_path)) == 4
    assert cache.fill(docs.union(texts(spark, ["new"])), logging(tmp_path)) == 1 and seen(tmp_path)[-1] == "new"
    got = {(r.doc_id, r.text, tuple(r.embedding)) for r in cache.lookup(docs).collect()}
    assert got == {(i, t, (float(len(t or "")), 1.0)) for i, t in enumerate(["a", "bb", "a", "ccc", None, "", "bb"])}


def test_other_models_share_nothing(spark):
    root, docs = new_folder(spark, "cache"), texts(spark, ["a", "b"])
    assert EmbeddingCache(spark, root, "m").fill(docs, hashed_embedder) == 2
    assert EmbeddingCache(spark, root, "other").misses(docs).count() == 2


def test_an_interrupted_run_embeds_nothing_twice(spark, tmp_path, monkeypatch):
    cache = EmbeddingCache(spark, new_folder(spark, "cache"), "m")
    docs = texts(spark, [f"text {i}" for i in range(60)])
    parts = iter(range(100))

    class Stop(Exception):
        pass

    class Third:
        """A path that can't be had the third time: the run ends between two rounds."""

        @property
        def hex(self):
            if (n := next(parts)) == 2:
                raise Stop
            return f"part{n}"

    import millrace.operators.embedding_cache as module

    with monkeypatch.context() as m:
        m.setattr(module.uuid, "uuid4", Third)
        m.setattr(module, "written", lambda df, label: df.persist())
        with pytest.raises(Stop):
            cache.fill(docs, logging(tmp_path), rounds=6)
    done = seen(tmp_path)
    assert 0 < len(done) < 60 and cache.table().count() == len(done)
    assert cache.fill(docs, logging(tmp_path), rounds=6) == 60 - len(done)
    assert seen(tmp_path) == sorted(f"text {i}" for i in range(60))


def test_a_part_that_is_not_whole_does_not_count(spark, tmp_path):
    root = new_folder(spark, "cache")
    cache, docs = EmbeddingCache(spark, root, "m"), texts(spark, ["a", "b"])
    cache.fill(docs, hashed_embedder, rounds=1)
    folder = f"{root.removeprefix('file://')}/parts"
    os.remove(f"{folder}/{os.listdir(folder)[0]}/_SUCCESS")
    assert cache.misses(docs).count() == 2 and {r.embedding for r in cache.lookup(docs).collect()} == {None}


def test_what_fails_stays_missing(spark, tmp_path):
    cache, docs = EmbeddingCache(spark, new_folder(spark, "cache"), "m"), texts(spark, ["good", "bad", "fine"])
    assert cache.fill(docs, logging(tmp_path, "bad"), batch=1) == 2
    assert [r.text for r in cache.lookup(docs).where("embedding IS NULL").collect()] == ["bad"]
    assert cache.fill(docs, hashed_embedder) == 1


def test_models_are_made_once_per_worker(spark, tmp_path):
    cache = EmbeddingCache(spark, new_folder(spark, "cache"), "m")
    cache.fill(texts(spark, [str(i) for i in range(200)]), logging(tmp_path), rounds=4, batch=4)
    made = open(f"{tmp_path}/made").read().split()
    assert len(made) == len(set(made))


def test_parts_become_one(spark):
    root = new_folder(spark, "cache")
    cache, docs = EmbeddingCache(spark, root, "m"), texts(spark, [str(i) for i in range(50)])
    cache.fill(docs, hashed_embedder, rounds=5)
    before = {(r.doc_id, tuple(r.embedding)) for r in cache.lookup(docs).collect()}
    assert cache.compact() == 50 and len(cache._parts()) == 1
    assert {(r.doc_id, tuple(r.embedding)) for r in cache.lookup(docs).collect()} == before
