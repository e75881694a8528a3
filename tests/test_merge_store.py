from __future__ import annotations

import threading

import pytest

from millrace.operators.merge_store import MergeStore


def frame(spark, rows, kinds="id string, n int"):
    return spark.createDataFrame(rows, kinds)


def held(store):
    return sorted(tuple(r) for r in store.read("c").select("id", "n").collect())


@pytest.fixture
def store(spark, tmp_path):
    return MergeStore(spark, f"file://{tmp_path}/store", buckets=8)


def test_only_touched_buckets_are_written_anew(spark, store):
    assert store.read("c") is None and store.write("c", frame(spark, []))["version"] == 0
    first = store.write("c", frame(spark, [(f"k{i}", i) for i in range(100)]))
    second = store.write("c", frame(spark, [("k7", 700), ("new", 1)]))
    changed = {b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)}
    assert 1 <= len(changed) <= 2 and set(first["folders"]) <= set(second["folders"])
    assert held(store) == sorted([(f"k{i}", 700 if i == 7 else i) for i in range(100)] + [("new", 1)])
    assert store.read("c", 1).count() == 100  # readers of the old version aren't disturbed
    again = store.write("c", frame(spark, [("k7", 700), ("new", 1)]))
    assert again["version"] == 3 and held(store)[-1] == ("new", 1) and store.read("c").count() == 101


@pytest.mark.parametrize("other", [("b", 3), ("a", 9)])
def test_a_writer_that_comes_second_merges_what_the_first_wrote(spark, store, monkeypatch, other):
    """Both begin from one version; the second one's commit fails once, whether or not it touches the same bucket."""
    store.write("c", frame(spark, [("a", 1), ("z", 0)]))
    commit, calls = MergeStore._commit, []

    def late(self, name, manifest):
        if not calls:
            calls.append(1)
            MergeStore(spark, self.root).write(name, frame(spark, [other]))
        return commit(self, name, manifest)

    monkeypatch.setattr(MergeStore, "_commit", late)
    store.write("c", frame(spark, [("d", 4), ("a", 2)]))
    assert held(store) == sorted({"a": 2, "z": 0, "d": 4, **({"b": 3} if other[0] == "b" else {})}.items())
    assert store.versions("c") == [1, 2, 3]


def test_writers_at_once(spark, store):
    threads = [threading.Thread(target=store.write, args=("c", frame(spark, [(f"k{i}", i), ("all", 5)]))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(store) == [("all", 5)] + [(f"k{i}", i) for i in range(4)] and store.versions("c") == [1, 2, 3, 4]


def test_order_columns_and_odd_keys(spark, store):
    from pyspark.sql import functions as F

    store.write("c", frame(spark, [("a", 1), ("a", 3), ("a", 2)]), order=F.col("n"))
    assert held(store) == [("a", 3)]
    store.write("c", frame(spark, [("b", "x")], "id string, more string"))
    assert sorted(map(str, (tuple(r) for r in store.read("c").select("id", "n", "more").collect()))) == ["('a', 3, None)", "('b', None, 'x')"]
    with pytest.raises(ValueError, match="without key"):
        store.write("c", frame(spark, [(None, 1)]))
    with pytest.raises(ValueError, match="keyed by"):
        store.write("c", frame(spark, [("x", 1)]), key="n")


def test_vacuum_keeps_what_manifests_name(spark, store):
    for i in range(4):
        store.write("c", frame(spark, [("a", i), (f"k{i}", i)]))
    before = held(store)
    assert store.vacuum("c") == ["manifests/000000000001.json", "manifests/000000000002.json"]  # all data is young
    assert any(g.startswith("data/") for g in store.vacuum("c", keep=1, grace=0)) and held(store) == before
