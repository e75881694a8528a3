from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.operators.lexical_index import BM25, DOT, LexicalIndex, Weighting
from millrace.operators.vector_index import VectorIndex, k_means
from millrace.plans import retrieval


def texts(spark, n, seed=0):
    """Documents of words of very different frequency, empty and null ones among them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = [(i + 1000 * seed, " ".join(rng.choices(words, [1 / (j + 1) for j in range(200)], k=rng.randint(1, 60)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n + 1000 * seed, ""), (n + 1 + 1000 * seed, None)], "doc_id long, text string")


def asked(spark):
    rows = [(1, "w0 w3 w150"), (2, "W7 w7 w199 nothing"), (3, "nothing at all"), (4, ""), (5, None), (6, "w0")]
    return spark.createDataFrame(rows, "query_id long, text string")


@pytest.mark.parametrize("weighting", [BM25, DOT, Weighting(k1=2.0, b=0.2, idf=False)])
def test_index_gives_what_a_scan_gives(spark, weighting):
    docs = texts(spark, 300).unionByName(texts(spark, 80, 1))
    index = LexicalIndex(spark, block=16).add(texts(spark, 300)).add(texts(spark, 80, 1))
    if weighting.plain:
        wanted = search.sparse_top_k(docs, asked(spark), 7)
    else:
        wanted = search.bm25_top_k(docs, asked(spark), 7, weighting.k1, weighting.b, weighting.idf)
    told: dict = {}
    got = index.search(asked(spark), 7, weighting, explain=told)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.select(*got.columns).collect()))
    assert told["scored"] <= told["pairs"]


def test_blocks_that_cannot_hold_a_better_document_are_skipped(spark):
    """A rare word in few blocks beside a common one: the others are not scored, and the result is the same."""
    rows = [(i, "common " * (1 + i % 3) + ("rare " * 3 if i % 400 in (7, 8, 9) else "") + "filler " * 20) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    told: dict = {}
    got = LexicalIndex(spark, block=50).add(docs).search(queries, 3, explain=told)
    assert told["pairs"] == 40 and told["scored"] <= 6
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.bm25_top_k(docs, queries, 3).select(*got.columns).collect()))


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("weighting", [BM25, DOT])
def test_pairs_of_queries_and_documents_are_not_shuffled(spark, weighting):
    """Words that every document has, asked for by many queries in several passes: postings are shuffled, not pairs."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(8) for _ in range(1 + i * (j + 3) % 7))) for i in range(500)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"w{q % 8} w{q * 3 % 8} w{q * 5 % 8}") for q in range(60)], "query_id long, text string")
    index = LexicalIndex(spark, block=100).add(docs)
    before = shuffled_rows(spark)
    got = sorted(map(tuple, index.search(queries, 5, weighting, asked=40).collect()))
    assert shuffled_rows(spark) - before < 60 * 500 / 4
    scan = search.sparse_top_k if weighting.plain else search.bm25_top_k
    assert got == sorted(map(tuple, scan(docs, queries, 5).select("query_id", "doc_id", "score", "rank").collect()))


@pytest.mark.parametrize("weighting", [DOT, BM25])
def test_what_a_search_shuffles_follows_the_wanted_postings(spark, weighting):
    """Most words are in no query: their postings stay where they are, and four times the documents are four times the rows."""
    queries = spark.createDataFrame([(q, f"w{q % 8} w{q * 3 % 8} w{q * 5 % 8}") for q in range(20)], "query_id long, text string")
    rows = []
    for n in (250, 1000):
        docs = spark.createDataFrame([(i, " ".join([f"w{i * (j + 3) % 8}" for j in range(6)] + [f"o{i}x{j}" for j in range(40)])) for i in range(n)], "doc_id long, text string")
        index = LexicalIndex(spark, block=25).add(docs.coalesce(1))
        before = shuffled_rows(spark)
        got = sorted(map(tuple, index.search(queries, 5, weighting).collect()))
        rows.append(shuffled_rows(spark) - before)
        scan = search.sparse_top_k if weighting.plain else search.bm25_top_k
        assert got == sorted(map(tuple, scan(docs, queries, 5).select("query_id", "doc_id", "score", "rank").collect()))
        assert rows[-1] < 40 * n / 4
    assert rows[1] <= 4 * rows[0]


def test_ids_of_an_index_are_new_and_not_null(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "index")).add(texts(spark, 10))
    for odd in ([(3, "again")], [(None, "no id")], [(70, "twice"), (70, "twice")]):
        with pytest.raises(ValueError, match="unique"):
            index.add(spark.createDataFrame(odd, "doc_id long, text string"))
    again = LexicalIndex(spark, str(tmp_path / "index"))  # another reader of the same folder
    assert again.search(asked(spark), 3).count() == index.search(asked(spark), 3).count() > 0
    nothing = LexicalIndex(spark).add(texts(spark, 10).limit(0))
    assert nothing.search(asked(spark)).count() == 0 and LexicalIndex(spark).search(asked(spark)).count() == 0


def vectors(spark, n=600, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = [(i, [float(v) for v in centres[i % 12] + 0.4 * rng.normal(size=dims)]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(200)] + [(9000, None), (9001, [])]  # a hot cell of equal rows
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_all_cells_are_exact_and_far_cells_are_skipped(spark):
    rows = vectors(spark)
    queries = rows.where("vec_id % 50 = 0 AND vec_id < 9000").select(F.col("vec_id").alias("query_id"), "embedding")
    index = VectorIndex.build(rows, cells=24)
    wanted = sorted(map(tuple, search.dense_top_k(rows, queries).collect()))
    told: dict = {}
    assert sorted(map(tuple, index.search(queries, probes=None, explain=told).collect())) == wanted
    assert told["visited"] < 0.8 * told["pairs"]
    assert sorted(map(tuple, index.search(queries, probes=24).collect())) == wanted
    some = {tuple(r)[:2] for r in index.search(queries, probes=6).collect()}
    assert len(some & {w[:2] for w in wanted}) >= 0.9 * len(wanted)
    held = [i for r in index.blocks().collect() for i in r.ids]
    assert sorted(held) == sorted(r.vec_id for r in rows.where("size(embedding) > 0").collect())


def test_recall_on_the_table(spark, sf_dir):
    exact = {tuple(r) for r in retrieval.dense(spark, "/root/testdata/sf0.01").select("query_id", "vec_id").collect()}
    found = {tuple(r) for r in retrieval.ivf_topk(spark, "/root/testdata/sf0.01").select("query_id", "vec_id").collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_odd_vector_tables(spark):
    rows = vectors(spark, 20)
    none = VectorIndex.build(rows.limit(0))
    assert none.search(rows.select(F.col("vec_id").alias("query_id"), "embedding")).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        VectorIndex.build(rows.unionByName(spark.createDataFrame([(1, [1.0])], rows.schema)))
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], rows.schema)
    got = VectorIndex.build(same).search(same.where("vec_id = 4").select(F.col("vec_id").alias("query_id"), "embedding"), 3, probes=None).collect()
    assert [(r.vec_id, r.score, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1.0, 1), (1, 1.0, 2), (2, 1.0, 3)]
    assert len(k_means(np.eye(3), 8)) == 3
