from __future__ import annotations

import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest
from tests.llm.conftest import documents

from millrace.llm import queries
from millrace.llm.winnowing import Index, K, contamination, drop_contaminated, minima, winnow
from millrace.llm.words import ALNUM_LOWER, Words
from tests import oracle


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "item_id long, text string")


def brute(doc, texts, span=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, hit, found = words(doc), set(), set()
    for n, t in enumerate(texts, 1):
        w = words(t)
        m = min(len(w), span)
        for p in range(len(w) - m + 1 if m else 0):
            for q in range(len(d) - m + 1):
                if d[q : q + m] == w[p : p + m]:
                    hit.update(range(q, q + m))
                    found.add(str(n))
    return len(d), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [64, 16 << 20])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "É", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [text(rng.choice([1, 3, 9, 10, 11, 25])) for _ in range(12)] + [" ".join("abcdefghij"), None, "", "!!"]
    docs = [text(rng.randint(0, 60)) for _ in range(25)] + [t or "" for t in texts] + ["z z " + (texts[9] or "") + ", END"]
    got = contamination(documents(spark, docs), items(spark, texts), block_bytes=block_bytes).orderBy("doc_id").collect()
    for r, doc in zip(got, docs):
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == brute(doc, texts)


def test_every_long_shared_span_is_found(spark):
    rng = random.Random(2)
    item = [f"i{n}" for n in range(400)]
    docs = []
    for n in range(200):
        a = rng.randrange(390)
        docs.append(" ".join([f"x{n}"] * rng.randint(0, 5) + item[a : a + 10] + ["y"]))
    got = contamination(documents(spark, docs), items(spark, [" ".join(item)])).collect()
    assert {sum(s.end - s.start for s in r.spans) for r in got} == {10}


@pytest.mark.parametrize("window", [6, 10])
@pytest.mark.parametrize("n", range(1, 26))
def test_minima_of_a_single_short_text(n, window):
    g, low = minima(np.arange(n, dtype=np.uint64), K, window)
    assert low.tolist() == [min(g[i : i + window]) for i in range(len(g))]
    where, prints = winnow(np.arange(n, dtype=np.uint64), np.full(n, n), K, window)
    least = [(i, low[i]) for i in range(n - K - window + 2)]
    assert where.tolist() == sorted({j for i, m in least for j in range(i, i + window) if g[j] == m}) and prints.tolist() == g[where].tolist()


def test_tables_of_one_short_document(spark):
    texts = [f"{' '.join(f'w{i}' for i in range(n))}" for n in range(1, 26)]
    for n, doc in enumerate(texts, 1):
        index = Index(["1"], [doc.encode()])
        hit = np.zeros(n, bool)
        for a, b, _ in index.hits(Words.of([doc.encode()], ALNUM_LOWER)):
            hit[a:b] = True
        assert hit.all()
    for n in (6, 8):
        rows = contamination(documents(spark, [texts[n - 1]]), items(spark, [texts[n - 1]])).collect()
        assert [(r.n_words, [(s.start, s.end) for s in r.spans], r["items"]) for r in rows] == [(n, [(0, n)], ["1"])]


def test_odd_rows(odd, empty, spark):
    got = contamination(odd, items(spark, ["one two three", None])).collect()
    assert len(got) == 10 and {r.doc_id for r in got if r.spans} == {6}
    assert contamination(empty, items(spark, ["x"])).count() == 0
    assert {len(r.spans) for r in contamination(odd, items(spark, [])).collect()} == {0}
    unnamed = spark.createDataFrame([(None, "one two three")], "item_id long, text string")
    assert [(len(r.spans), r["items"]) for r in contamination(odd, unnamed).where("doc_id = 6").collect()] == [(1, [])] * 2


def test_query_matches_sql(spark, sf_dir):
    oracle.assert_same(queries.op6_winnowing(spark, sf_dir), oracle.tables(sf_dir), queries.OP6_SQL)


def test_a_benchmark_of_many_blocks_gives_the_same(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    again = bench.unionByName(bench.selectExpr("item_id + 1000 AS item_id", "text")).unionByName(bench.selectExpr("item_id + 2000 AS item_id", "substring_index(text, ' ', 4) AS text"))
    rows = lambda df: sorted((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in df.collect())
    one = rows(contamination(docs, again))
    assert any(r[3] for r in one) and rows(contamination(docs, again, block_bytes=2000)) == one
    clean = sorted(r.doc_id for r in drop_contaminated(docs, again).collect())
    many = drop_contaminated(docs, again, block_bytes=2000)
    assert sorted(r.doc_id for r in many.collect()) == clean == [r[0] for r in one if not r[2]] and many.columns == docs.columns


def test_odd_rows_against_many_blocks(odd, empty, spark):
    texts = ["one two three", None, "one two three", "word3 word4 " * 40, "x" * 200]
    got = contamination(odd, items(spark, texts), block_bytes=50).collect()
    assert len(got) == 10 and {r.doc_id: r["items"] for r in got if r.spans} == {6: ["1", "3"]}
    assert contamination(empty, items(spark, texts), block_bytes=50).count() == 0
    assert drop_contaminated(odd, items(spark, texts), block_bytes=50).count() == 8


def test_one_word_repeated_takes_linear_time():
    index = Index(["1", "2"], [b"a " * 100_000, b"b a a a a a a a a a a"])
    began = time.process_time()
    words = Words.of([b"a " * 100_000, b"a " * 9, b"c " + b"a " * 10], ALNUM_LOWER)
    hit, found = np.zeros(len(words.starts), bool), set()
    for a, b, item in index.hits(words):
        hit[a:b] = True
        found.add((a >= 100_000, item))
    assert time.process_time() - began < 20
    assert hit.tolist() == [True] * 100_000 + [False] * 10 + [True] * 10 and found == {(False, 0), (False, 1), (True, 0), (True, 1)}


def test_hits_against_all_windows():
    rng = random.Random(3)
    for _ in range(200):
        make = lambda n: rng.choices("abc" if rng.random() < 0.5 else "ab", k=n)
        texts, bench = [make(rng.randint(0, 60)) for _ in range(3)], [make(rng.randint(0, 40)) for _ in range(4)]
        index = Index([str(i) for i in range(4)], [" ".join(i).encode() for i in bench], k=3, span=6)
        words = Words.of([" ".join(t).encode() for t in texts], ALNUM_LOWER)
        got_hit, got_items = np.zeros(len(words.starts), bool), set()
        for a, b, item in index.hits(words):
            got_hit[a:b] = True
            got_items.add((int(np.searchsorted(words.first, a, "right")) - 1, item))
        hit, owners = [], set()
        for d, text in enumerate(texts):
            mine = [False] * len(text)
            for n, item in enumerate(bench):
                m = min(6, len(item))
                windows = {tuple(item[i : i + m]) for i in range(len(item) - m + 1)} if m else set()
                for i in range(len(text) - m + 1):
                    if tuple(text[i : i + m]) in windows:
                        mine[i : i + m] = [True] * m
                        owners.add((d, n))
            hit += mine
        assert got_hit.tolist() == hit and got_items == owners


def test_hashes_of_long_texts_are_taken_in_slices():
    raw = " ".join("x" * n + str(n) for n in [1, 5, 300, 2, 0, 41, 900, 3]).encode()
    words = Words.of([raw, b"", b"y " * 400 + b"z" * 77], ALNUM_LOWER)
    assert all((words.hashes(size) == words.hashes()).all() for size in (1, 7, 64, 299, 1000))
    code = "import resource; from millrace.llm.words import *; w = Words.of([b'word ' * (64 << 18) + b'x' * (8 << 20)], ALNUM_LOWER); w.hashes(); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    peak = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.getcwd()}).stdout.split()[-1])
    assert peak < 2_000_000  # KB; all bytes at once took 40 for each, 3.7 GB
