from __future__ import annotations

import random

from pyspark.sql import functions as F

from millrace.operators.substring_index import SubstringIndex, fold


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_every_pair(spark):
    rng = random.Random(11)
    make = lambda lo, hi: "".join(rng.choices("abAB ςΣσİ日", k=rng.randint(lo, hi)))
    texts = [(i, make(0, 40)) for i in range(200)] + [(200, None), (201, ""), (201, "abAB")]
    needles = [(i, make(0, 6)) for i in range(80)] + [(80, ""), (81, None), (82, texts[5][1]), (82, "ab"), (83, "q"), (84, "\0")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(needles, "item_id long, item string")
    index = SubstringIndex(spark).add(docs.where("doc_id < 90")).add(docs.where("doc_id >= 90"))
    exact = sorted((n, d) for n, needle in needles if needle is not None for d, text in texts if text is not None and needle in text)
    assert pairs(index.search(docs, items)) == exact
    for rarest in (1, 9):
        assert pairs(index.search(docs, items, rarest=rarest)) == exact
    # Spark's own lower case is what a search regardless of case compares by
    named = items.where("item IS NOT NULL").withColumnRenamed("item_id", "n")
    either = docs.join(named, F.contains(F.lower("text"), F.lower("item"))).select("n", "doc_id")
    assert pairs(index.search(docs, items, ignore_case=True)) == pairs(either) and either.count() > len(exact)


def test_folding_keeps_parts():
    for text in ("ΑΣ ΒΑΣ", "İstanbul", "KELVIN K"):
        for a in range(len(text)):
            for b in range(a, len(text) + 1):
                assert fold(text[a:b]) in fold(text)


def test_few_documents_are_candidates(spark):
    texts = [(i, f"a common start of all the texts, and then word{i} follows the other {i * 7919 % 1000}") for i in range(500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = SubstringIndex(spark).add(docs)
    needles = spark.createDataFrame([(1, "and then word77 follows"), (2, "nothing of the kind, zzz")], "nid long, needle string")
    met = index.candidates(needles)
    assert 1 <= met.where("nid = 1").count() < 25 and met.where("nid = 2").isEmpty()
    plan = met._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_indexed(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, item string")
    assert SubstringIndex(spark).search(docs, items).isEmpty() and SubstringIndex(spark).add(docs).search(docs, items).isEmpty()


def test_a_text_meets_its_needles_once(spark):
    """Many short needles in every text: a row for each text is compared, not one for each pair with its own lower case."""
    docs = spark.createDataFrame([(i, "ABCDEFGH İς " * 3) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(n, c) for n, c in enumerate("abcdefghABCDEFGH ")], "item_id long, item string")
    found = SubstringIndex(spark).add(docs).search(docs, items, ignore_case=F.col("item_id") < 8)
    assert found.count() == 40 * 17
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in plan and plan.count("MapInArrow") >= 1
    one = SubstringIndex(spark).add(docs.withColumn("doc_id", F.col("doc_id").cast("int"))).search(docs.withColumn("doc_id", F.col("doc_id").cast("int")), items)
    assert dict(one.dtypes)["doc_id"] == "int" and one.count() == 40 * 9
