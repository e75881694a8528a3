from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.sentencepiece_nbest import Pieces
from millrace.llm.simhash import fingerprint
from millrace.llm.winnowing import contamination, drop_contaminated


def test_every_stage_decides_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    kept = docs
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = dict(texts)
    toxic = {r.doc_id for r in queries.op5_toxicity(spark, sf_dir).collect() if r.predicted}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, sf_dir), "test")
        assert kept.columns == docs.columns
        if name == "toxicity":
            left = {i: t for i, t in left.items() if i not in toxic}
        elif name == "exact_dedup":
            last = {}
            for i, t in sorted(left.items()):
                last[t] = i
            left = {i: t for i, t in left.items() if last[t] == i}
        elif name == "near_dedup":
            from tests.llm.test_simhash import components, plain_fingerprint

            prints = {i: plain_fingerprint(t) for i, t in left.items()}
            find, first = components(list(prints.values())), {}
            for i, p in sorted(prints.items()):
                first.setdefault(find(p), i)
            left = {i: t for i, t in left.items() if first[find(prints[i])] == i}
        else:
            rows = spark.createDataFrame(list(left.items()), "doc_id long, text string")
            hit = {r.doc_id for r in contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if r.spans}
            left = {i: t for i, t in left.items() if i not in hit}
        assert {r.doc_id for r in kept.collect()} == set(left), name
    pieces = Pieces.load()
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert {r.doc_id: pieces.decode(r.ids) for r in out} == left


def test_run(spark, sf_dir):
    assert 0 < corpus_pipeline.run(spark, sf_dir).count() <= 200


def test_odd_documents(spark, odd, sf_dir):
    kept = odd
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir)
    assert {r.doc_id for r in kept.collect()} >= {5, 6, 7}


def test_rows_without_id_and_repeated_ids(spark, sf_dir):
    words = [f"word{i}" for i in range(400)]
    base, copy = " ".join(words), " ".join([*words, "end"])
    assert 0 < (fingerprint(base.encode()) ^ fingerprint(copy.encode())).bit_count() <= 3
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").orderBy("item_id").first().text
    stages = dict(corpus_pipeline.STAGES)

    def kept(stage, rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
        return sorted(((r.doc_id, r.text) for r in stages[stage](spark, docs, sf_dir).collect()), key=str)

    same = [(None, "a copy", "en"), (None, "a copy", "de"), (1, "another copy", "en"), (2, "another copy", "en"), (None, "another copy", "en"), (1, "clean", "en")]
    assert kept("exact_dedup", same) == [(1, "clean"), (2, "another copy"), (None, "a copy")]
    near = [(None, base, "en"), (None, copy, "en"), (7, "quite another text", "en"), (7, "one more text than that", "en")]
    assert [i for i, _ in kept("near_dedup", near)] == [7, 7, None]
    assert kept("near_dedup", [*near, (7, copy, "en"), (5, base, "en")]) == sorted([(5, base), *[(i, t) for i, t, _ in near[2:]]], key=str)
    hit = [(None, f"so: {item}", "en"), (None, "clean", "en"), (3, item, "en"), (3, "clean too", "en")]
    assert kept("decontamination", hit) == [(3, "clean too"), (None, "clean")]


def test_columns_of_any_name_are_carried(spark, sf_dir):
    docs = spark.createDataFrame([(1, "one text", "en"), (2, "one text", "en"), (3, "another text that stays", "de")], "doc_id long, text string, lang string")
    names = ["toxic", "learns", "__id", "__row", "__ROW2", "__dropped", "row", "fp", "key", "number", "_id", "__of"]
    for name in names:
        docs = docs.withColumn(name, F.lit(f"v {name}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert len(rows) == (2 if "dedup" in name else 3) and all(r[n] == f"v {n}" for r in rows for n in names), name
    benchmark = spark.createDataFrame([(1, "another text")], "item_id long, text string")
    kept = drop_contaminated(docs, benchmark, block_bytes=1)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
