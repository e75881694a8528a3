from __future__ import annotations

import math
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import documents

from millrace.llm import queries, toxicity


@pytest.mark.parametrize("text", ["1D10T", "іdіоt", "ＩＤＩＯＴ", "id\u200biot", "!!idiot!!", "id!ot"])
def test_folding_meets_the_word(text):
    assert toxicity.fold(text) == toxicity.fold("idiot")


def test_folding_of_nothing():
    assert toxicity.fold("") == toxicity.fold(" .,!") == " "


def test_hits_and_exceptions():
    model = toxicity.Model({toxicity.fold("clown")[:-1]: 2.0, toxicity.fold("clow")[:-1]: 1.0}, [0.0] * 5, ("class clown",))
    words = [h[2] for h in model.hits(toxicity.fold("A cl0wn, a class clown and clownish cyclown"))]
    assert words == [2.0, 2.0]


def labelled(spark):
    clean = [f"the weather is fine on day {i} and we walk along the river" for i in range(60)]
    toxic = [f"you are a grumbok and a flizzard{'en' if i % 2 else 'er'} on day {i}" for i in range(60)]
    docs = documents(spark, clean + toxic)
    labels = spark.createDataFrame([(i, int(i > 60)) for i in range(1, 121)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    return docs, labels


def test_learns_words_and_beginnings(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    score = lambda t: model.score(t)
    assert score("what a GRUMB0K this flizzardous thing is") > 0.7 > score("what a fine river") and score("") < 0.5
    got = toxicity.score(docs, model).collect()
    assert all(r.predicted == (r.doc_id > 60) == (r.score >= 0.7) for r in got)
    assert [r.doc_id for r in toxicity.drop_toxic(docs, model).orderBy("doc_id").collect()] == list(range(1, 61))


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark)
    assert toxicity.train(docs, labels, sample_rows=80).weights


def test_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    assert model is toxicity.UNTRAINED and model.score("you stupid idiot, you pathetic loser") > 0.7 > model.score("a quiet day by the sea")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 10 and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(empty, model).count() == 0 and toxicity.drop_toxic(odd, model).count() == 10
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in queries.op5_toxicity(spark, sf_dir).collect() if r.held_out and r.doc_id in truth]
    right = sum(r.predicted and truth[r.doc_id] for r in held)
    assert right >= 0.9 * sum(r.predicted for r in held) and right >= 0.85 * sum(truth[r.doc_id] for r in held)


def test_few_toxic_labels_still_find_their_words(spark):
    texts = [f"{'grumbok' if i < 20 else 'river'} day" for i in range(100)] + [f"{'grumbok' if i < 98 else 'river'} day" for i in range(4900)]
    labels = spark.createDataFrame([(i, int(i <= 100)) for i in range(1, 5001)], "doc_id long, toxic int")
    assert toxicity.fold("grum")[:-1] in toxicity.train(documents(spark, texts), labels).weights


@pytest.mark.parametrize("text", ["ídiot", "ídiot", "ïdïöt", "ｉｄｉｏｔ", "𝐢𝐝𝐢𝐨𝐭"])
def test_marks_and_forms_fold(text):
    assert toxicity.fold(text) == toxicity.fold("idiot")


@pytest.mark.parametrize("word", ["zu", "kys", "donaudampfschifffahrt", "x" * 300])
def test_words_of_any_length_are_learned(spark, word):
    texts = [f"the weather {i} is fine" for i in range(60)] + [f"the weather {word} is fine" for i in range(60)]
    labels = spark.createDataFrame([(i, int(i > 60)) for i in range(1, 121)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, texts), labels)
    assert model.score(f"weather {word}") > 0.7 > model.score(f"weather {word[:-1]}y" if len(word) < 4 else "weather")
    assert toxicity.fold(word) in toxicity.lexicon_counts(f"a {word}.") and toxicity.lexicon_counts("a").issuperset({" a "})


def plain_score(model, text):
    """The score by the definition: every entry looked for at every place."""
    folded, found = toxicity.fold(text), {}
    spared = [(i, i + len(e)) for e in map(toxicity.fold, model.exceptions) for i in range(len(folded)) if folded.startswith(e, i)]
    by_start = {}
    for entry, weight in model.weights.items():
        at = folded.find(entry)
        while at >= 0:
            if len(entry) > by_start.get(at, (0,))[0]:
                by_start[at] = (len(entry), weight)
            at = folded.find(entry, at + 1)
    for at, (length, weight) in by_start.items():
        if not any(a <= at and at + length <= b for a, b in spared):
            found[at] = (length, weight)
    total, n = sum(w for _, w in found.values()), max(len(folded.split()), 1)
    x = [math.log1p(total), math.log1p(100 * total / n), math.log1p(len({folded[a : a + k] for a, (k, _) in found.items()})), math.log1p(total / math.sqrt(n))]
    z = model.coefficients[0] + sum(c * v for c, v in zip(model.coefficients[1:], x))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = queries.toxicity_model(spark, docs, sf_dir)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op5_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]))


def test_many_exception_phrases_take_linear_time():
    model = toxicity.Model({toxicity.fold("can"): 1.0, toxicity.fold("clown"): 2.0}, [0.0] * 5, ("trash can", "class clown of the class"))
    text = "trash can " * 200_000 + "clown can class clown of the class "
    began = time.process_time()
    assert sorted(w for _, _, w in model.hits(toxicity.fold(text))) == [1.0, 2.0]
    assert time.process_time() - began < 20


def test_exceptions_against_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        phrases = tuple(" ".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(3))
        model = toxicity.Model({" a ": 1.0, " b c ": 2.0, " c": 3.0}, [0.0] * 5, phrases)
        folded = toxicity.fold(" ".join(rng.choices(["a", "b", "c", "ca"], k=30)))
        best = {}
        for entry in model.weights:
            for at in range(len(folded)):
                if folded.startswith(entry, at) and at + len(entry) > best.get(at, (0,))[0]:
                    best[at] = (at + len(entry), model.weights[entry])
        spared = [(at, at + len(e)) for e in map(toxicity.fold, phrases) if e not in model.weights for at in range(len(folded)) if folded.startswith(e, at)]
        if any(toxicity.fold(p) in model.weights for p in phrases):
            continue  # an entry that is an exception itself
        assert sorted(model.hits(folded)) == sorted((a, b, w) for a, (b, w) in best.items() if not any(x <= a and b <= y for x, y in spared))


def test_columns_of_any_name_in_training(spark):
    docs, labels = labelled(spark)
    clashing = docs
    for name in ("toxic", "learns", "__id", "__of", "half"):
        clashing = clashing.withColumn(name, F.lit("x"))
    assert toxicity.train(clashing, labels) == toxicity.train(docs, labels)
