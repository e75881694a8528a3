from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from millrace.llm import queries
from millrace.llm.language_id import DIMENSIONS, ORDERS, Model, codewords, features, identify, train


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9])
def test_codewords_are_apart(n):
    code = codewords(n)
    assert len(np.unique(code, axis=0)) == n and (np.abs(code.sum(0)) < n).all()
    if n > 3:
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 99
        assert apart.min() >= 3  # so that one wrong bit is corrected


def test_one_wrong_bit_is_corrected():
    code = codewords(5)
    model = Model(list("abcde"), code, np.zeros((1, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.full(code.shape[1], 1 / code.shape[1]))
    for c in range(5):
        model.bias = (5 * code[c]).astype(np.float32)
        model.bias[0] *= -1
        best, score, margin = model.decode(np.zeros((1, 1), np.float32))
        assert best[0] == c and 0 <= score[0] <= 1 and margin[0] > 0


def test_long_texts_are_counted_whole(monkeypatch):
    text = ("abc défg " * 300).encode()
    whole = features([text])
    monkeypatch.setattr("millrace.llm.language_id._CHUNK", 100)
    assert np.allclose(whole, features([text]))


def test_odd_rows(spark, odd, empty):
    model = train(odd)
    got = identify(odd, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and {r.score for r in got if r.doc_id == 1} == {0.0}
    assert identify(empty, model).count() == 0
    assert {r.lang_pred for r in identify(odd, train(empty)).collect()} == {"und"}
    one = identify(odd, train(odd.where("lang = 'en'"))).collect()
    assert {r.lang_pred for r in one} == {"und", "en"}


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op1_language_id(spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and 100 < len(held) < 300
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def plain_prediction(model, text):
    """The language by the definition: n-grams counted one by one, each classifier's margin, the loss of every codeword."""
    data = [b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in text.encode()]
    counts = {}
    for order in ORDERS:
        for i in range(len(data) - order + 1):
            code = order << 40
            for j, b in enumerate(data[i : i + order]):
                code += b << 8 * (order - 1 - j)
            slot = (code * 0x9E3779B97F4A7C15 % 2**64) >> (64 - DIMENSIONS.bit_length() + 1)
            counts[slot] = counts.get(slot, 0) + 1
    x = {s: math.log1p(n) for s, n in counts.items()}
    norm = max(math.sqrt(sum(v * v for v in x.values())), 1e-9)
    bits = range(model.code.shape[1])
    margins = [max(-30.0, min(30.0, sum(v / norm * float(model.weights[s, b]) for s, v in x.items()) + float(model.bias[b]))) for b in bits]
    loss = [sum(model.trust[b] * math.log1p(math.exp(-word[b] * margins[b])) for b in bits) for word in model.code]
    likely = [math.exp(-(v - min(loss)) * len(bits)) for v in loss]
    return model.languages[loss.index(min(loss))], max(likely) / sum(likely)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(queries._remainder(5) != 0))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op1_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.ambiguous == (r.lang_pred == "und" or r.margin < 0.5)
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(text) < 2000:
            lang, score = plain_prediction(model, text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3)


def test_many_short_rows_are_held_a_few_at_a_time(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS lang")
    assert identify(rows, train(rows)).count() == 3000
