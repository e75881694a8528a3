from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import documents

from millrace.llm import queries, ranking, suffix_dedup
from tests import oracle


def plain(texts: list[str | None], length: int) -> list[tuple]:
    """(n_bytes, spans, digest of what stays) of each text, by a dictionary of all strings."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out.append((len(b), [tuple(e) for e in edges.tolist()], hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, texts, **how):
    found = {r.doc_id: r for r in suffix_dedup.suffix_dedup(documents(spark, texts, 0), **how).collect()}
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in found.values())
    return [(found[i].n_bytes, [tuple(s) for s in found[i].spans], found[i].kept_sha256) for i in range(len(texts))]


def letters(n, seed, of="abcdefgh é世"):
    return "".join(random.Random(seed).choices(of, k=n))


@pytest.mark.parametrize("length, k", [(400, 273), (40, 27), (24, 13)])
def test_any_overlap_of_texts(spark, length, k):
    """Passages a little under and over the length, at starts, ends and inside, overlapping, next to each other, within one text."""
    rng, texts = random.Random(length), []
    pool = [letters(3 * length, s) for s in range(4)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - length // 4)
            parts.append(p[a : a + rng.randint(length // 4, 2 * length)] if rng.random() < 0.7 else letters(rng.randint(0, length), rng.random()))
        texts.append("".join(parts))
    texts += [pool[0], pool[0], pool[1] * 3, "a" * (5 * length), "a" * (length - 1), "ab" * length, "b" + "ab" * length, "", None, letters(length, "one"), letters(length, "one")]
    assert got(spark, texts, length=length, k=k) == plain(texts, length)


def test_copies_by_the_hundred(spark):
    text = letters(900, 1)
    texts = [text[: 900 - i % 7] + letters(30, i) for i in range(300)] + [text] * 150
    wanted = plain(texts, 400)
    assert got(spark, texts) == wanted
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        assert got(spark, texts) == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_samples_do_not_depend_on_slices(monkeypatch):
    text = np.frombuffer(letters(5000, 3).encode() + b"x" * 700 + letters(900, 4).encode(), np.uint8)
    whole = suffix_dedup.samples(text, 400, 273)
    for size in (1, 100, 129, 1000):
        monkeypatch.setattr(suffix_dedup, "_SLICE", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, suffix_dedup.samples(text, 400, 273)))
    assert whole[0][0] == 0 and whole[0][-1] == len(text) - 273 and np.diff(whole[0]).max() <= 128


@pytest.mark.parametrize("length, k", [(400, 273), (24, 13), (9, 9)])
def test_short_texts_are_hashed_together(length, k, monkeypatch):
    """As many hashings as there are bundles of texts, and the samples of each text alone."""
    rng = random.Random(k)
    texts = ["".join(rng.choices("abc"[: rng.randint(1, 3)], k=rng.randint(0, 4 * length))) for _ in range(200)]
    texts += [texts[-1]] * 3 + ["a" * length, "b" * (suffix_dedup._TOGETHER + 1), "a" * (length - 1), ""]
    alone, times, minima = [], [], suffix_dedup.minima_of
    for t in texts:
        found = suffix_dedup.samples(np.frombuffer(t.encode(), np.uint8), length, k) if len(t) >= length else None
        alone.append([] if found is None else list(zip(*(x.tolist() for x in (found[0], *suffix_dedup.needed(found[0], len(t), length, k), found[1].view(np.int64), found[2].view(np.int64))))))
    monkeypatch.setattr(suffix_dedup, "minima_of", lambda *a: times.append(1) or minima(*a))
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    (out,) = suffix_dedup._scan(length, k)(iter([batch]))
    assert len(times) <= 2 * sum(map(len, texts)) // suffix_dedup._TOGETHER + 3
    assert [[tuple(s.values()) for s in row] for row in out.column("samples").to_pylist()] == alone


def test_few_rounds(spark, monkeypatch):
    """A string of many samples is ranked in as many sorts as its number of samples has digits to the base 4."""
    labels, put = [], ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, label, *a: labels.append(label) or put(df, label, *a))
    texts = ["a" * 120, letters(200, 5) + "a" * 120]
    assert got(spark, texts, length=40, k=27) == plain(texts, 40)
    # the strings hold 14 samples: of one, 4 and 16 samples, and the strings near ends
    assert len(labels) <= 4


def test_odd_rows(odd, empty):
    found = suffix_dedup.suffix_dedup(odd).collect()
    assert len(found) == 10
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for i in (4, 5):  # equal texts, both go whole
        assert by[i][0].n_removed == by[i][0].n_bytes > 400_000 and len(by[i][0].spans) == 1
        assert by[i][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.n_removed for i in (1, 2, 3, 6, 7, None) for r in by[i]] == [0] * 8 and by[1][0].n_bytes == 0
    assert by[7][0].kept_sha256 == hashlib.sha256("日本語 ▁ text\x00 with odd é́ \U0001f600 marks".encode()).hexdigest()
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_query_matches_sql(spark, sf_dir):
    oracle.assert_same(queries.op13_suffix_dedup(spark, sf_dir), oracle.tables(sf_dir), queries.OP13_SQL)
