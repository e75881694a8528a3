from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import documents

from millrace.llm import queries
import millrace.llm.rlz as rlz
from millrace.llm.rlz import substring_dedup
from tests import oracle


def brute(texts, window):
    seen, out = set(), []
    for t in texts:
        words = (t or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    """Copies, passages, splices, periodic runs and repeats inside a document."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(rng.randint(18, 70)) for _ in range(6)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += fresh(rng.randint(0, 30)) if kind < 0.3 else p if kind < 0.5 else p[a:] if kind < 0.7 else p[:a] if kind < 0.85 else ["r", "s"] * rng.randint(5, 40)
        texts.append(" ".join(words))
        if rng.random() < 0.2:
            texts.append(texts[-1])
    return texts + [None, "", " \x0b\x0c "]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    got = substring_dedup(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute(texts, 20)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_other_window(spark):
    texts = corpus(9)
    got = substring_dedup(documents(spark, texts), window=9, k=5).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute(texts, 9)
    with pytest.raises(ValueError):
        substring_dedup(documents(spark, texts), window=20, k=5)


def test_odd_rows(odd, empty):
    got = substring_dedup(odd).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    # the long text repeats itself, and its copy goes whole
    assert by[4][0].n_words == 60_000 and 0 < by[4][0].n_removed < 60_000 and by[5][0].n_removed == 60_000
    assert len(by[6]) == len(by[None]) == 2 and {r.n_removed for r in by[6] + by[None] + by[1]} == {0}
    assert substring_dedup(empty).count() == 0


def test_repeated_ids_and_text_ids(spark):
    run = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([("b", run), ("a", run), ("b", "x " + run), (None, "short")], "doc_id string, text string")
    got = sorted((r.doc_id or "", r.n_words, r.n_removed) for r in substring_dedup(df).collect())
    assert got == [("", 1, 0), ("a", 25, 0), ("b", 25, 25), ("b", 26, 25)]


def test_query_matches_sql(spark, sf_dir):
    oracle.assert_same(queries.op9_rlz(spark, sf_dir), oracle.tables(sf_dir), queries.OP9_SQL)


def test_factors_follow_one_diagonal():
    at, key0, at0 = np.array([[0, 7, 0], [5, 7, 5], [12, 7, 12], [20, 3, 1], [40, 3, 21], [45, 9, 45], [50, 3, 31], [52, 9, 52]]).T
    assert rlz.factors(9, at, key0, at0, 11) == [(0, 23, 7, 0), (20, 31, 3, 19), (40, 51, 3, 19), (50, 61, 3, 19)]


@pytest.mark.parametrize("seed", range(20))
def test_agreement_is_of_words(seed):
    """What the hashes propose is kept only where the words agree, and grown as far as they do."""
    rng = random.Random(seed)
    reference = [rng.choice([b"a", b"b", b"c"]) if rng.random() < 0.2 else b"w%d" % i for i in range(300)]
    a, n, shift = rng.randint(0, 150), rng.randint(20, 120), rng.randint(-20, 20)
    words = [b"x%d" % i for i in range(320)]
    start = a + shift if a + shift >= 0 else 0
    for i in range(start, start + n):
        words[i] = reference[i - shift] if 0 <= i - shift < 300 else words[i]
    if rng.random() < 0.6:
        words[start + rng.randrange(n)] = b"changed"
    low, high = max(0, start - shift), min(300, start + n - shift)
    blocks = {b: reference[64 * b : 64 * (b + 1)] for b in range(low // 64, (high - 1) // 64 + 1)}
    got = rlz.agreeing(words, low + shift, high + shift, shift, blocks, 20)
    inside = [0 <= i - shift < 300 and words[i] == reference[i - shift] and (i - shift) // 64 in blocks for i in range(320)]
    runs, at = [], 0
    for i in range(321):
        if i == 320 or not inside[i]:
            if i - at >= 20:
                runs.append((at, i))
            at = i + 1
    whole = all(inside[low + shift : high + shift])
    assert got == [r for r in runs if not whole or r[0] <= low + shift < r[1]]


def test_a_false_proposal_removes_nothing():
    words = b" ".join(b"w%d" % i for i in range(40))
    other = b" ".join(b"v%d" % i for i in range(64))
    factor = {"start": 5, "end": 30, "ref": 1, "shift": 0, "block": 0, "words": other}
    true = factor | {"start": 0, "end": 20, "words": b" ".join([*words.split()[:25], *other.split()[25:]])}
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref", pa.int64()), ("shift", pa.int64()), ("block", pa.int32()), ("words", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([2, 3]), pa.array([words.decode()] * 2), pa.array([[factor], [true]], kind)], names=["key", "text", "factors"])
    out = next(rlz._cut(20)(iter([batch])))
    assert out.column("n_removed").to_pylist() == [0, 25] and out.column("ends").to_pylist() == [[], [25]]
    assert out.column("kept_sha256")[0].as_py() == hashlib.sha256(words).hexdigest()


@pytest.mark.parametrize("seed", range(30))
def test_covering_keeps_every_word(seed):
    rng = random.Random(seed)
    found = [(a, a + rng.choice([20, 20, 20, rng.randint(20, 60)]), rng.randint(0, 2), rng.randint(0, 3)) for a in (rng.randrange(300) for _ in range(rng.randint(1, 60)))]
    words = lambda factors: {i for a, b, _, _ in factors for i in range(a, b)}
    got = rlz.covering(np.array(found, np.int64))
    assert words(got) == words(found) and len(got) <= len(found)
    for a, b, ref, shift in got:  # each is made of proposals of its own diagonal
        assert words([(a, b, ref, shift)]) <= words([f for f in found if f[2:] == (ref, shift)])
    assert len(got) <= 2 * (max(words(found)) // 20 + 1) and rlz.covering(np.zeros((0, 4), np.int64)) == []
