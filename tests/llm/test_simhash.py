from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from tests.llm.conftest import documents
from pyspark.sql import functions as F

from millrace.llm import queries, simhash
from millrace.llm.components import connected_components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    u = np.array(sorted(set(prints)), np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= radius):
            parent[find(int(u[i]))] = find(int(u[j]))
    return find


@pytest.mark.parametrize("text", ["", "a", "A b", "one two three", "One TWO three four five", "été À x\x0by\x1cz w", "a a a a a"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_agrees_on_the_hash(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert got % 2**64 == simhash.fingerprint(b"one two three")


@pytest.mark.parametrize("blocks,chunk", [(5, 1024), (5, 16), (6, 100), (8, 1024)])
def test_links_of_random_and_dense_fingerprints(spark, blocks, chunk):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 5))) for b in base for _ in range(6)]
    dense = [base[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)]
    prints = list({p % 2**64 for p in [*base, *near, *dense]})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    found = connected_components(simhash.linked(df, blocks=blocks, chunk=chunk)).collect()
    label = {r.v % 2**64: r.label for r in found}
    find = components(prints)
    for p in prints:
        for q in prints:
            assert (find(p) == find(q)) == (p == q or (p in label and label.get(p) == label.get(q)))


def test_manhattan_distance_bounds_hamming(spark):
    rng = random.Random(6)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.popcounts(F.col("a")).alias("p"), simhash.popcounts(F.col("b")).alias("q")).collect()
    for r in got:
        fields = lambda x: [x >> (2 * i) & 3 for i in range(32)]
        assert fields(r.p) == [bin(r.a >> (2 * i) & 3).count("1") for i in range(32)]
        assert sum(abs(x - y) for x, y in zip(fields(r.p), fields(r.q))) <= bin(r.a ^ r.b).count("1")


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.v: r.label for r in connected_components(edges).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] != got[0] and len(got) == 63


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[1].fingerprint == "0" * 16
    assert by[5].component_id == 4 and by[6].component_id == 6 and by[None].component_id is None
    assert simhash.near_duplicates(empty).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op4_simhash(spark, sf_dir).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r.fingerprint for i, r in got.items()}
    find = components(list(prints.values()))
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(find(p), i)
    assert {i: least[find(p)] for i, p in prints.items()} == {i: r.component_id for i, r in got.items()}


def test_near_copies_meet(spark):
    base = " ".join(f"w{i}" for i in range(3000))
    docs = documents(spark, [base, base.replace("w1500", "other"), " ".join(f"v{i}" for i in range(3000))])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_unary_counts_differ_by_the_manhattan_distance():
    rng = random.Random(7)
    a, b = (np.array([rng.getrandbits(64) for _ in range(200)], np.uint64) for _ in range(2))
    counts = lambda x: np.array([[bin(int(v) >> (2 * i) & 3).count("1") for i in range(32)] for v in x])
    assert (np.bitwise_count(simhash.unary(a) ^ simhash.unary(b)) == np.abs(counts(a) - counts(b)).sum(1)).all()


def test_the_bound_drops_most_pairs_of_a_cell():
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 1 << 38, 4000, dtype=np.uint64) | np.uint64(0xABCDEF << 40)  # one cell of the coarsest grid
    counts = simhash.unary(fp)
    i, j = np.triu_indices(len(fp), 1)
    bound, exact = np.bitwise_count(counts[i] ^ counts[j]) <= 3, np.bitwise_count(fp[i] ^ fp[j]) <= 3
    assert not (exact & ~bound).any() and 0 < bound.sum() < 0.01 * len(i)
    assert (simhash._near(fp, counts, i, j, 3) == exact).all()


@pytest.mark.parametrize("dense", [8, 60])
def test_dense_cells_are_dealt_anew(spark, dense, monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = list({base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 12))) for _ in range(400)})
    grids, cells = [], simhash._cells
    monkeypatch.setattr(simhash, "_cells", lambda f, blocks, radius: grids.append((blocks, f.count())) or cells(f, blocks, radius))
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    label = {r.v % 2**64: r.label for r in connected_components(simhash.linked(df, dense=dense, chunk=16)).collect()}
    find = components(prints)
    for p in prints:
        for q in prints:
            assert (find(p) == find(q)) == (p == q or (p in label and label.get(p) == label.get(q)))
    assert [g for g, _ in grids] == list(simhash.GRIDS[: len(grids)]) and len(grids) > 1
