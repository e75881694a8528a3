from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.whitening import deviations, fixed_point, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows: list[tuple], components: int = 32) -> dict:
    """Row number -> (deviation, whitened up to the sign), and the eigenvalues' shares, with whole numbers and numpy."""
    held = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(held), len(held[0][1])
    sums = [sum(x[j] for _, x in held) for j in range(dims)]
    centred = np.array([[(n * x[j] - sums[j]) / n for j in range(dims)] for _, x in held])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, dims)
    white = centred @ vectors[:, :k] / np.sqrt(values[:k])
    return {i: (sum((n * x[j] - sums[j]) ** 2 for j in range(dims)), white[r]) for r, (i, x) in enumerate(held)}, values[:k] / values.sum(), n


def test_query_matches_numpy(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    wanted, shares, n = plain(rows)
    got = queries.op12_whitening(spark, sf_dir).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i, _ in rows for c in range(1, 33))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-8
    sign = {}
    for r in got:
        deviation, white = wanted[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / shares[r.component - 1] - 1) < 1e-9
        w = white[r.component - 1]
        if abs(w) > 1e-3:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(w) - abs(r.whitened)) < 1e-6


def test_what_is_no_vector(spark):
    """Null, empty, holed and infinite ones go, so does one of another length; ids may be null or repeat; names may clash."""
    good = [(i, [float(np.sin(i * j + j)) for j in range(1, 5)]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 0.0, 0.0]), (104, [float("-inf")] * 4), (105, [1.0, 2.0]), (106, [1e30] * 4)]
    repeated = [(7, good[7][1]), (None, good[8][1])]
    rows = good + odd + repeated
    df = spark.createDataFrame([(i, v, 0, 1.0, 2, [0.0]) for i, v in rows], SCHEMA + ", n double, dims int, whitened array<double>")
    got = whiten(df, components=3).collect()
    kept = [r for r in rows if r[0] is None or r[0] < 100]
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in kept)
    wanted, shares, n = plain([(j, v) for j, (_, v) in enumerate(kept)], 3)
    by_deviation = {d: w for d, w in wanted.values()}
    for r in got:
        assert r.n == n == 42 and len(r.whitened) == 3 and np.allclose(r.explained, shares, rtol=1e-9)
        assert np.allclose(np.abs(r.whitened), np.abs(by_deviation[r.deviation]), atol=1e-7) and r.deviation_digits == str(r.deviation)
        assert r.identity_error < 1e-9


def test_rank_and_empty_tables(spark):
    """Equal vectors have no variance at all, vectors on a line have one component."""
    same = spark.createDataFrame([(i, [0.5, 0.25], 0) for i in range(9)], SCHEMA)
    assert {(r.n, r.deviation, tuple(r.whitened), tuple(r.explained), r.identity_error) for r in whiten(same).collect()} == {(9, 0, (None, None), (0.0, 0.0), 0.0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(9)], SCHEMA)
    for r in whiten(line).collect():
        assert r.whitened[1] is None and r.explained[1] == 0 and abs(r.explained[0] - 1) < 1e-12 and r.identity_error < 1e-9
    assert whiten(same.limit(0)).count() == 0
    assert whiten(same.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    one = whiten(same.where("vec_id = 3")).collect()
    assert [(r.vec_id, r.n, r.deviation) for r in one] == [(3, 1, 0)]


def test_sums_of_squares_beyond_a_long():
    small = np.array([[3, -4], [0, 1]])
    assert deviations(small) == ([25, 1], ["25", "1"])
    big = np.array([[2**40, 3], [1, 1]])
    assert deviations(big) == ([None, 2], [str(2**80 + 9), "2"])
    assert deviations(big.astype(object))[1] == [str(2**80 + 9), "2"]


@pytest.mark.parametrize("c, x", [(0.5, 1_000_032), (-0.01, 999_999), (0.0, 1_000_000), (1e10, 640_001_000_000)])
def test_fixed_point(c, x):
    import pyarrow as pa

    good, lengths, values = fixed_point(pa.array([[c], None], pa.list_(pa.float64())))
    assert good.tolist() == [True, False] and lengths.tolist() == [1] and values.tolist() == [x]
