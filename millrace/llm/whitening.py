"""Whitening of embeddings: a two-pass covariance, its eigenvectors, and the projection of every row.

Entries are fixed-point whole numbers, so sums of them are exact whatever the
order: the first pass adds them up per dimension, the second adds outer products
of rows centred at the mean (a NumPy matrix product for each batch).  What
batches and partitions find is merged by ``treeAggregate``; the eigenvectors of
the covariance (LAPACK's symmetric solver) go to every task as a matrix of
dimension x components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: Entries in one step of a batch (8 bytes each).
_STEP = 1 << 20
#: A dimension's sum is kept as high * _HALF + low, so that it never overflows.
_HALF = 1 << 31


def fixed_point(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows are vectors, how many entries each of these has, their entries as whole numbers).

    A row is none if it is null or empty, or holds an entry that is null, not
    finite, or so large that its whole number needs more than 62 bits.
    """
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    lengths[~column.is_valid().to_numpy(zero_copy_only=False)] = 0
    values = column.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * SCALE)
        bad = ~(np.abs(scaled) < 2.0**62)
    bad |= ~values.is_valid().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = lengths > 0
    good[owner[bad]] = False
    return good, lengths[good], scaled[good[owner]].astype(np.int64) + OFFSET


def _matrices(column: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their entries) of the vectors of ``dims`` entries, some _STEP entries at a time."""
    step = max(1, _STEP // dims)
    for at in range(0, len(column), step):
        good, lengths, x = fixed_point(column.slice(at, step))
        fits = lengths == dims
        yield at + np.flatnonzero(good)[fits], x[np.repeat(fits, lengths)].reshape(-1, dims)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vector how many there are and the sum of each dimension."""
    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            _, lengths, x = fixed_point(batch.column(0).slice(at, 4096))
            for dims in np.unique(lengths).tolist():
                rows = x[np.repeat(lengths == dims, lengths)].reshape(-1, dims)
                n, high, low = found.get(dims, (0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)))
                found[dims] = n + len(rows), high + (rows >> 31).sum(axis=0), low + (rows & (_HALF - 1)).sum(axis=0)
    out = [(dims, n, high.tobytes(), low.tobytes()) for dims, (n, high, low) in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, _SUMS)], names=["dims", "n", "high", "low"])


_SUMS = (pa.int32(), pa.int64(), pa.binary(), pa.binary())


def _tree(df: DataFrame, zero, add, merge):
    """``treeAggregate`` of the few rows that each partition has made."""
    return df.rdd.treeAggregate(zero, add, merge)


@dataclass(frozen=True)
class Fit:
    """What the rows are whitened with: the number of vectors, the exact sum of each dimension, components (columns) and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - sums exactly, as doubles divided by n)."""
        most = self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        if most < 1 << 63:
            d = x * self.n - np.array(self.sums, np.int64)
        else:
            d = x.astype(object) * self.n - np.array(self.sums, object)
        return d, d.astype(np.float64) / self.n

    def projected(self, centred: np.ndarray) -> np.ndarray:
        """Coordinates on the components of positive variance, to unit variance."""
        return centred @ (self.vectors / np.sqrt(self.values))


def deviations(d: np.ndarray) -> tuple[list[int | None], list[str]]:
    """The sum of squares of each row, exactly: as a long where it is one, and as decimal digits."""
    if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
        sums = (d * d).sum(axis=1).tolist()
    else:
        sums = [sum(v * v for v in row) for row in d.tolist()]
    return [s if s < 1 << 63 else None for s in sums], [str(s) for s in sums]


def _moments(rows: DataFrame, make, dims: int, ship) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sum of outer products centred at it) of the vectors that ``make`` gives for a batch.

    Batches are centred at their own mean before they are multiplied, and two
    such results are merged with the product of the difference of their means.
    """

    def merge(a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return a if a[0] else b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, np.zeros(dims), np.zeros((dims, dims)))
        for batch in batches:
            for y in make(batch.column(0), ship.value):
                if len(y):
                    mean = y.mean(axis=0)
                    z = y - mean
                    total = merge(total, (len(y), mean, z.T @ z))
        yield pa.RecordBatch.from_pydict({"n": pa.array([total[0]], pa.int64()), "mean": pa.array([total[1].tobytes()], pa.binary()), "outer": pa.array([total[2].tobytes()], pa.binary())})

    def plain(row) -> tuple:
        return row["n"], np.frombuffer(row["mean"]), np.frombuffer(row["outer"]).reshape(dims, dims)

    zero = (0, np.zeros(dims), np.zeros((dims, dims)))
    return _tree(rows.mapInArrow(run, "n bigint, mean binary, outer binary"), zero, lambda a, row: merge(a, plain(row)), merge)


def _centred(column: pa.Array, fit: Fit) -> Iterator[np.ndarray]:
    for _, x in _matrices(column, fit.dims):
        yield fit.centred(x)[1]


def _projected(column: pa.Array, fit: Fit) -> Iterator[np.ndarray]:
    for y in _centred(column, fit):
        yield fit.projected(y)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of the vectors in the one column of ``vectors``; None if there are none."""
    spark = vectors.sparkSession

    def added(found: dict, part: dict) -> dict:
        out = dict(found)
        for dims, (n, sums) in part.items():
            m, before = out.get(dims, (0, (0,) * dims))
            out[dims] = m + n, tuple(a + b for a, b in zip(before, sums))
        return out

    def one(row) -> dict:
        high, low = (np.frombuffer(row[c], np.int64).tolist() for c in ("high", "low"))
        return {row["dims"]: (row["n"], tuple(h * _HALF + l for h, l in zip(high, low)))}

    found = _tree(vectors.mapInArrow(_sums, "dims int, n bigint, high binary, low binary"), {}, lambda a, row: added(a, one(row)), added)
    if not found:
        return None
    dims = max(found, key=lambda d: (found[d][0], d))
    n, sums = found[dims]
    mean = Fit(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    _, rest, outer = _moments(vectors, _centred, dims, spark.sparkContext.broadcast(mean))
    # centred at the exact mean already; what is left of it is rounding
    covariance = outer / n + np.outer(rest, rest)
    values, columns = np.linalg.eigh((covariance + covariance.T) / 2)
    values, columns = values[::-1], columns[:, ::-1]
    kept = min(components, dims)
    # beyond the rank of the vectors an eigenvalue is rounding
    positive = int((values[:kept] > max(float(values[0]), 0.0) * dims * np.finfo(float).eps * 4).sum()) if values[0] > 0 else 0
    return Fit(n, sums, np.ascontiguousarray(columns[:, :positive]), values[:positive].copy(), float(np.trace(covariance)))


_ROW = "n bigint, deviation bigint, deviation_digits string, whitened array<double>, explained array<double>, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, n, deviation, deviation_digits, whitened, explained, identity_error of every row that holds a vector.

    A row holds one unless it is null or empty or has an entry that is null or
    not finite (or of 2**56 and more, which no fixed-point number of 64 bits
    holds); if vectors differ in length, those of the most frequent length count
    (of equally frequent ones the longest), and the others are dropped like
    null.  An entry c becomes x = floor(64 c) + 1000000; ``n`` vectors have the
    sums S per dimension.  ``deviation`` is the sum over dimensions of
    (n x - S)**2, exactly: null where it is no long, with all digits in
    ``deviation_digits``.  ``whitened`` holds x - S / n on up to ``components``
    components (eigenvectors of the covariance with divisor n, by falling
    eigenvalue, either sign, the same for all rows), divided by the root of the
    eigenvalue; ``explained`` the eigenvalues' shares of the trace.  Beyond the
    vectors' rank there is nothing to divide by: whitened is null and explained
    0.  ``identity_error`` is the largest entry of the whitened rows' measured
    covariance minus the identity, over the components of positive variance
    (0 if there is none).  Ids may be null or repeat; other columns are not read.

    Three passes over the vectors before the one that returns them; the driver
    and every task hold matrices of dimension x dimension, nothing that grows
    with the rows.  Jobs run when this is called.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col).cast("array<double>").alias("vector")
    found = fit(rows.select(vector), components)
    kind = rows.schema[id_col].dataType
    if found is None:
        return spark.createDataFrame([], f"`{id_col}` {kind.simpleString()}, {_ROW}")
    shipped = spark.sparkContext.broadcast(found)
    rank = len(found.values)
    error = 0.0
    if rank:
        n, _, outer = _moments(rows.select(vector), _projected, rank, shipped)
        error = float(np.abs(outer / n - np.eye(rank)).max())
    kept = min(components, found.dims)
    shares = np.concatenate([found.values / found.trace if rank else np.zeros(0), np.zeros(kept - rank)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shipped.value
        for batch in batches:
            for at, x in _matrices(batch.column(1), fit.dims):
                d, centred = fit.centred(x)
                long, digits = deviations(d)
                whitened = np.full((len(x), kept), np.nan)
                whitened[:, :rank] = fit.projected(centred)
                cuts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * kept)
                lists = [pa.ListArray.from_arrays(cuts, v) for v in (pa.array(whitened.ravel(), from_pandas=True), pa.array(np.tile(shares, len(x))))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(np.full(len(x), fit.n)), pa.array(long, pa.int64()), pa.array(digits, pa.string()), *lists, pa.array(np.full(len(x), error))],
                    names=[id_col, "n", "deviation", "deviation_digits", "whitened", "explained", "identity_error"],
                )

    return rows.select(id_col, vector).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {_ROW}")
