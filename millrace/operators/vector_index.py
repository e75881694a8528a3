"""A clustered vector index: every row in the cell of its nearest centroid, searches that visit the nearest cells.

Cells are stored as blocks of up to a few thousand rows (their ids and one
matrix), so a cell that holds a third of all rows is many rows of the table.
Queries are stored alike, by the cells that they visit; a plain join by cell
brings the two together, and each pair of blocks is one matrix product that
keeps its k best.  No search scans the corpus once more for more queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranking import top_k
from millrace.operators.search import _Best
from millrace.session import new_folder, written

#: Rows of a block of the index, queries of a block.
ROWS, QUERIES = 2048, 512
#: Bytes of query blocks that are sent to every executor; beyond that both sides are shuffled.
BROADCAST = 32 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def k_means(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit vectors: Lloyd's rounds from distinct rows; a cell that runs empty gets the row farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.choice(len(distinct), min(cells, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = x @ centroids.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centroids)) == 0)
        centroids = _unit(sums)
        if len(empty):
            centroids[empty] = x[np.argsort(near.max(axis=1))[: len(empty)]]
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """Centroids, and a folder with the blocks of all rows (cell, ids, rows as a matrix) and each cell's greatest angle."""

    spark: SparkSession
    root: str
    centroids: np.ndarray

    @classmethod
    def build(cls, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, sample: int = 20_000, root: str | None = None) -> VectorIndex:
        """Index every row that has a vector (of one length; another length is an error); ids are whole numbers.

        Centroids are fitted on at most about ``sample`` rows, those of the
        least hashes of their ids; ``cells`` defaults to the root of the number of
        rows, at most 4096.  The angle between vectors is what counts.
        """
        spark, root = rows.sparkSession, (root or new_folder(rows.sparkSession, "vector-index")).rstrip("/")
        held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.size("vector") > 0)
        sizes = held.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
        if sizes["lo"] != sizes["hi"]:
            raise ValueError(f"vectors of {sizes['lo']} to {sizes['hi']} dimensions")
        n, dims = sizes["n"], sizes["lo"] or 1
        share = min(1.0, sample / max(1, n))
        some = held.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)) if share < 1 else held
        fitted = _matrix(some.select("vector").toArrow().combine_chunks().column(0).combine_chunks(), dims) if n else np.zeros((0, dims))
        centroids = k_means(_unit(fitted), cells or max(1, min(4096, int(n**0.5)))) if len(fitted) else np.zeros((0, dims))
        shipped = spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), dims)
                near = _unit(x) @ shipped.value.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(angle)], names=["cell", "id", "row", "angle"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # sorted by cell
                cells = batch.column(0).to_numpy()
                cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, np.arange(0, len(cells), ROWS), [len(cells)]]))
                parts = [(int(cells[a]), batch.column(1).slice(a, b - a).to_pylist(), b"".join(batch.column(2).slice(a, b - a).to_pylist()), max(batch.column(3).slice(a, b - a).to_pylist())) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
                kinds = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*parts) if parts else [()] * 4, kinds)], names=["cell", "ids", "matrix", "angle"])

        cells_of = written(held.mapInArrow(assign, "cell int, id bigint, row binary, angle double"), "vector-cells")
        blocks = cells_of.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(pack, "cell int, ids array<bigint>, matrix binary, angle double")
        blocks.write.parquet(f"{root}/blocks")
        return cls(spark, root, centroids)

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("cell int, ids array<bigint>, matrix binary, angle double").parquet(f"{self.root}/blocks")

    def _visits(self, queries: DataFrame, choose) -> DataFrame:
        """Blocks of queries by cell: (cell, names, matrix, least), for the cells that ``choose`` names for each unit vector and bound."""
        dims, shipped = self.centroids.shape[1], self.spark.sparkContext.broadcast(self.centroids)

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unit(_matrix(batch.column(1), dims))
                least = batch.column(2).to_numpy(zero_copy_only=False)
                query, cell = choose(x @ shipped.value.T, least)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0).take(pa.array(query)), pa.array([x[i].tobytes() for i in query.tolist()], pa.binary()), pa.array(least[query])], names=["cell", "name", "row", "least"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column(0).to_numpy()
                cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, np.arange(0, len(cells), QUERIES), [len(cells)]]))
                parts = [(int(cells[a]), batch.column(1).slice(a, b - a).to_pylist(), b"".join(batch.column(2).slice(a, b - a).to_pylist())) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*parts) if parts else [()] * 3, (pa.int32(), pa.list_(pa.int64()), pa.binary()))], names=["cell", "names", "queries"])

        each = written(queries.mapInArrow(visit, "cell int, name bigint, row binary, least double"), "query-cells")
        packed = each.repartitionByRange("cell", "name").sortWithinPartitions("cell", "name").mapInArrow(pack, "cell int, names array<bigint>, queries binary")
        return written(packed, "query-blocks")

    def _best(self, visits: DataFrame, k: int, id_col: str) -> DataFrame:
        """The k best of each query in each pair of blocks that meet in a cell."""
        dims = self.centroids.shape[1]
        size = visits.agg(F.sum(F.octet_length("queries")).alias("b")).first()["b"] or 0
        pairs = self.blocks().select("cell", "ids", "matrix").join(F.broadcast(visits) if size <= BROADCAST else visits, "cell").select("ids", "matrix", "names", "queries")

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(k)
            for batch in batches:
                for r in range(batch.num_rows):
                    ids, names = (np.array(batch.column(i)[r].as_py(), np.int64) for i in (0, 2))
                    x, q = (np.frombuffer(batch.column(i)[r].as_py()).reshape(-1, dims) for i in (1, 3))
                    scores = np.round(q @ _unit(x).T, 6) + 0.0
                    scores[names[:, None] == ids[None, :]] = -np.inf
                    best.add(names, ids, scores)
                if len(best.rows[0]) > 1 << 16:  # queries of cells that are done go out
                    yield best.batch(id_col)
                    best = _Best(k)
            yield best.batch(id_col)

        return pairs.mapInArrow(nearest, f"query_id bigint, `{id_col}` bigint, score double")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = 8, id_col: str = "vec_id", vector_col: str = "embedding", explain: dict | None = None) -> DataFrame:
        """query_id, id, score (cosine, 6 digits), rank: the k nearest rows in the ``probes`` nearest cells; ties: smaller id.

        With ``probes`` None the result is exact: after the eight nearest cells
        come all others that may hold something as near as the k-th found so
        far, by the angle between query and centroid less the cell's greatest
        angle.  A row is no match for the query of its own id; query ids are
        unique.  ``explain`` gets the number of pairs of query and cell
        (``pairs``) and how many of them were visited (``visited``).  Jobs run
        when this is called.
        """
        empty = self.spark.createDataFrame([], f"query_id bigint, `{id_col}` bigint, score double")
        cells = len(self.centroids)
        if not cells:
            return top_k(empty, k, [F.desc("score"), F.asc(id_col)])
        first = min(cells, probes or 8)

        def nearest(near: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            chosen = np.argsort(-near, axis=1, kind="stable")[:, :first]
            return np.repeat(np.arange(len(near)), first), chosen.ravel()

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vector_col).alias("vector")).where(F.size("vector") > 0)
        found = self._best(self._visits(asked.select("query_id", "vector", F.lit(-2.0).alias("least")), nearest), k, id_col)
        order = [F.desc("score"), F.asc(id_col)]
        if probes is not None or first == cells:
            if explain is not None:
                explain.update(pairs=asked.count() * cells, visited=asked.count() * first)
            return top_k(found, k, order)
        found = written(top_k(found, k, order).drop("rank"), "nearest-cells")
        least = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        widest = {r["cell"]: r["angle"] for r in self.blocks().groupBy("cell").agg(F.max("angle").alias("angle")).collect()}
        angles = np.array([widest.get(c, -np.inf) for c in range(cells)])

        def promising(near: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bound = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - angles))
            bound[:, ~np.isfinite(angles)] = -np.inf
            done = np.argsort(-near, axis=1, kind="stable")[:, :first]
            # scores are rounded, so what is a little lower may still tie
            open_ = bound >= least[:, None] - 2e-6
            np.put_along_axis(open_, done, False, axis=1)
            return np.nonzero(open_)

        again = asked.join(least, "query_id", "left").select("query_id", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
        visits = self._visits(again, promising)
        if explain is not None:
            more = visits.agg(F.sum(F.size("names")).alias("n")).first()["n"] or 0
            explain.update(pairs=asked.count() * cells, visited=asked.count() * first + more)
        return top_k(found.unionByName(self._best(visits, k, id_col)), k, order)
