"""Near duplicates by SimHash, linked with a segment-popcount grid join.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments.
The Manhattan distance of two such vectors never exceeds the fingerprints'
Hamming distance, so fingerprints within r bits have vectors within distance r:
over ``blocks`` groups of segments, at most r groups differ.  Each fingerprint
is therefore put into the grid cells of all choices of ``blocks - r`` groups.
Those that meet in a cell are first compared by the Manhattan distance of their
vectors, which drops most pairs, and what is left bit by bit.  Fingerprints of
dense cells are dealt anew into the cells of a finer choice of groups.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize
from millrace.llm.components import connected_components
from millrace.llm.words import pieces

SHINGLE, SEED, RADIUS = 3, 42, 3
_PART = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the text's word shingles, repeats included; 0 if it has no word.

    A-Z are lowered; a text of fewer words than ``shingle`` is one shingle.  A
    bit is 1 if it is set in over half of the shingles' XXH64.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[:-shingle] + 1).tolist()]
    last = ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), _PART):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + _PART], last[at : at + _PART])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(last), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp as a signed long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1)):
                found = np.array([fingerprint(t) for t in texts], np.uint64)
                yield pa.RecordBatch.from_pydict({id_col: batch.column(0).slice(at, len(texts)), "fp": pa.array(found.view(np.int64))})

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def popcounts(fp: Column) -> Column:
    """The counts of the 32 two-bit segments, packed in their places."""
    even, odd = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    ones, twos = fp.bitwiseXOR(odd).bitwiseAND(even), fp.bitwiseAND(odd).bitwiseAND(even)
    return ones.bitwiseOR(F.shiftleft(twos, 1))


def unary(fp: np.ndarray) -> np.ndarray:
    """The same counts as 00, 01 or 11, so that vectors differ here in as many bits as their Manhattan distance."""
    even, one = np.uint64(0x5555555555555555), np.uint64(1)
    low, high = fp & even, fp >> one & even
    return low | high | (low & high) << one


def cell_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """For each choice of ``blocks - radius`` groups of segments, their bits as a signed long."""
    edges = [2 * round(32 * i / blocks) for i in range(blocks + 1)]
    groups = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [_signed(sum(choice)) for choice in itertools.combinations(groups, blocks - radius)]


#: Groups of segments of the grids, coarse to fine.
GRIDS = (5, 6, 8, 12, 16)


def blocks_for(n: int) -> int:
    """Groups of segments so that cells stay small: finer choices for more fingerprints."""
    return 5 if n <= 1 << 25 else 6 if n <= 1 << 29 else 8


def _near(fp: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (i, j) are within radius: by the lower bound first, then exactly."""
    out = np.bitwise_count(counts[i] ^ counts[j]) <= radius
    left = np.flatnonzero(out)
    out[left] = np.bitwise_count(fp[i[left]] ^ fp[j[left]]) <= radius
    return out


def _links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows that share a group, have different sides (or none) and are within radius.

    ``group`` is sorted.  Small groups are compared by shifting the whole
    arrays, large ones block by block in the order of their bit counts, each
    block with the rows whose whole count is within radius; of each connected
    set in the batch only the links to its first row are returned.
    """
    n = len(fp)
    counts = unary(fp)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    size_of = np.repeat(sizes, sizes)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.flatnonzero(size_of <= 64)
    for d in range(1, int(sizes[sizes <= 64].max(initial=0))):
        small = small[small + d < n]
        i = small = small[group[small] == group[small + d]]
        i = i[(side[i] < 0) | (side[i] != side[i + d])]
        near = i[_near(fp, counts, i, i + d, radius)]
        pairs.append((near, near + d))
    for a, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        ones = np.bitwise_count(fp[a : a + size])
        order = np.argsort(ones, kind="stable")
        ones, order = ones[order].astype(np.int64), order + a
        for at in range(0, size, 256):
            block = order[at : at + 256]
            other = order[at : np.searchsorted(ones, ones[min(at + 256, size) - 1] + radius, "right")]
            i, j = np.nonzero(np.bitwise_count(counts[block, None] ^ counts[None, other]) <= radius)
            i, j = block[i[i < j]], other[j[i < j]]
            keep = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & ((side[i] < 0) | (side[i] != side[j]))
            pairs.append((i[keep], j[keep]))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*pairs))
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    member = np.flatnonzero(root != np.arange(n))
    return root[member], member


def _cells(fingerprints: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(fp, choice, cell) of every fingerprint in the grid of ``blocks`` groups."""
    masks = cell_masks(blocks, radius)
    cells = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)))
    rows = fingerprints.select("fp", popcounts(F.col("fp")).alias("counts"))
    return rows.select("fp", F.explode(cells).alias("c")).select("fp", "c.choice", "c.cell")


def linked(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = 1024, dense: int = 16_384) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that span all links within ``radius`` bits; written.

    The fingerprints of cells of more than ``dense`` are dealt anew into the
    grid of the next finer choice of groups, which holds all links among them.
    In the finest grid, and below that size, a cell of more than ``chunk``
    fingerprints is dealt into chunks and every pair of chunks is compared as a
    group of its own, so no task holds more than two chunks of a cell, however
    large it is.  Of each group only spanning edges are written, not all pairs.
    """
    blocks = blocks or blocks_for(distinct.count())
    found: list[DataFrame] = []
    level, own = distinct.select("fp"), False
    for grid in (blocks, *(g for g in GRIDS if g > blocks)):
        rows = _cells(level, grid, radius)
        shared = materialize(rows.groupBy("choice", "cell").count().where("count > 1").select("choice", "cell", F.col("count").alias("size")), "simhash-cells")
        last = grid >= GRIDS[-1] or shared.where(F.col("size") > dense).isEmpty()
        here = shared if last else shared.where(F.col("size") <= dense)
        found.append(materialize(_compared(rows.join(here, ["choice", "cell"]), radius, chunk), "simhash-links"))
        if not last:
            finer = materialize(rows.join(shared.where(F.col("size") > dense), ["choice", "cell"]).groupBy("fp").agg(F.lit(0)).select("fp"), "simhash-dense")
        discard(shared, *([level] if own else []))
        if last:
            break
        level, own = finer, True
    if len(found) == 1:
        return found[0]
    edges = materialize(functools.reduce(DataFrame.union, found), "simhash-links")
    discard(*found)
    return edges


def _compared(rows: DataFrame, radius: int, chunk: int) -> DataFrame:
    """Spanning edges (a, b) of the cells in rows (fp, choice, cell, size)."""
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # a cell of one chunk is one group without sides; else a row meets every chunk, its own too
    rows = rows.withColumn("chunks", chunks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(
        F.xxhash64("choice", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("grp"),
        F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"),
        "fp",
    )
    rows = rows.repartition("grp").sortWithinPartitions("grp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)]

        def run(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _links(group, side, fp, radius) if len(fp) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_pydict({"a": pa.array(fp[a].view(np.int64)), "b": pa.array(fp[b].view(np.int64))})

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new)]
            # the last group may go on in the next batch
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield run(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
        yield run(*held)

    return rows.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits, itself included; rows without id have null
    unless they reach one that has.  Texts without words have fingerprint zero
    and are linked like any other; rows of equal fingerprint are one vertex,
    so copies cost nothing beyond their row.  Other columns of ``docs`` are not
    read.  Empty table: no rows.  Jobs run when this is called; intermediate
    tables go as soon as they have been read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    edges = linked(distinct.select("fp"), radius, blocks)
    labels = connected_components(edges)
    rooted = materialize(distinct.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("root")), "simhash-roots")
    discard(edges, labels, distinct)
    components = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    of_print = materialize(rooted.join(components, "root").select("fp", "component_id"), "simhash-map")
    discard(rooted, components)
    return rows.join(of_print, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
