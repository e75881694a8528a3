"""Merkle manifest of a dataset: one digest for all rows, and a proof for each.

Superblock reduction.  Leaves are numbered within their group; ``fanout**levels``
consecutive ones are a superblock, which one call of ``applyInPandas`` collapses
by ``levels`` levels to its root.  The roots are numbered by their superblock and
collapsed in the same way, until a group has one node, its subroot; the subroots
in the order of their groups are the leaves of one more such tree.  Proofs go the
other way: a superblock meets the proof of its root (a cogroup of the two), and
the siblings within the superblock, level by level, are put before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize
from millrace.llm.ranking import rank_table

FANOUT, LEVELS = 2, 10
#: Bytes of a digest.
SIZE = 32


def digest(nodes: list[bytes]) -> bytes:
    """SHA-256 of the nodes' digests as lowercase hex, one after the other."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def collapse(nodes: list[bytes], levels: int | None, fanout: int) -> list[list[bytes]]:
    """All levels over ``nodes``, themselves first: ``levels`` more, or as many as it takes to leave one."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def _tower(nodes: list[bytes], block: int, levels: int, fanout: int) -> list[list[bytes]]:
    """The levels of one superblock.  The first of a group, unless full, is all of it and ends with its one root."""
    return collapse(nodes, None if block == 0 and len(nodes) < fanout**levels else levels, fanout)


def _lower(tower: list[list[bytes]], i: int, fanout: int) -> tuple[bytes, bytes]:
    """(siblings left to right, number of siblings before and after the node on each level) of node i up to the tower's root."""
    siblings, counts = [], []
    for level in tower[:-1]:
        first = i - i % fanout
        run = level[first : first + fanout]
        siblings += run[: i - first] + run[i - first + 1 :]
        counts += [i - first, len(run) - 1 - (i - first)]
        i //= fanout
    return b"".join(siblings), bytes(counts)


def fold(leaf: bytes, siblings: bytes, counts: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    at, node = 0, leaf
    for before, after in zip(counts[0::2], counts[1::2]):
        run = [siblings[at + SIZE * j : at + SIZE * (j + 1)] for j in range(before + after)]
        node = digest([*run[:before], node, *run[before:]])
        at += SIZE * len(run)
    return node


_NODE = "grp string, at bigint, node binary"
_PROVED = "siblings binary, counts binary, subroot binary, root binary"


def _roots(nodes: DataFrame, levels: int, fanout: int, label: str) -> DataFrame:
    """The root of each superblock of nodes (grp, at, node), numbered within its group."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tower = _tower(rows.sort_values("at")["node"].tolist(), key[1], levels, fanout)
        return pd.DataFrame({"grp": [key[0]], "at": [key[1]], "node": [tower[-1][0]]})

    block = F.expr(f"at div {fanout**levels}").alias("block")
    return materialize(nodes.select("grp", "at", "node").groupBy("grp", block).applyInPandas(reduce, _NODE), label)


def _climb(nodes: DataFrame, levels: int, fanout: int, label: str) -> list[DataFrame]:
    """``nodes`` and the tables of roots above them; the last one has a node for each group."""
    out = [nodes]
    while True:
        out.append(_roots(out[-1], levels, fanout, label))
        # a superblock other than the first has roots beside it
        if out[-1].where("at > 0").isEmpty():
            return out


def _proofs(nodes: DataFrame, above: DataFrame, levels: int, fanout: int) -> DataFrame:
    """``nodes`` (grp, at, node and others) with their proofs, given those of their superblocks' roots."""
    names = [c for c in nodes.columns if c not in ("grp", "node")]

    def descend(key: tuple, rows: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        tower = _tower(rows["node"].tolist(), key[1], levels, fanout)
        lower = [_lower(tower, i, fanout) for i in range(len(rows))]
        upper = roots.iloc[0]
        out = rows[["grp", "node", *names]].copy()
        out["siblings"] = [s + upper["siblings"] for s, _ in lower]
        out["counts"] = [c + upper["counts"] for _, c in lower]
        out["subroot"], out["root"] = [upper["subroot"]] * len(out), [upper["root"]] * len(out)
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*names).schema)
    block = F.expr(f"at div {fanout**levels}").alias("block")
    roots = above.select("grp", F.col("at").alias("block"), "siblings", "counts", "subroot", "root")
    return nodes.groupBy("grp", block).cogroup(roots.groupBy("grp", "block")).applyInPandas(descend, f"grp string, node binary, {kinds}, {_PROVED}")


def _descend(tables: list[DataFrame], top: DataFrame, levels: int, fanout: int, label: str) -> DataFrame:
    """Proofs of the lowest of the tables of :func:`_climb`, given those of the highest."""
    above = top
    for nodes in reversed(tables[1:-1]):
        written = materialize(_proofs(nodes, above, levels, fanout), label)
        above = written
    return _proofs(tables[0], above, levels, fanout)


def field(value: Column) -> Column:
    """A value as a leaf holds it: ``-`` if null, else its number of UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def manifest(rows: DataFrame, group_col: str, order_col: str, leaf_col: str, carry: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """order_col, ``carry``, group_col, at, leaf, subroot, root, siblings, counts of every row: its place in the tree and its proof.

    ``leaf_col`` holds a binary digest.  In each group leaves ascend by
    ``order_col`` (null first), then by digest; ``fanout`` consecutive nodes
    become one until one is left.  Subroots in the order of their groups (null
    first, else by the bytes of their UTF-8) likewise give the root.  A proof is
    the siblings' digests, from the leaf to the root and from left to right
    (32 bytes each), and for each level how many are left and right of the node
    (a byte each).  Rows that repeat are leaves of their own; an empty table
    has an empty manifest.

    A superblock of ``fanout**levels`` rows is the most that a task holds at
    once, however large a group is; rows are numbered without a task for each
    group.  Jobs run when this is called.
    """
    if not 2 <= fanout <= 256 or levels < 1:
        raise ValueError("fanout is 2 to 256, levels at least 1")
    # an order and equality of strings that are never null
    grp = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    source = rows.select(grp.alias("grp"), F.col(order_col).alias("ord"), F.col(leaf_col).alias("node"), F.struct(*carry).alias("carried") if carry else F.lit(None).cast("string").alias("carried"))
    leaves = materialize(source.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    numbers = rank_table(leaves, ["grp"], ["ord", "node", "row"], "merkle-ranked")
    discard(leaves)
    nodes = numbers.select("grp", (F.col("place") - F.col("first")).alias("at"), "node", "ord", "carried")
    own = _climb(nodes, levels, fanout, "merkle-roots")
    # the groups' subroots are the leaves of a tree of their own
    one = materialize(own[-1].select(F.lit("").alias("all"), "grp", "node"), "merkle-subroots")
    order = rank_table(one, ["all"], ["grp"], "merkle-groups")
    subroots = order.select(F.lit("").alias("grp"), (F.col("place") - F.col("first")).alias("at"), "node", F.col("grp").alias("name"))
    all_ = _climb(subroots, levels, fanout, "merkle-root")
    nothing = F.lit(b"").cast("binary")
    root = all_[-1].select("grp", "at", nothing.alias("siblings"), nothing.alias("counts"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    proved = _descend(all_, root, levels, fanout, "merkle-proofs")
    top = materialize(proved.select(F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("at"), "siblings", "counts", F.col("node").alias("subroot"), "root"), "merkle-top")
    found = _descend(own, top, levels, fanout, "merkle-proofs")
    group = F.when(F.col("grp") == "", F.lit(None)).otherwise(F.expr("substring(grp, 2)")).cast(rows.schema[group_col].dataType)
    carried = [F.col(f"carried.{c}").alias(c) for c in carry]
    return found.select(F.col("ord").alias(order_col), *carried, group.alias(group_col), "at", F.col("node").alias("leaf"), "subroot", "root", "siblings", "counts")


def folded(proofs: DataFrame, leaf_col: str, into: str = "folded_root") -> DataFrame:
    """``proofs`` with the root that the leaf in ``leaf_col`` and the proof of the row lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (leaf_col, "siblings", "counts")]
            roots = pa.array([fold(*row) for row in zip(*columns)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, roots], names=[*batch.schema.names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema)
    return proofs.mapInArrow(run, f"{kinds}, `{into}` binary")


def hexed(column: str) -> Column:
    return F.lower(F.hex(column))
