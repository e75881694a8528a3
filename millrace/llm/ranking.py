"""Ranks of all rows in one order, without one task for a key that many rows share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import discard, materialize


def _runs(keys: Sequence[str], drop_alone: bool, forget: bool):
    """Sorted rows of one partition with their place in it, that of the first row of the same keys, and whether there is just one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, at, begin = None, 0, 0  # the last row so far, its place, the first row of its keys

        def told(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], int]:
            """All rows but the last (or all), numbered from ``at``, and where the keys of the last one begin."""
            n = rows.num_rows
            same = np.ones(max(0, n - 1), bool)
            for k in keys:
                column = rows.column(k).combine_chunks()
                same &= pc.equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
            places = np.arange(at, at + n)
            begins = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), places, 0))
            begins = np.where(np.concatenate([[True], ~same]).cumsum() == 1, begin, begins)
            alone = (begins == places) & ~np.concatenate([same, [False]])
            keep = np.arange(n) < (n if last else n - 1)
            ends = (places == 0) | (last & (np.arange(n) == n - 1))
            if drop_alone:
                # the first and the last row of a partition may have an equal one in the next
                keep &= ~alone | ends
            if forget:  # the ends of a partition are compared with the next one's, no other row's keys are read again
                for k in keys:
                    i = rows.schema.get_field_index(k)
                    rows = rows.set_column(i, rows.schema.field(i), pc.if_else(pa.array(ends), rows.column(k), pa.scalar(0, rows.schema.field(i).type)))
            out = rows.append_column("__part", pa.array(np.full(n, part, np.int32))).append_column("__at", pa.array(places))
            out = out.append_column("__begin", pa.array(begins)).append_column("__alone", pa.array(alone)).append_column("__end", pa.array(ends)).filter(pa.array(keep))
            return out.combine_chunks().to_batches(), int(begins[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            done, begin = told(rows, False)
            yield from done
            held, at = rows.slice(rows.num_rows - 1), at + rows.num_rows - 1
        if held is not None:
            yield from told(held, True)[0]

    return run


def ranked(df: DataFrame, keys: Sequence[str], ties: Sequence[str], label: str, drop_alone: bool = False, forget: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with ``place``, ``first`` and ``alone``, the table under them).

    ``place`` is a row's number from 0 in the order of ``keys`` and ``ties``,
    ``first`` that of the first row with its keys, so that rows of equal keys
    have one ``first``; ``alone`` says that no other row has the keys.  With
    ``drop_alone`` such rows are left out (and still counted).  With ``forget``
    the result is without the keys, which must be whole numbers; digests take
    most of such a table.

    Rows are dealt out by ranges of keys and ties together, so rows that share
    their keys fall into as many partitions as they need; a row for each
    partition (its size, its first and last keys) goes through the driver and
    says where the next one begins.  Keys may not be null; keys and ties
    together should be unique, else equal rows take their places by chance.
    ``df`` is read twice, so it should be a written table.  Rows are written
    once: nothing is numbered anew when a task runs again.
    """
    spark = df.sparkSession
    added = [T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType()), T.StructField("__begin", T.LongType()), T.StructField("__alone", T.BooleanType()), T.StructField("__end", T.BooleanType())]
    ordered = df.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys, *ties)
    rows = materialize(ordered.mapInArrow(_runs(keys, drop_alone, forget), T.StructType([*df.schema.fields, *added])), label, ("__at", "__begin"))
    key = F.struct(*keys)
    # the first and the last row of each partition tell all of it
    ends = rows.where("__end").groupBy("__part").agg(
        (F.max("__at") + 1).alias("n"), F.min_by(key, "__at").alias("low"), F.max_by(key, "__at").alias("high"), F.max("__begin").alias("last")
    )
    parts, offset, begun, before = [], 0, 0, None
    for e in sorted(ends.collect(), key=lambda e: e["__part"]):
        # the rows of the first keys go on from the part before, if that ended with them
        goes_on = before is not None and before["high"] == e["low"]
        if goes_on:
            parts[-1][4] = True
        carry = begun if goes_on else None
        parts.append([e["__part"], offset, carry, e["last"], False])
        begun = carry if goes_on and e["last"] == 0 else offset + e["last"]
        offset, before = offset + e["n"], e
    kinds = {"__part": pa.int32(), "offset": pa.int64(), "carry": pa.int64(), "last": pa.int64(), "more": pa.bool_()}
    sizes = spark.createDataFrame(pa.table([pa.array([p[i] for p in parts], kind) for i, kind in enumerate(kinds.values())], names=[*kinds]))
    told = rows.join(F.broadcast(sizes), "__part")  # a row for each partition
    carried = (F.col("__begin") == 0) & F.col("carry").isNotNull()
    told = told.select(
        *[rows[f.name] for f in df.schema.fields if not (forget and f.name in keys)],
        (F.col("offset") + F.col("__at")).alias("place"),
        F.when(carried, F.col("carry")).otherwise(F.col("offset") + F.col("__begin")).alias("first"),
        (F.col("__alone") & ~carried & ~((F.col("__begin") == F.col("last")) & F.col("more"))).alias("alone"),
    )
    return (told.where("NOT alone") if drop_alone else told), rows


def rank_table(df: DataFrame, keys: Sequence[str], ties: Sequence[str], label: str, drop_alone: bool = False, forget: bool = False) -> DataFrame:
    """:func:`ranked`, written; the table under it goes."""
    told, rows = ranked(df, keys, ties, f"{label}-sorted", drop_alone, forget)
    out = materialize(told, label)
    discard(rows)
    return out
