"""Shared plumbing: reading inputs, cutting lineage, bounded joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder, ship

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the executions inside go as soon as each has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str, plain: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    whole history, and what Python computed is not computed again.  The table
    goes when the driver's JVM ends.  Columns of digests and the like, whose
    values hardly repeat, are best named in ``plain``: no dictionary is tried.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        # small row groups: what a writer holds is bounded, also for whole texts
        df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain}).option("parquet.block.size", 16 << 20).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = hadoop
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote; nothing may read these tables any more."""
    for df in tables:
        df._written_to.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._written_to, True)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` is called that, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, row: str = "__row") -> DataFrame:
    """``docs`` written once with a unique number of each row in ``row``, see :func:`unused`; ids may be null or repeat."""
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def drop_rows(docs: DataFrame, dropped: DataFrame, row: str = "__row", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of :func:`numbered` ``docs`` whose number is not in ``dropped`` (materialised, one column), without it.

    Up to ``broadcast_rows`` numbers (8 bytes each, counted first) go to every
    executor and the texts stay where they are; beyond that both sides are
    shuffled by number.
    """
    rows = dropped.toDF("__dropped")
    if rows.count() <= broadcast_rows:
        rows = F.broadcast(rows)
    return docs.join(rows, docs[row] == rows["__dropped"], "left_anti").drop(row)
