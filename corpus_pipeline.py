"""The corpus pipeline: documents through five stages, each written and read again.

Toxic documents go, of equal texts one row stays, of near duplicates one
row stays, contaminated documents go, and what is left is encoded.

Stages decide by row, not by id: null and repeated ids, repeated rows and null
texts (which count as empty) are rows like any other, an empty table stays
empty, and columns beyond those of documents are carried along, whatever their
names (the first four stages) or left out (the last).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, drop_rows, materialize, numbered, table, unused
from millrace.session import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; learned from the labels of ``sf_dir``.  A text that repeats is judged alike each time."""
    from millrace.llm.queries import toxicity_model
    from millrace.llm.toxicity import drop_toxic

    return drop_toxic(docs, toxicity_model(spark, docs, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, of the largest id; rows without id come last.

    Null and empty texts are equal.  Of rows of one id and text one stays.
    """
    from millrace.llm.exact_dedup import exact_dedup as judge

    number = unused(docs, "__row")
    rows = numbered(docs, number)
    row = F.struct(F.col("doc_id").alias("id"), F.col(number).alias("number"))
    judged = judge(rows.select(row.alias("row"), "text"), "row").where("NOT kept")
    return drop_rows(rows, materialize(judged.select("row.number"), "exact-dropped"), number)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row, of the smallest id; rows without id come last.

    Texts without words are one component.
    """
    from millrace.llm.simhash import near_duplicates

    ship(spark)
    number = unused(docs, "__row")
    rows = numbered(docs, number)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(number).alias("number"))
    judged = near_duplicates(rows.select(row.alias("row"), "text"), "row").where("row.number <> component_id.number")
    return drop_rows(rows, materialize(judged.select("row.number"), "near-dropped"), number)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have none."""
    from millrace.llm.winnowing import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, score, nbest_scores, nbest_edits, round_trip of every document."""
    from millrace.llm.sentencepiece_nbest import Pieces, encode

    ship(spark)
    return encode(docs, Pieces.load(), edits=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The first and the last stage have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            discard(before)  # the next stage's table is written, so nothing reads this one any more
        before = docs
    return docs
