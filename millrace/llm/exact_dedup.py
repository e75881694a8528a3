"""Exact duplicates by progressive refinement (DataFrame operations only).

Texts that can be equal are narrowed in three steps: same length in bytes,
then same prefix hash, then same SHA-256 of the whole text.  Only rows whose
(length, prefix) is shared reach the third step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    broadcast_keys: int = 1_000_000,
) -> DataFrame:
    """One row per text that occurs more than once: text_sha256, keep_id, group_size.

    Texts are equal when their bytes are; null counts as empty.  ``keep_id`` is
    the largest id of the group (null only if all ids of the group are null).

    The keys that survive the second step go to every executor while there are
    at most ``broadcast_keys`` of them (8 bytes each, counted first), and only
    rows that carry one are hashed in full.  Beyond that a row's hash is taken
    in the scan and narrow rows are joined by key, so that no text is shuffled:
    a choice of plan, by size, between two ways to the same rows.  Other columns
    of ``docs`` are not read, whatever their names.

    Hot lengths and hot texts: counts are combined before each shuffle, and the
    semi-joins have nothing above them that keeps a partition whole, so that
    adaptive execution can split them.  Empty table: no rows.
    """
    text = _text(text_col)
    n_bytes = F.octet_length(text)
    prefix_key = F.xxhash64(n_bytes, F.substring(text, 1, prefix_chars))
    signatures = materialize(docs.select(n_bytes.alias("n_bytes"), prefix_key.alias("prefix_key")), "dedup-signatures")

    shared_lengths = signatures.groupBy("n_bytes").count().where("count > 1").select("n_bytes")
    # prefix_key holds the length, so this groups by (length, prefix)
    shared_prefixes = signatures.join(shared_lengths, "n_bytes", "left_semi").groupBy("prefix_key").count().where("count > 1").select("prefix_key")
    shared_prefixes = materialize(shared_prefixes, "dedup-prefixes")
    discard(signatures)

    sha = F.sha2(text, 256).alias("text_sha256")
    if shared_prefixes.count() <= broadcast_keys:
        rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col), prefix_key.alias("prefix_key"))
        survivors = rows.join(F.broadcast(shared_prefixes), "prefix_key", "left_semi").select("__id", sha)
    else:
        rows = docs.select(F.col(id_col).alias("__id"), prefix_key.alias("prefix_key"), sha)
        survivors = rows.join(shared_prefixes, "prefix_key", "left_semi").select("__id", "text_sha256")
    return (
        survivors.groupBy("text_sha256")
        .agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; a text that occurs once
    is its own group.  Rows that repeat id and text alike are the same
    document: each counts in ``group_size`` and each is returned with the same
    ``kept``.  Among rows without id the group's null is the id that stays.
    """
    # written, so that both sides of the join are plain exchanges and a hot text can be split
    groups = materialize(duplicate_groups(docs, id_col, text_col, **options), "dedup-groups")
    rows = docs.select(F.col(id_col), F.sha2(_text(text_col), 256).alias("text_sha256"))
    # a text without group stands for itself; within a group keep_id is null only if no row has an id
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return rows.join(groups, "text_sha256", "left").select(
        id_col,
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col(id_col).eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
