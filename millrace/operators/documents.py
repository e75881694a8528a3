"""Validation, cleaning, identifiers and chunking of documents."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import chunking
from millrace.functions import text as tx
from millrace.session import written


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode normalisation, for which Spark has no function."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def clean_documents(docs: DataFrame, text_col: str = "text", unicode: bool = True, html: bool = True) -> DataFrame:
    """Replace the text by its cleaned form; adds char_count and token_estimate."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    cleaned = tx.clean_text(nfkc(raw) if unicode else raw, html)
    return docs.withColumn(text_col, cleaned).withColumns({"char_count": F.length(text_col), "token_estimate": tx.token_estimate(F.col(text_col))})


def validate(
    docs: DataFrame,
    id_col: str = "doc_id",
    order: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    shortest: int = 50,
    longest: int = 1_000_000,
) -> DataFrame:
    """id, valid, errors, warnings: checks on the raw text; warnings don't reject.

    A text whose normalised form occurred before (in ``order``) is a duplicate,
    even if its first occurrence is invalid itself.  ``order`` is unique.  First
    occurrences are found by an aggregate that is combined before the shuffle,
    and rows meet them by place, so a text with many copies is split.  The
    checks run when this is called; their narrow result is written once.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    n, estimate = F.length(t), tx.token_estimate(t)
    problems = tx.suspicious(t)
    errors = [
        F.when(F.length(tx.normalize_text(t)) == 0, "empty"),
        F.when(n < shortest, "too short"),
        F.when(n > longest, "too long"),
        F.when(F.size(problems) > 0, F.concat(F.lit("suspicious: "), F.array_join(problems, ", "))),
        F.when(tx.max_char_ratio(t) > 0.5, "repetition"),
        F.when(t.rlike(tx.INVALID_CHARACTER), "invalid characters"),
        F.when(F.col(id_col).isNull(), "missing id"),
        F.when(F.coalesce(F.col(source_col), F.lit("")) == "", "missing source"),
    ]
    warnings = [
        F.when(estimate < 10, "few tokens"),
        F.when(estimate > 100_000, "many tokens"),
        F.when(F.size(tx.long_lines(t)) > 0, "long lines"),
        F.when(t.rlike(r"\s{10,}"), "white space"),
        F.when(tx.english_ratio(t) < 0.7, "little English"),
    ]
    # judged and hashed in one scan and written, so that no text is read twice or shuffled
    judged = docs.select(F.col(id_col).alias("__id"), F.col(order).alias("__order"), F.array_compact(F.array(*errors)).alias("e"), F.array_compact(F.array(*warnings)).alias("warnings"), tx.content_hash(t).alias("__hash"))
    judged = written(judged, "judged")
    first = judged.groupBy("__hash").agg(F.min("__order").alias("__order")).select("__order", F.lit(True).alias("__first"))
    again = F.when(F.col("__first").isNull(), F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>"))
    return judged.join(first, "__order", "left").withColumn("errors", F.concat("e", again)).select(F.col("__id").alias(id_col), (F.size("errors") == 0).alias("valid"), "errors", "warnings")


def identifiers(docs: DataFrame, source: Column, external_id: Column, text: Column, index: Column | None = None) -> DataFrame:
    """Adds doc_sha256, built_id, chunk_id and point_uuid."""
    digest = tx.content_hash(text)
    built = tx.doc_id(source, external_id, digest)
    chunk = tx.chunk_id(built, F.lit(0) if index is None else index)
    return docs.withColumns({"doc_sha256": digest, "built_id": built, "chunk_id": chunk, "point_uuid": tx.uuid_of(chunk)})


def chunk(docs: DataFrame, strategy: str | Callable[[str], list[str]] = "recursive", id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(id, chunk_index, chunk_text): the chunks of every document; a null or blank text has none.

    The chunkers build on the text before, which a Column expression can do
    only in quadratic time; they run in Arrow batches where the documents lie.
    """
    cut = chunking.STRATEGIES[strategy] if isinstance(strategy, str) else strategy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, texts = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = cut(t, **options) if t and t.strip() else []
                rows += [i] * len(found)
                number += range(len(found))
                texts += found
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0).take(pa.array(rows, pa.int32())), "chunk_index": pa.array(number, pa.int32()), "chunk_text": pa.array(texts, pa.string())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, chunk_text string")


def chunk_by_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", use_semantic: bool = False, scope: str = "per_doc") -> DataFrame:
    """Chunks with the strategy that suits each document, or with ``first_doc`` the first one's for all."""

    def pick(t: str) -> list[str]:
        name, body = t.split("\x00", 1)
        return chunking.STRATEGIES[name](body)

    strategy = tx.content_strategy(F.col(text_col), use_semantic)
    if scope == "first_doc":
        first = docs.orderBy(id_col).select(strategy.alias("s")).head()
        strategy = F.lit(first["s"] if first else "recursive")
    return chunk(docs.select(id_col, F.concat(strategy, F.lit("\x00"), F.col(text_col)).alias(text_col)), pick, id_col, text_col)


def count_chunks(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds num_chunks; ids are counted (combined before the shuffle) and joined back, no document is gathered in one task."""
    counts = chunks.groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("num_chunks"))
    return chunks.join(counts, chunks[id_col].eqNullSafe(counts["__id"])).drop("__id")


def containment(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "item", text_col: str = "text", anchor: int = 5) -> DataFrame:
    """(item id, id): documents whose text holds an item's text.

    Inner words of an item stand in the document word for word, so its second
    to ``anchor + 1``-th words are looked up among the documents' runs of as
    many words.  Shorter items with an inner word are looked up by all their
    inner words, so runs of every such length are met.  Where the items' keys
    are few (8 bytes each, counted first) they go to every executor and runs
    that no item has are dropped where they are; only matches meet their texts
    again.  Items of one or two words have no inner word: they are compared
    with every document, block by block, at most ``2 ** 16`` of them at once.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    sized = items.withColumn("__w", words(F.col(item_text))).withColumn("__n", F.least(F.lit(anchor), F.size("__w") - 2))
    keyed = sized.where("__n >= 1").select(item_col, item_text, F.col("__n").alias("n"), F.xxhash64("__n", F.slice("__w", 2, F.col("__n"))).alias("__key"))
    found = []
    doc_words = docs.select(F.col(id_col), F.col(text_col), words(F.col(text_col)).alias("__w"))
    lengths = [r["n"] for r in keyed.select("n").distinct().collect()]  # at most ``anchor``
    keys = keyed.select("__key").distinct()
    keys = F.broadcast(keys) if keys.count() <= 1 << 20 else keys

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__w") - n + 1)), lambda i: F.xxhash64(F.lit(n), F.slice("__w", i, n)))

    for n in lengths:
        runs = runs_of(n)
        found.append(doc_words.select(id_col, F.explode(F.array_distinct(runs)).alias("__key")).join(keys, "__key", "left_semi"))
    parts = []
    if found:
        places = functools.reduce(DataFrame.unionByName, found).join(keyed.drop("n"), "__key").select(id_col, item_col, item_text)
        parts.append(docs.select(id_col, text_col).join(places, id_col).where(F.col(text_col).contains(F.col(item_text))))
    rest = sized.where("__n < 1").select(item_col, item_text)
    n_rest = rest.count()
    for block in range(-(-n_rest // (1 << 16))):
        mine = rest.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(-(-n_rest // (1 << 16)))) == block)
        parts.append(docs.select(id_col, text_col).join(F.broadcast(mine), F.col(text_col).contains(F.col(item_text))))
    if not parts:
        return items.select(item_col).limit(0).join(docs.select(id_col), F.lit(False))
    return functools.reduce(DataFrame.unionByName, [p.select(item_col, id_col) for p in parts])
