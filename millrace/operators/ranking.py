"""Per-query top-k, score normalisation, filters and post-processors of ranked results.

A ranking is a DataFrame with ``query_id``, a document id, ``score`` and
``rank`` (from 1, unique within a query).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int | None, order: Sequence[Column], query: str = "query_id") -> DataFrame:
    """The first k rows of each query in ``order``, which must be total; adds ``rank``."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def min_max(results: DataFrame, constant: str = "one", query: str = "query_id", score: str = "score", to: str = "norm_score") -> DataFrame:
    """Scores of each query moved to [0, 1].

    Where all scores of a query are equal they become 1 (``one``), the
    reciprocal rank (``reciprocal_rank``) or stay (``keep``).
    """
    w = Window.partitionBy(query)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    flat = {"one": F.lit(1.0), "reciprocal_rank": 1.0 / F.col("rank") if "rank" in results.columns else F.lit(1.0), "keep": F.col(score)}[constant]
    span = F.lit(1e-10) if constant == "reciprocal_rank" else F.lit(0.0)
    return results.withColumn(to, F.when(hi - lo > span, (F.col(score) - lo) / (hi - lo)).otherwise(flat))


def score_filter(results: DataFrame, min_score: float = 0.5, score: str = "score") -> DataFrame:
    return results.where(F.col(score) >= min_score)


def above(results: DataFrame, min_score: float = 0.0, score: str = "score") -> DataFrame:
    """A retriever's threshold: it counts only if it is above 0."""
    return score_filter(results, min_score, score) if min_score > 0 else results


def limit_results(results: DataFrame, max_results: int = 10) -> DataFrame:
    return results.where(F.col("rank") <= max_results)


_OPERATORS = {
    ">=": lambda c, v: c >= v,
    ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v,
    "<": lambda c, v: c < v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
}


def metadata_predicate(criteria: Mapping[str, Any], lookup: Mapping[str, Column], first_operator_only: bool = False) -> Column:
    """AND over keys: a list is membership, a mapping operators, else equality; a missing value fails."""
    keep = F.lit(True)
    for key, wanted in criteria.items():
        value = lookup[key]
        if isinstance(wanted, Mapping):
            tests = list(wanted.items())[: 1 if first_operator_only else None]
            for name, operand in tests:
                keep = keep & F.coalesce(_OPERATORS[name](value, operand), F.lit(False))
        else:
            keep = keep & F.coalesce(value.isin(*wanted) if isinstance(wanted, (list, tuple, set)) else value == wanted, F.lit(False))
    return keep


def label_or_metadata(results: DataFrame, key: str, labels: str = "labels", metadata: str = "metadata") -> Column:
    """The value of ``key`` among the labels, or where that is missing or empty in the metadata; both are maps or structs."""

    def of(name: str) -> Column:
        if name not in results.columns:
            return F.lit(None)
        kind = results.schema[name].dataType
        if hasattr(kind, "fieldNames"):
            return F.col(f"{name}.{key}") if key in kind.fieldNames() else F.lit(None)
        return F.try_element_at(F.col(name), F.lit(key))

    label, other = of(labels), of(metadata)
    falsy = label.isNull() | label.cast("string").isin("", "0", "0.0", "false")
    return F.when(falsy, other).otherwise(label)


def document_key(external_id: Column, text: Column) -> Column:
    """The key under which strategies' results are merged: the external id, else the MD5 of the text."""
    return F.coalesce(external_id.cast("string"), F.md5(text))


def metadata_filter(results: DataFrame, criteria: Mapping[str, Any], lookup: Mapping[str, Column] | None = None, **options: bool) -> DataFrame:
    return results.where(metadata_predicate(criteria, lookup or {k: F.col(k) for k in criteria}, **options))


def tag_filter(results: DataFrame, required: Sequence[str] = (), excluded: Sequence[str] = (), tags: str = "tags") -> DataFrame:
    """All required tags present, none of the excluded."""
    has = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    keep = F.lit(True)
    if required:
        keep = keep & (F.size(F.array_except(F.array(*map(F.lit, required)), has)) == 0)
    if excluded:
        keep = keep & ~F.arrays_overlap(has, F.array(*map(F.lit, excluded)))
    return results.where(keep)


def duplicate_filter(results: DataFrame, by: str = "external_id", text: str = "text", query: str | None = "query_id", order: str = "rank") -> DataFrame:
    """Keep the first row in ``order`` of every external id, text beginning or both; null ids are one id.

    ``order`` is unique within a query (in the table where ``query`` is None).
    The first place of every key comes from an aggregate that is combined
    before its shuffle, and rows are then met by place, not by key, so a key
    that a third of the rows share is no single task's work.
    """
    digest = F.sha2(F.col(text), 256)
    keys = {"external_id": [F.col("external_id")], "content": [F.substring(text, 1, 200)], "both": [F.col("external_id"), digest]}[by]
    groups = [query] if query else []
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    # 128 bits, so that no two keys meet by chance
    keyed = results.select(*groups, F.col(order), F.xxhash64(key).alias("__key"), F.xxhash64(F.lit("more"), key).alias("__more"))
    first = keyed.groupBy(*groups, "__key", "__more").agg(F.min(order).alias(order)).select(*groups, order)
    return results.join(first, [*groups, order], "left_semi")


# What marks code in an answer.
CODE_MARKERS = ("```", "<code>", "def ", "function", "class ")


def answer_quality(text: Column, has_context: Column, n_tags: Column) -> Column:
    """high, medium or low by length, code, question context and tags."""
    lowered = F.lower(text)
    code = F.lit(False)
    for marker in CODE_MARKERS:
        code = code | lowered.contains(marker)
    points = sum(c.cast("int") for c in (F.length(text) > 200, code, has_context, n_tags >= 2))
    return F.when(points >= 3, "high").when(points >= 2, "medium").otherwise("low")


def enhance_answers(results: DataFrame, text: str = "text", title: str = "question_title", tags: str = "tags", has_context: str = "has_question_context", method: str = "retrieval_method") -> DataFrame:
    """Title, tags and context of the question, the answer's quality and ``+enhanced`` to the method; missing columns count as empty."""
    columns = results.columns
    tagged = F.coalesce(F.col(tags), F.array().cast("array<string>")) if tags in columns else F.array().cast("array<string>")
    context = F.coalesce(F.col(has_context), F.lit(False)) if has_context in columns else F.lit(False)
    named = F.coalesce(F.col(title), F.lit("N/A")) if title in columns else F.lit("N/A")
    return results.withColumns(
        {
            "question_title": named,
            "programming_tags": tagged,
            "has_question_context": context,
            "answer_quality": answer_quality(F.coalesce(text, F.lit("")), context, F.size(tagged)),
            "enhanced": F.lit(True),
            "retrieval_method": F.concat(F.col(method) if method in columns else F.lit(""), F.lit("+enhanced")),
        }
    )


def stamped(results: DataFrame, name: str = "processed_at") -> DataFrame:
    """The time of the query as an ISO 8601 text in UTC; the same in all rows, another in every run."""
    return results.withColumn(name, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def enrich_context(results: DataFrame, query_text: Column, post_type: Column, source: Column) -> DataFrame:
    """Position, query, kind and platform of each result (no time stamp, which would differ by run)."""
    return results.withColumns(
        {
            "rank_position": F.col("rank"),
            "query_used": query_text,
            "result_type": F.when(post_type == "answer", "answer").otherwise("unknown"),
            "source_platform": F.when(source.contains("stackoverflow"), "stackoverflow").otherwise("unknown"),
        }
    )


def assemble_context(results: DataFrame, text: str = "text", query: str = "query_id") -> DataFrame:
    """One text per query: its results in rank order, joined by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    return results.groupBy(query).agg(F.array_join(F.transform(ordered, lambda r: r["t"]), "\n\n").alias("context"))
