"""Fusion of rankings and rerankers that need no model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators.ranking import min_max, top_k
from millrace.operators.search import bm25_weight


def rrf_score(alpha: Column | float, k: Column | float, dense_rank: Column, sparse_rank: Column) -> Column:
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    k = k if isinstance(k, Column) else F.lit(k)
    return F.coalesce(alpha / (k + dense_rank), F.lit(0.0)) + F.coalesce((1 - alpha) / (k + sparse_rank), F.lit(0.0))


def paired(dense: DataFrame, sparse: DataFrame, id_col: str) -> DataFrame:
    """Full outer join of two rankings; rows without id are left out, of a repeated id the last rank counts."""

    def last(ranking: DataFrame, side: str) -> DataFrame:
        rows = ranking.where(F.col(id_col).isNotNull()).groupBy("query_id", id_col)
        return rows.agg(F.max("rank").alias(f"{side}_rank"), F.max_by("score", "rank").alias(f"{side}_score"))

    return last(dense, "dense").join(last(sparse, "sparse"), ["query_id", id_col], "full_outer")


def rrf(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5, k: int = 60, top: int = 10, id_col: str = "vec_id") -> DataFrame:
    """Weighted reciprocal rank fusion: score down, better rank up, id down.

    Weights of 0.99 and more (0.01 and less) take one ranking as it is.
    """
    if alpha >= 0.99 or alpha <= 0.01:
        only = dense if alpha >= 0.99 else sparse
        return only.where(F.col("rank") <= top).select("query_id", id_col, F.col("score"), F.col("rank").alias("min_rank"), "rank")
    both = paired(dense, sparse, id_col)
    score = F.round(rrf_score(alpha, k, F.col("dense_rank"), F.col("sparse_rank")), 9)
    both = both.select("query_id", id_col, score.alias("score"), F.least("dense_rank", "sparse_rank").alias("min_rank"))
    return top_k(both, top, [F.desc("score"), F.asc("min_rank"), F.desc(id_col)])


def weighted_sum(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5, top: int = 10, id_col: str = "vec_id") -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse over normalised scores, a missing side is 0; ties by id down."""
    sides = [min_max(r, "reciprocal_rank", to="score") for r in (dense, sparse)]
    both = paired(*sides, id_col)
    score = F.round(alpha * F.coalesce("dense_score", F.lit(0.0)) + (1 - alpha) * F.coalesce("sparse_score", F.lit(0.0)), 6)
    return top_k(both.select("query_id", id_col, score.alias("score")), top, [F.desc("score"), F.desc(id_col)])


def merge_strategies(rankings: Sequence[tuple[str, DataFrame]], weights: Mapping[str, float], top: int = 10, id_col: str = "vec_id") -> DataFrame:
    """A document's scores are averaged strategy by strategy, weighted by this and the last strategy."""
    tagged = [r.select("query_id", F.col(id_col), F.lit(i).alias("at"), "rank", "score", F.lit(float(weights.get(name, 1.0))).alias("w")) for i, (name, r) in enumerate(rankings)]
    rows = reduce(DataFrame.unionByName, tagged)
    ordered = F.array_sort(F.collect_list(F.struct("at", "rank", "score", "w")))

    def step(acc: Column, x: Column) -> Column:
        mean = (acc["score"] * acc["w"] + x["score"] * x["w"]) / (acc["w"] + x["w"])
        return F.struct(F.when(acc["w"].isNull(), x["score"]).otherwise(mean).alias("score"), x["w"].alias("w"))

    start = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("w"))
    merged = rows.groupBy("query_id", id_col).agg(F.min(F.struct("at", "rank")).alias("first"), F.round(F.aggregate(ordered, start, step)["score"], 6).alias("score"))
    return top_k(merged, top, [F.desc("score"), F.asc("first"), F.asc(id_col)]).drop("first")


def ensemble(results: DataFrame, scores: Sequence[tuple[DataFrame, float]], top: int = 10, id_col: str = "vec_id") -> DataFrame:
    """Weighted sum of several rerankers' normalised scores; a result without a score has 0."""
    total = F.lit(0.0)
    for i, (frame, weight) in enumerate(scores):
        named = frame.select("query_id", id_col, F.col("score").alias(f"s{i}"))
        results = results.join(named, ["query_id", id_col], "left").withColumn(f"s{i}", F.coalesce(f"s{i}", F.lit(0.0)))
        results = min_max(results, "keep", score=f"s{i}", to=f"s{i}")
        total = total + weight * F.col(f"s{i}")
    scored = results.withColumn("original_rank", F.col("rank")).withColumn("score", F.round(total, 6))
    return top_k(scored.drop("rank"), top, [F.desc("score"), F.asc("original_rank")])


def rerank(results: DataFrame, scores: DataFrame, top: int | None = None, id_col: str = "vec_id") -> DataFrame:
    """Order by another score, ties in the order they had; keeps original_score and original_rank."""
    joined = results.withColumnsRenamed({"score": "original_score", "rank": "original_rank"}).join(scores.select("query_id", id_col, "score"), ["query_id", id_col], "left")
    joined = joined.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return top_k(joined, top, [F.desc("score"), F.asc("original_rank")])


def multi_stage(results: DataFrame, stage1: DataFrame, stage2: DataFrame, stage1_k: int = 20, stage2_k: int | None = None, id_col: str = "vec_id") -> DataFrame:
    """Two rerankers in a row, the second over what the first kept."""
    kept = rerank(results, stage1, stage1_k, id_col).drop("original_score", "original_rank")
    return rerank(kept, stage2, stage2_k, id_col)


def bm25_rerank(results: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, top: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """BM25 within each query's candidates: frequencies and lengths are theirs alone.

    ``results`` has query_id, id, text, score and rank; ``queries`` has query_id and text.
    """
    cand = results.select("query_id", id_col, tokens(F.col("text")).alias("t")).withColumn("length", F.size("t"))
    w = Window.partitionBy("query_id")
    sized = cand.select("query_id", id_col, "length", "t", F.count(F.lit(1)).over(w).alias("n"), F.avg("length").over(w).alias("mean_length"))
    tf = sized.select("query_id", id_col, "length", "n", "mean_length", F.explode("t").alias("term")).groupBy("query_id", id_col, "length", "n", "mean_length", "term").agg(F.count(F.lit(1)).alias("tf"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("wq"))
    matched = tf.join(asked, ["query_id", "term"])
    matched = matched.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query_id", "term")))
    weight = bm25_weight(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("mean_length"), k1, b)
    scores = matched.groupBy("query_id", id_col).agg(F.round(F.sum(F.col("wq") * weight), 6).alias("score"))
    return rerank(results, scores, top, id_col)
