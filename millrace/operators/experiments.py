"""Stratified splits and the two-parameter grid search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.evaluation import grid_objective, retrieval_metrics, summary
from millrace.operators.fusion import paired, rrf_score
from millrace.operators.fusion import rrf as fusion_rrf


def tag_features(tags: Column, separator: str = ";") -> tuple[Column, Column]:
    """(tags, primary tag or Other) of a separated string."""
    split = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), separator), lambda x: F.trim(x)), lambda t: t != "")
    return split, F.coalesce(F.try_element_at(split, F.lit(1)), F.lit("Other"))


def count_bin(n: Column) -> Column:
    return F.when(n == 0, "none").when(n <= 3, "low").when(n <= 6, "medium").otherwise("high")


def strata(rows: DataFrame, kind: Column, category: Column, bin_: Column, most: int = 6, least: int = 5) -> DataFrame:
    """Adds ``stratum``: kind, category (the ``most`` frequent, else Other) and bin; small strata are dropped.

    Category counts and stratum counts are aggregated before they are joined
    back, so a frequent category is split over tasks.
    """
    rows = rows.withColumns({"__kind": kind, "__cat": category, "__bin": bin_})
    counts = rows.groupBy("__cat").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "__cat").limit(most).select("__cat", F.lit(True).alias("__top"))
    rows = rows.join(F.broadcast(top), "__cat", "left")  # at most ``most`` rows
    name = F.concat_ws("_", "__kind", F.when(F.col("__top"), F.col("__cat")).otherwise("Other"), "__bin")
    rows = rows.withColumn("stratum", name).drop("__kind", "__cat", "__bin", "__top")
    large = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("stratum_size")).where(F.col("stratum_size") >= least)
    # kinds times most + 1 categories times four bins: a table of strata, not of rows
    return rows.join(F.broadcast(large), "stratum")


def stratified_split(rows: DataFrame, id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: of each stratum round(test_share * size) rows of least seeded hash are test.

    A row's place is the count of the stratum's rows in lower hash buckets plus
    its place in its own bucket (one of 4,096), so no task ranks a whole
    stratum.
    """
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    rows = rows.withColumn("__hash", seeded).withColumn("__bucket", F.substring("__hash", 1, 3))
    counts = rows.groupBy("stratum", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("stratum").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("stratum", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("stratum", "__bucket").orderBy("__hash", id_col))
    placed = rows.join(counts, ["stratum", "__bucket"]).withColumn("__place", F.col("__before") + within)
    split = F.when(F.col("__place") <= F.round(test_share * F.col("stratum_size")), "test").otherwise("train")
    return placed.withColumn("split", split).drop("__hash", "__bucket", "__before", "__place")


def grid_scores(
    dense: DataFrame, sparse: DataFrame, qrels: DataFrame, alphas: Sequence[float], ks: Sequence[int], latency: Column | float = 0.0, id_col: str = "vec_id", depth: int = 10, totals: DataFrame | None = None
) -> DataFrame:
    """(alpha, rrf_k, score): the mean objective of every setting.

    Candidates are retrieved and judged once; each candidate row meets each
    setting of the grid (a fixed, small number), and one window ranks them.
    With ``totals`` (query_id, n_rel) ``qrels`` may hold the retrieved rows only.
    """
    spark = dense.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(a), int(k)) for a in alphas for k in ks], "alpha double, rrf_k int"))
    truth = qrels.select("query_id", id_col).distinct()
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")) if totals is None else totals.select("query_id", F.col("n_rel").alias("m"))
    pairs = paired(dense, sparse, id_col).join(truth.withColumn("rel", F.lit(1)), ["query_id", id_col], "left").join(sizes, "query_id", "left")
    scored = pairs.crossJoin(grid).withColumn("s", F.round(rrf_score(F.col("alpha"), F.col("rrf_k"), F.col("dense_rank"), F.col("sparse_rank")), 9))
    order = Window.partitionBy("alpha", "rrf_k", "query_id").orderBy(F.desc("s"), F.least("dense_rank", "sparse_rank"), F.desc(id_col))
    placed = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
    rel = F.coalesce("rel", F.lit(0))
    per = placed.groupBy("alpha", "rrf_k", "query_id").agg(
        F.max(F.when(F.col("rank") <= 3, rel).otherwise(0)).cast("double").alias("success3"),
        (F.sum(F.when(F.col("rank") <= 3, rel).otherwise(0)) / F.least(F.lit(3), F.count(F.lit(1)))).alias("p3"),
        (F.sum(rel) / F.max("m")).alias("recall"),
        (F.sum(rel) / F.count(F.lit(1))).alias("precision"),
    )
    means = per.groupBy("alpha", "rrf_k").agg(*(F.avg(c).alias(c) for c in ("success3", "p3", "recall", "precision")))
    lag = latency if isinstance(latency, Column) else F.lit(float(latency))
    return means.select("alpha", "rrf_k", F.round(grid_objective(F.col("success3"), F.col("p3"), F.col("recall"), F.col("precision"), lag), 6).alias("score"))


def grid_winner(scores: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Adds is_winner: the best score, then alpha nearest 0.5, k nearest 60, the smaller of each.

    With ``epsilon`` every setting within that share of the best competes on
    the other terms alone.  The table has a row per setting.
    """
    everything = Window.partitionBy(F.lit(1))
    best = F.max("score").over(everything)
    close = F.col("score") >= best - epsilon * F.abs(best)
    score = F.when(close, best).otherwise(F.col("score")) if epsilon else F.col("score")
    marked = scores.withColumn("__s", score)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("__s"), F.abs(F.col("alpha") - 0.5), F.abs(F.col("rrf_k") - 60), "alpha", "rrf_k")
    return marked.withColumn("is_winner", F.row_number().over(order) == 1).drop("__s")


def final_evaluation(
    dense: DataFrame, sparse: DataFrame, qrels: DataFrame, alphas: Sequence[float], ks: Sequence[int], train: Column, id_col: str = "vec_id", depth: int = 10, totals: DataFrame | None = None, **options: float
) -> DataFrame:
    """The winner of the grid on the queries of ``train``, evaluated on all others: alpha, rrf_k, metric, k, mean, std, min, max, median, count, total.

    ``train`` is a condition on query_id.  The grid is a table of settings, so
    its winner is collected (one row) to fuse the test queries with.
    """
    sides = [r.where(train) for r in (dense, sparse)]
    scores = grid_scores(*sides, qrels.where(train), alphas, ks, id_col=id_col, depth=depth, totals=totals)
    best = grid_winner(scores, **options).where("is_winner").first()
    if best is None:
        raise ValueError("no query to choose a setting by")
    held = [r.where(~train) for r in (dense, sparse)]
    asked = held[0].select("query_id").union(held[1].select("query_id")).distinct()
    found = fusion_rrf(*held, best["alpha"], best["rrf_k"], depth, id_col)
    metrics = retrieval_metrics(found, qrels.where(~train), asked, id_col=id_col, totals=totals)
    return summary(metrics).select(F.lit(best["alpha"]).alias("alpha"), F.lit(best["rrf_k"]).alias("rrf_k"), "*")
