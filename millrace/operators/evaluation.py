"""Retrieval metrics, their aggregates and the tests between methods."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import student
from millrace.session import written

KS = (1, 5, 10)


def judge(ranked: DataFrame, qrels: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, rel, hits): documents once per query at their first place, ranks closed up."""
    w = Window.partitionBy("query_id").orderBy("rank", id_col)
    once = ranked.groupBy("query_id", id_col).agg(F.min("rank").alias("rank")).withColumn("rank", F.row_number().over(w))
    rel = once.join(qrels.select("query_id", id_col).distinct().withColumn("rel", F.lit(1)), ["query_id", id_col], "left")
    rel = rel.withColumn("rel", F.coalesce("rel", F.lit(0)))
    return rel.withColumn("hits", F.sum("rel").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _long(wide: DataFrame, columns: Sequence[tuple[str, int, str]]) -> DataFrame:
    stack = ", ".join(f"'{metric}', {k}, {name}" for metric, k, name in columns)
    return wide.selectExpr("query_id", f"stack({len(columns)}, {stack}) as (metric, k, value)").withColumn("value", F.round("value", 6))


def _ideal(n: Column, k: int) -> Column:
    """Discounted gain of n relevant documents on the first of k places."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), n))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def class_truth(ranked: DataFrame, queries: DataFrame, rows: DataFrame, cls: str = "label", id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(qrels of the retrieved rows, relevant rows of each query) where a row is relevant to queries of its own class.

    A query (query_id, class) is itself a row and not relevant to itself.
    Only the classes of what was retrieved are looked up and classes are
    counted; the pairs of all queries and rows of a class are never made.
    """
    asked = queries.select("query_id", F.col(cls).alias("__asked"))
    pairs = ranked.select("query_id", id_col).distinct().join(asked, "query_id").join(rows.select(id_col, cls), id_col)
    qrels = pairs.where((F.col(cls) == F.col("__asked")) & (F.col("query_id") != F.col(id_col))).select("query_id", id_col)
    sizes = rows.groupBy(F.col(cls).alias("__asked")).agg(F.count(F.lit(1)).alias("n"))
    totals = asked.join(sizes, "__asked").where("n > 1").select("query_id", (F.col("n") - 1).cast("int").alias("n_rel"))
    return qrels, totals


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, ks: Sequence[int] = KS, id_col: str = "vec_id", totals: DataFrame | None = None) -> DataFrame:
    """(query_id, metric, k, value): precision over what was returned, recall, f1, ndcg, success, and mrr, map, r_precision (k 0).

    A query without a relevant document has null values; one without results 0.
    With ``totals`` (query_id, n_rel) ``qrels`` may hold the retrieved rows only.
    """
    found = judge(ranked, qrels, id_col)
    truth = totals
    if truth is None:
        truth = qrels.select("query_id", id_col).distinct().groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_rel"))
    found = found.join(truth, "query_id")
    rel, rank = F.col("rel"), F.col("rank")
    sums = [F.count(F.lit(1)).alias("n"), F.max("n_rel").alias("m")]
    sums += [F.sum(F.when(rank <= k, rel).otherwise(0)).alias(f"h{k}") for k in ks]
    sums += [F.sum(F.when(rank <= k, rel / F.log2(rank + 1.0)).otherwise(0.0)).alias(f"g{k}") for k in ks]
    sums += [
        F.min(F.when(rel == 1, rank)).alias("first"),
        F.sum(rel * F.col("hits") / rank).alias("ap"),
        F.sum(F.when(rank <= F.col("n_rel"), rel).otherwise(0)).alias("hr"),
    ]
    per = queries.select("query_id").join(truth.select("query_id", "n_rel"), "query_id", "left").join(found.groupBy("query_id").agg(*sums).drop("m"), "query_id", "left")
    m, n = F.col("n_rel"), F.coalesce("n", F.lit(0))
    known = lambda c: F.when(m.isNotNull(), c)
    values: dict[str, Column] = {}
    columns = []
    for k in ks:
        h = F.coalesce(f"h{k}", F.lit(0))
        p, r = F.when(n > 0, h / F.least(F.lit(k), n)).otherwise(0.0), h / m
        values |= {f"p{k}": known(p), f"r{k}": known(r), f"f{k}": known(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)), f"n{k}": known(F.coalesce(f"g{k}", F.lit(0.0)) / _ideal(m, k)), f"s{k}": known((h > 0).cast("double"))}
        columns += [("precision", k, f"p{k}"), ("recall", k, f"r{k}"), ("f1", k, f"f{k}"), ("ndcg", k, f"n{k}"), ("success", k, f"s{k}")]
    values |= {"mrr": known(F.coalesce(1 / F.col("first"), F.lit(0.0))), "map": known(F.coalesce(F.col("ap"), F.lit(0.0)) / m), "rp": known(F.coalesce("hr", F.lit(0)) / m)}
    columns += [("mrr", 0, "mrr"), ("map", 0, "map"), ("r_precision", 0, "rp")]
    return _long(per.select("query_id", *(c.alias(name) for name, c in values.items())), columns)


def eval_metrics(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, ks: Sequence[int] = KS, id_col: str = "vec_id", totals: DataFrame | None = None) -> DataFrame:
    """The evaluator's variant: precision over k, graded ndcg whose first place isn't discounted and place i has log2(i).

    ``qrels`` may have a grade (1.0 without).  Queries without truth have zeros.
    With ``totals`` (query_id, n_rel) all grades are 1 and ``qrels`` may hold
    the retrieved rows only.
    """
    graded = qrels if "grade" in qrels.columns else qrels.withColumn("grade", F.lit(1.0))
    graded = graded.groupBy("query_id", id_col).agg(F.max("grade").alias("grade"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), id_col)
    discount = lambda r: F.when(r <= 1, 1.0).otherwise(F.log2(r.cast("double")))
    placed = graded.withColumn("place", F.row_number().over(w))
    ideal = [F.sum(F.when(F.col("place") <= k, F.col("grade") / discount(F.col("place"))).otherwise(0.0)).alias(f"i{k}") for k in ks]
    if totals is None:
        truth = placed.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), *ideal)
    else:
        gain = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), "m")), F.lit(0.0), lambda a, i: a + 1 / discount(i))
        truth = totals.select("query_id", F.col("n_rel").alias("m")).select("*", *(gain(k).alias(f"i{k}") for k in ks))
    found = ranked.join(graded, ["query_id", id_col])
    rank = F.col("rank")
    sums = [F.count(F.when(rank <= k, 1)).alias(f"h{k}") for k in ks]
    sums += [F.sum(F.when(rank <= k, F.col("grade") / discount(rank)).otherwise(0.0)).alias(f"g{k}") for k in ks]
    per = queries.select("query_id").join(truth, "query_id", "left").join(found.groupBy("query_id").agg(F.min("rank").alias("first"), *sums), "query_id", "left")
    columns, values = [], {"mrr": F.coalesce(1 / F.col("first"), F.lit(0.0))}
    for k in ks:
        h, zero = F.coalesce(f"h{k}", F.lit(0)), F.lit(0.0)
        p, r = h / k, F.when(F.col("m") > 0, h / F.col("m")).otherwise(zero)
        values |= {f"p{k}": p, f"r{k}": r, f"f{k}": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(zero), f"n{k}": F.when(F.col(f"i{k}") > 0, F.coalesce(f"g{k}", zero) / F.col(f"i{k}")).otherwise(zero)}
        columns += [("eval_precision", k, f"p{k}"), ("eval_recall", k, f"r{k}"), ("eval_f1", k, f"f{k}"), ("eval_ndcg", k, f"n{k}")]
    return _long(per.select("query_id", *(c.alias(name) for name, c in values.items())), [*columns, ("eval_mrr", 0, "mrr")])


def summary(metrics: DataFrame, by: Sequence[str] = ("metric", "k"), value: str = "value") -> DataFrame:
    """Mean, population deviation, least, greatest, median and count of the known values, total of all rows.

    The median is exact and comes from counts by value (:func:`exact_percentiles`),
    so that no group's values meet in one task.  The rows are written once when
    this is called.
    """
    v = F.when(~F.isnan(value), F.col(value))
    rows = written(metrics.select(*by, v.alias("__value")), "summary")
    stats = rows.groupBy(*by).agg(
        F.round(F.avg("__value"), 6).alias("mean"),
        F.round(F.stddev_pop("__value"), 6).alias("std"),
        F.min("__value").alias("min"),
        F.max("__value").alias("max"),
        F.count("__value").alias("count"),
        F.count(F.lit(1)).alias("total"),
    )
    names = [f"__by{i}" for i in range(len(by))]
    medians = exact_percentiles(rows, by, "__value", [0.5]).toDF(*names, "median")
    same = [stats[c].eqNullSafe(medians[n]) for c, n in zip(by, names)]
    return stats.join(medians, same, "left").select(*(stats[c] for c in by), "mean", "std", "min", "max", F.round("median", 6).alias("median"), "count", "total")


def exact_percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], buckets: int = 1024) -> DataFrame:
    """(by, p0, p1, ...): linearly interpolated percentiles, exact, without any group in one task.

    Values are counted (combined before the shuffle), the counts go into
    ``buckets`` ranges of each group's own span, and running sums of the few
    bucket totals tell which bucket holds each percentile's two neighbours, so
    that only values of those buckets are ordered.  Rows whose value is null
    are left out.
    """
    keys = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    names = [f"__g{i}" for i in range(len(by))]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    spans = counts.groupBy(*names).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__total"))
    same = lambda other: [F.col(f"c.{n}").eqNullSafe(F.col(f"{other}.{n}")) for n in names]
    place = F.least(F.lit(buckets - 1), F.floor((F.col("__v") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * buckets))
    placed = counts.alias("c").join(spans.alias("s"), same("s")).select(*(F.col(f"c.{n}") for n in names), "__v", "__n", "__total", F.coalesce(place, F.lit(0)).alias("__b"))
    sums = placed.groupBy(*names, "__b", "__total").agg(F.sum("__n").alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(*names).orderBy("__b"))
    # the numbers, from 0, of the rows on either side of each percentile
    at = [s * (F.col("__total") - 1) for s in shares]
    wanted = F.array_distinct(F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil))))
    sums = sums.select("*", (upto - F.col("__m")).alias("__before"), wanted.alias("__wanted"))
    needed = sums.where(F.exists("__wanted", lambda w: (w >= F.col("__before")) & (w < F.col("__before") + F.col("__m")))).drop("__m", "__total")
    inside = placed.alias("c").join(needed.alias("s"), [*same("s"), F.col("c.__b") == F.col("s.__b")]).select(*(F.col(f"c.{n}") for n in names), F.col("c.__b").alias("__b"), "__v", "__n", "__total", "__before")
    before = F.col("__before") + F.sum("__n").over(Window.partitionBy(*names, "__b").orderBy("__v")) - F.col("__n")
    inside = inside.withColumn("__from", before)

    def percentile(x: Column) -> Column:
        low, high = (F.max(F.when((F.col("__from") <= f(x)) & (f(x) < F.col("__from") + F.col("__n")), F.col("__v"))) for f in (F.floor, F.ceil))
        return low + (F.max(x) - F.floor(F.max(x))) * (high - low)

    found = inside.groupBy(*names).agg(*(percentile(x).alias(f"p{i}") for i, x in enumerate(at)))
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, by)), *(f"p{i}" for i in range(len(shares))))


def latency_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, sample deviation, exact percentiles, range and coefficient of variation of the finite values.

    Kinds are few and large, so percentiles come from counts by value, see
    :func:`exact_percentiles`.
    """
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    mean, std = F.avg(v), F.stddev_samp(v)
    quantiles = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    found = exact_percentiles(rows.select(by, v.alias(value)), [by], value, list(quantiles.values()))
    found = found.select(F.col(by).alias("__by"), *(F.round(f"p{i}", 6).alias(name) for i, name in enumerate(quantiles)))
    stats = rows.groupBy(by).agg(
        F.round(mean, 6).alias("mean"),
        F.round(std, 6).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.round(F.when(mean != 0, std / mean).otherwise(float("inf")), 6).alias("cv"),
    )
    # a row per kind on either side
    return stats.join(found, stats[by].eqNullSafe(found["__by"]), "left").select(by, "mean", "std", *quantiles, "min", "max", "cv")


def overlap(reference: Column, generated: Column) -> dict[str, Column]:
    """Length ratio, character and word set overlap of two texts; zeros for an empty reference."""

    def sets(split: Column, other: Column) -> Column:
        a, b = F.array_distinct(F.filter(split, lambda x: x != "")), F.array_distinct(F.filter(other, lambda x: x != ""))
        return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)

    some = F.length(reference) > 0
    characters = sets(F.split(F.lower(reference), ""), F.split(F.lower(generated), ""))
    words = sets(F.split(F.lower(reference), r"\s+"), F.split(F.lower(generated), r"\s+"))
    return {
        "length_ratio": F.round(F.when(some, F.length(generated) / F.length(reference)).otherwise(0.0), 6),
        "char_overlap": F.round(F.when(some, characters).otherwise(0.0), 6),
        "word_overlap": F.round(F.when(some, words).otherwise(0.0), 6),
    }


def effect_size(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def paired_tests(methods: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Paired t-test of every pair of methods on each metric of (method, query_id, metric, k, value).

    mean_diff is the second less the first, t is of the first less the second;
    a missing value counts as 0; d is Cohen's with pooled deviation; the level
    is Bonferroni's.  The pairs are of methods, joined by query: no cross join
    of rows.
    """
    names = [r["method"] for r in methods.select("method").distinct().orderBy("method").collect()]
    keys = ["query_id", "metric", "k"]
    wide = methods.groupBy(*keys).pivot("method", names).agg(F.first("value"))
    found = []
    for a, b in combinations(names, 2):
        x, y = F.coalesce(F.col(f"`{a}`"), F.lit(0.0)), F.coalesce(F.col(f"`{b}`"), F.lit(0.0))
        pairs = wide.where(F.col(f"`{a}`").isNotNull() | F.col(f"`{b}`").isNotNull()).select("metric", "k", x.alias("x"), y.alias("y"))
        n, spread = F.count(F.lit(1)), F.stddev_samp(F.col("x") - F.col("y"))
        pooled = F.sqrt((F.var_samp("x") + F.var_samp("y")) / 2)
        found.append(
            pairs.groupBy("metric", "k").agg(
                F.lit(a).alias("method1"),
                F.lit(b).alias("method2"),
                n.alias("n"),
                F.avg(F.col("y") - F.col("x")).alias("mean_diff"),
                F.when(spread > 1e-12, F.avg(F.col("x") - F.col("y")) / (spread / F.sqrt(n))).alias("t"),
                F.when(pooled > 1e-12, (F.avg("y") - F.avg("x")) / pooled).otherwise(0.0).alias("cohens_d"),
            )
        )
    rows = found[0]
    for r in found[1:]:
        rows = rows.unionByName(r)
    level = alpha / F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return rows.select("method1", "method2", "metric", "k", "n", *(F.round(c, 6).alias(c) for c in ("mean_diff", "t", "cohens_d")), effect_size(F.round("cohens_d", 6)).alias("magnitude"), F.round(level, 9).alias("bonferroni_alpha"))


def with_p_values(tests: DataFrame) -> DataFrame:
    """Adds p_value and significant; the table has a row per pair of methods and metric, so it is small."""

    def p(batches):
        for pdf in batches:
            pdf["p_value"] = [student.two_sided_p(float("nan") if t is None else t, n - 1) if n > 1 else math.nan for t, n in zip(pdf["t"], pdf["n"])]
            yield pdf

    done = tests.mapInPandas(p, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tests.schema) + ", p_value double")
    return done.withColumn("significant", F.col("p_value") < F.col("bonferroni_alpha"))


def confidence_intervals(metrics: DataFrame, by: Sequence[str] = ("metric", "k"), value: str = "value", confidence: float = 0.95) -> DataFrame:
    """Mean, sample deviation and normal interval; one value is its own interval, none gives zeros."""
    v = F.when(~F.isnan(value), F.col(value))
    agg = metrics.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    z = 1.96 if confidence == 0.95 else -student.quantile((1 - confidence) / 2, 1e9)
    half = F.when(F.col("n") > 1, z * F.col("s") / F.sqrt("n")).otherwise(0.0)
    mean = F.coalesce("m", F.lit(0.0))
    return agg.select(*by, "n", F.round(mean, 6).alias("mean"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("std"), F.round(mean - half, 6).alias("ci_low"), F.round(mean + half, 6).alias("ci_high"))


def t_intervals(metrics: DataFrame, by: Sequence[str] = ("metric", "k"), value: str = "value", confidence: float = 0.95) -> DataFrame:
    """The same with Student's t, computed on the aggregated rows."""
    intervals = confidence_intervals(metrics, by, value, confidence)

    def widen(batches):
        for pdf in batches:
            half = [student.quantile((1 + confidence) / 2, n - 1) * s / math.sqrt(n) if n > 1 else 0.0 for n, s in zip(pdf["n"], pdf["std"])]
            pdf["ci_low"], pdf["ci_high"] = pdf["mean"] - half, pdf["mean"] + half
            yield pdf

    return intervals.mapInPandas(widen, intervals.schema)


def win_loss(pairs: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """Wins, ties and losses of the first score against the second, and how far apart they are."""
    a, b = F.col(first), F.col(second)
    diff = F.avg(a - b)
    return pairs.groupBy(*by).agg(
        F.sum((a > b).cast("long")).alias("wins"),
        F.sum((a == b).cast("long")).alias("ties"),
        F.sum((a < b).cast("long")).alias("losses"),
        F.round(diff, 6).alias("mean_diff"),
        F.round(F.when(F.avg(b) != 0, 100 * diff / F.avg(b)), 6).alias("pct_diff"),
    )


# Lower limits of the bands of a score.
BANDS = (("excellent", 0.8), ("good", 0.6), ("fair", 0.4), ("poor", 0.2), ("very poor", float("-inf")))


def score_band(score: Column) -> Column:
    """The band of a score; null and NaN are very poor."""
    band = F.lit(BANDS[-1][0])
    for name, limit in reversed(BANDS[:-1]):
        band = F.when((score >= limit) & ~F.isnan(score), name).otherwise(band)
    return band


def grid_objective(success3: Column, p3: Column, recall: Column, precision: Column, latency_ms: Column) -> Column:
    """Weighted quality less the penalty of latency beyond 500 ms, at most 0.1."""
    penalty = F.least(F.greatest(latency_ms - 500, F.lit(0.0)), F.lit(1000.0)) / 1000
    return 0.35 * success3 + 0.30 * p3 + 0.20 * recall + 0.15 * precision - 0.1 * penalty


def parse_grid(spec: str) -> list[float]:
    """``a:b:step`` (b included) or a comma-separated list."""
    if ":" not in spec:
        return [float(x) for x in spec.split(",") if x.strip()]
    lo, hi, step = map(float, spec.split(":"))
    return [round(lo + i * step, 10) for i in range(int(math.floor((hi - lo) / step + 1e-9)) + 1)]
