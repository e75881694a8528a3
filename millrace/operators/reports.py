"""Summaries of runs, judged answers and collections; scans of a collection; sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.student import two_sided_p
from millrace.operators.evaluation import exact_percentiles, summary


def scan(collection: DataFrame, where: Mapping[str, Any] | None = None, contains: str | None = None, text_col: str = "text", limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows with the given values and, regardless of case, the given text; ``limit`` rows in ``order`` if asked."""
    for key, value in (where or {}).items():
        collection = collection.where(F.col(key).eqNullSafe(F.lit(value)))
    if contains is not None:
        collection = collection.where(F.contains(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(contains.lower())))
    if limit is not None:
        collection = collection.orderBy(order or collection.columns[0]).limit(limit)
    return collection


def chunks_by_document(chunks: DataFrame, document: str = "external_id", chunk: str = "chunk_id") -> DataFrame:
    """(document, n_chunks): the map from documents to chunks is the table itself; this is its size per document."""
    return chunks.where(F.col(document).isNotNull()).groupBy(document).agg(F.count_distinct(chunk).alias("n_chunks"))


def chunk_ids(chunks: DataFrame, document: str = "external_id", chunk: str = "chunk_id") -> DataFrame:
    """(document, chunk_ids): the map itself, ids in order.

    A document's chunks are few; a table whose documents are large groups is
    better joined than gathered.
    """
    return chunks.where(F.col(document).isNotNull()).groupBy(document).agg(F.array_sort(F.collect_set(chunk)).alias("chunk_ids"))


def embedding_model(config: Mapping[str, Any]) -> str:
    """The model of a config's dense section, else of its sparse one, else its own; ``unknown`` if none says."""
    section = config.get("embedding", {})
    return next((section[kind] for kind in ("dense", "sparse") if kind in section), section).get("model", "unknown")


def keep_split(queries: DataFrame, allowed: DataFrame, key: str = "query_id") -> DataFrame:
    return queries.join(allowed.select(key).distinct(), key, "left_semi")


def document_name(*candidates: Column) -> Column:
    """The first id that is there and not empty, else ``unknown``."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in candidates), F.lit("unknown"))


def ingest_summary(records: DataFrame, counts: Sequence[str] = ("total", "successful", "failed")) -> DataFrame:
    """Sums over runs and the share that succeeded (0 of none)."""
    sums = records.agg(F.count(F.lit(1)).alias("runs"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts))
    total, good = F.col(counts[0]), F.col(counts[1])
    return sums.withColumn("success_rate", F.round(F.when(total > 0, good / total).otherwise(0.0), 6))


def content_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    n = F.length(text_col)
    return docs.agg(F.count(n).alias("n"), F.round(F.avg(n), 6).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


def judge_summary(judged: DataFrame, dimensions: Sequence[str] = ("faithfulness", "relevance", "helpfulness")) -> DataFrame:
    """Means over the answers that were judged (first dimension above 0), and how many were."""
    ok = F.col(dimensions[0]) > 0
    means = [F.round(F.avg(F.when(ok, F.col(d))), 6).alias(f"avg_{d}") for d in dimensions]
    overall = sum(F.avg(F.when(ok, F.col(d))) for d in dimensions) / len(dimensions)
    return judged.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("judged"), *means, F.round(overall, 6).alias("overall"))


def improvements(pairs: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Per question the difference of two scores, absolute and in percent of the second (0 if that is 0)."""
    a, b = F.col(first), F.col(second)
    return pairs.select(key, F.round(a - b, 6).alias("diff"), F.round(F.when(b != 0, 100 * (a - b) / b).otherwise(0.0), 6).alias("pct"))


def paired_effect(pairs: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """Paired t statistic and one-sample effect size (mean over population deviation) of two scores."""
    d = F.col(first) - F.col(second)
    n, mean, sample, population = F.count(d), F.avg(d), F.stddev_samp(d), F.stddev_pop(d)
    return pairs.groupBy(*by).agg(
        n.alias("n"),
        F.round(F.when(sample > 1e-12, mean / (sample / F.sqrt(n))), 6).alias("t"),
        F.round(F.when(population > 1e-12, mean / population).otherwise(0.0), 6).alias("effect"),
    )


def comparison(scores: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """Both scores of every metric and of all together (overall), paired by row.

    Mean, population deviation, median, least and greatest of each; mean and
    median difference, mean difference in percent of the second (0 where that
    isn't above 0), wins, ties, losses; the paired t statistic with its p-value
    and whether it is significant; the effect size (mean over population
    deviation).  Percentiles come from counts by value, p-values from the
    aggregated rows.
    """
    both = scores.select(F.explode(F.array(F.col(metric), F.lit("overall"))).alias("metric"), F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b"))
    both = both.withColumn("d", F.col("a") - F.col("b"))
    d, n = F.col("d"), F.count("d")
    sides = [f(c).alias(f"{c}_{name}") for c in ("a", "b") for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    sample, population = F.stddev_samp(d), F.stddev_pop(d)
    stats = both.groupBy("metric").agg(
        n.alias("n"),
        *sides,
        F.avg(d).alias("mean_diff"),
        F.avg(F.when(F.col("b") > 0, 100 * d / F.col("b")).otherwise(0.0)).alias("mean_pct"),
        F.count_if(d > 0).alias("wins"),
        F.count_if(d == 0).alias("ties"),
        F.count_if(d < 0).alias("losses"),
        F.when(sample > 1e-12, F.avg(d) / (sample / F.sqrt(n))).alias("t"),
        F.when(population > 1e-12, F.avg(d) / population).otherwise(0.0).alias("effect"),
    )
    for c, name in (("a", "a_median"), ("b", "b_median"), ("d", "median_diff")):
        stats = stats.join(exact_percentiles(both, ["metric"], c, [0.5]).withColumnRenamed("p0", name), "metric")
    order = ["n", "a_mean", "a_std", "a_median", "a_min", "a_max", "b_mean", "b_std", "b_median", "b_min", "b_max", "mean_diff", "mean_pct", "median_diff", "wins", "ties", "losses", "t", "effect"]
    rounded = [F.col(c) if c in ("n", "wins", "ties", "losses") else F.round(c, 6).alias(c) for c in order]
    return significance(stats.select("metric", *rounded))


def significance(tests: DataFrame) -> DataFrame:
    """Adds p_value (of t with n - 1 degrees of freedom) and whether it is below .05 and .01; a row per metric."""

    def p(batches):
        for pdf in batches:
            pdf["p_value"] = [two_sided_p(t, n - 1) if n > 1 and t == t and t is not None else float("nan") for t, n in zip(pdf["t"].astype(float), pdf["n"])]
            yield pdf

    done = tests.mapInPandas(p, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tests.schema) + ", p_value double")
    below = lambda level: F.coalesce(F.col("p_value") < level, F.lit(False)) & ~F.isnan("p_value")
    return done.withColumns({"p_value": F.nanvl("p_value", F.lit(None).cast("double")), "significant_05": below(0.05), "significant_01": below(0.01)})


def macro_means(metrics: DataFrame, value: str = "value") -> DataFrame:
    """(metric, k, mean, n): the evaluator's means over queries; queries without the metric are left out."""
    known = F.when(~F.isnan(value), F.col(value))
    return metrics.groupBy("metric", "k").agg(F.round(F.avg(known), 6).alias("mean"), F.count(known).alias("n"))


def by_parameter(scores: DataFrame, parameter: str, score: str = "score") -> DataFrame:
    """Mean, population deviation, least and greatest score of a grid's settings by one of its parameters."""
    return scores.groupBy(parameter).agg(*(F.round(f(score), 6).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))), F.count(F.lit(1)).alias("n"))


def compare_runs(metrics: DataFrame, run: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """A row per metric, a column per run: the mean of the known values."""
    wide = metrics.where(~F.isnan(value)).groupBy("metric", "k").pivot(run, list(names)).agg(F.avg(value))
    return wide.select("metric", "k", *(F.round(n, 6).alias(n) for n in names))


def heatmap(scores: DataFrame, row: str, column: str, values: Sequence[Any], score: str = "score") -> DataFrame:
    """A grid's scores as a matrix: a row per value of one parameter, a column per value of the other."""
    wide = scores.groupBy(row).pivot(column, list(values)).agg(F.first(score))
    return wide.select(row, *(F.col(str(v)).alias(f"{column}_{v}") for v in values))


def write_lineage(spark, path: str, record: Mapping[str, Any]) -> None:
    """Append one run's record, config and environment as a JSON line."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").write.mode("append").text(path)


def write_jsonl(df: DataFrame, path: str, **renamed: str) -> None:
    """One JSON object per row; ``renamed`` gives columns the names they have in the file."""
    chosen = [F.col(c).alias(name) for c, name in renamed.items()] or ["*"]
    df.select(*chosen).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_json(spark, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    """JSON records: one per line, or one array or object per file."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def export_metrics(metrics: DataFrame, path: str, method: str = "method") -> None:
    """Four exports: all rows, the summary and the statistics by metric as CSV with header, all rows as JSON."""
    metrics.write.mode("overwrite").csv(f"{path}/detailed", header=True)
    metrics.write.mode("overwrite").json(f"{path}/json")
    metrics.groupBy(method).pivot("metric").agg(F.round(F.avg("value"), 6)).write.mode("overwrite").csv(f"{path}/summary", header=True)
    summary(metrics, (method, "metric", "k")).write.mode("overwrite").csv(f"{path}/statistics", header=True)


def write_run(spark, path: str, question: str, answer: str, context: str | None = None) -> None:
    """Append one run of the agent (question, answer, context) as a JSON line; :func:`log_counts` reads them."""
    write_lineage(spark, path, {"question": question, "answer": answer, "context": context})


def log_counts(log: DataFrame, retrieved: str = "context") -> DataFrame:
    """How many answers there are, with retrieved context and without, and their mean length."""
    has = F.coalesce(F.length(retrieved) > 0, F.lit(False))
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("retrieved"), F.count_if(~has).alias("direct"), F.round(F.avg(F.length("answer")), 6).alias("avg_answer_chars"))
