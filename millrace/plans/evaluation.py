"""Metrics, statistics, stratification, grid search and judged answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import evaluation as ev
from millrace.operators import experiments as ex
from millrace.operators import fusion
from millrace.plans.retrieval import VECTORS, dense, read, rrf_sql, second, vector_queries
from millrace.session import written
from millrace.streaming.ingest import windowed_latency


def truth_of(spark: SparkSession, sf_dir: str, *rankings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A vector is relevant to a query of the same label, but not to itself: (qrels of what was retrieved, totals)."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    ranked = reduce(DataFrame.unionByName, [r.select("query_id", "vec_id") for r in rankings])
    return ev.class_truth(ranked, asked, rows)


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of three methods; the two rankings are searched for and written once."""
    d, s = written(dense(spark, sf_dir, 20), "dense"), written(second(spark, sf_dir, 20), "second")
    qrels, totals = truth_of(spark, sf_dir, d, s)
    runs = {"dense": d.where("rank <= 10"), "second": s.where("rank <= 10"), "hybrid": fusion.rrf(d, s)}
    asked = vector_queries(spark, sf_dir)
    frames = [ev.retrieval_metrics(r, qrels, asked, totals=totals).withColumn("method", F.lit(name)) for name, r in runs.items()]
    return written(reduce(DataFrame.unionByName, frames), "metrics")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense(spark, sf_dir)
    qrels, totals = truth_of(spark, sf_dir, found)
    return ev.retrieval_metrics(found, qrels, vector_queries(spark, sf_dir), totals=totals)


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense(spark, sf_dir)
    qrels, totals = truth_of(spark, sf_dir, found)
    return ev.eval_metrics(found, qrels, vector_queries(spark, sf_dir), totals=totals)


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.summary(retrieval_metrics(spark, sf_dir))


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary export: a row per method, a column per headline metric."""
    rows = _methods(spark, sf_dir).where("k IN (0, 5)").withColumn("name", F.concat_ws("_", "metric", F.col("k").cast("string")))
    names = ["map_0", "mrr_0", "ndcg_5", "precision_5", "recall_5"]
    wide = rows.groupBy("method").pivot("name", names).agg(F.avg("value"))
    return wide.select("method", *(F.round(n, 6).alias(n) for n in names))


def metric_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-query export: ids joined by a bar, values with four digits; mrr once."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda r: r["vec_id"].cast("string")), "|")
    ranked = dense(spark, sf_dir).groupBy("query_id").agg(ids.alias("retrieved"))
    wide = retrieval_metrics(spark, sf_dir).where("metric = 'mrr' OR metric = 'precision' AND k = 5").groupBy("query_id").pivot("metric", ["mrr", "precision"]).agg(F.first("value"))
    return ranked.join(wide, "query_id").select("query_id", "retrieved", F.format_string("%.4f", "mrr").alias("mrr"), F.format_string("%.4f", "precision").alias("p5"))


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latency_stats(read(spark, sf_dir, "events"), "event_type", "value")


def latency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_latency(read(spark, sf_dir, "events"), window="1 day")


def generation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn against the turn before it, if that is a user's."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    rows = turns.withColumns({"said": F.lag("text").over(before), "by": F.lag("role").over(before)}).where("role = 'assistant' AND by = 'user'")
    return rows.select("conv_id", "turn", *(c.alias(n) for n, c in ev.overlap(F.col("said"), F.col("text")).items()))


def winloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _methods(spark, sf_dir).where("method <> 'hybrid'").groupBy("query_id", "metric", "k").pivot("method", ["dense", "second"]).agg(F.first("value"))
    return ev.win_loss(wide, ["metric", "k"], "dense", "second")


def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.paired_tests(_methods(spark, sf_dir).where("metric IN ('precision', 'recall') AND k = 5 OR metric IN ('mrr', 'map')"))


def paired_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.with_p_values(paired_tests(spark, sf_dir))


def confidence_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confidence_intervals(retrieval_metrics(spark, sf_dir))


def t_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.t_intervals(retrieval_metrics(spark, sf_dir))


def score_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("x"), F.col("quality").cast("double").alias("y"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r"), F.round(F.regr_slope("y", "x"), 9).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    n = F.size(F.regexp_extract_all("text", F.lit(r"\n"), 0))
    return ex.stratified_split(ex.strata(docs, F.col("lang"), F.col("source"), ex.count_bin(n)), "doc_id")


def stratify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_rows(spark, sf_dir).select("doc_id", "stratum", "split")


def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_rows(spark, sf_dir).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))


ALPHAS, RRF_KS = ev.parse_grid("0.0:1.0:0.2"), [20, 40, 60, 80, 100]


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = written(dense(spark, sf_dir, 20), "dense"), written(second(spark, sf_dir, 20), "second")
    qrels, totals = truth_of(spark, sf_dir, d, s)
    scores = ex.grid_scores(d, s, qrels, ALPHAS, RRF_KS, latency=750.0, totals=totals)
    return ex.grid_winner(scores)


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("value IS NOT NULL")
    share = F.col("value") / F.ceil(F.greatest(F.col("value"), F.lit(1.0)) / 100) / 100
    return rows.select("event_type", ev.score_band(share).alias("band")).groupBy("event_type", "band").agg(F.count(F.lit(1)).alias("count"))


_QRELS = "qr AS (SELECT q.vec_id AS query_id, e.vec_id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id), nrel AS (SELECT query_id, count(*) AS m FROM qr GROUP BY 1)"


def _metrics_sql(source: str, name: str) -> str:
    """Long metrics of a ranking: one row of sums per query, then a union of the metrics."""
    parts = []
    for k in ev.KS:
        p, r = f"(h{k} / least({k}, n))", f"(h{k} / m)"
        ideal = f"list_sum([1 / log2(i + 1) for i in range(1, least({k}, m) + 1)])"
        for metric, value in (("precision", p), ("recall", r), ("f1", f"CASE WHEN h{k} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"), ("ndcg", f"g{k} / {ideal}"), ("success", f"(h{k} > 0)::int")):
            parts.append(f"SELECT query_id, '{metric}' AS metric, {k} AS k, round(CAST({value} AS double), 6) AS value FROM {name}_sums")
    for metric, value in (("mrr", "coalesce(1 / first, 0)"), ("map", "ap / m"), ("r_precision", "hr / m")):
        parts.append(f"SELECT query_id, '{metric}', 0, round(CAST({value} AS double), 6) FROM {name}_sums")
    sums = ", ".join(f"count(*) FILTER (rel = 1 AND rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) AS g{k}" for k in ev.KS)
    return f"""
{name}_rel AS (SELECT r.query_id, rank, (qr.vec_id IS NOT NULL)::int AS rel, sum((qr.vec_id IS NOT NULL)::int) OVER (PARTITION BY r.query_id ORDER BY rank) AS hits
    FROM {source} r LEFT JOIN qr ON qr.query_id = r.query_id AND qr.vec_id = r.vec_id),
{name}_sums AS (SELECT query_id, any_value(m) AS m, count(*) AS n, {sums}, min(rank) FILTER (rel = 1) AS first, sum(rel * hits / rank) AS ap, count(*) FILTER (rel = 1 AND rank <= m) AS hr
    FROM {name}_rel JOIN nrel USING (query_id) GROUP BY query_id),
{name} AS ({" UNION ALL ".join(parts)})"""


def _eval_sql() -> str:
    discount = "CASE WHEN {0} <= 1 THEN 1 ELSE log2({0}) END"
    parts = []
    for k in ev.KS:
        p, r = f"(h{k} / {k})", f"(h{k} / m)"
        ideal = f"list_sum([1 / {discount.format('i')} for i in range(1, least({k}, m) + 1)])"
        for metric, value in (("precision", p), ("recall", r), ("f1", f"CASE WHEN h{k} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"), ("ndcg", f"g{k} / {ideal}")):
            parts.append(f"SELECT query_id, 'eval_{metric}' AS metric, {k} AS k, round(CAST({value} AS double), 6) AS value FROM es")
    parts.append("SELECT query_id, 'eval_mrr', 0, round(CAST(coalesce(1 / first, 0) AS double), 6) FROM es")
    sums = ", ".join(f"count(*) FILTER (rel AND rank <= {k}) AS h{k}, coalesce(sum(1 / ({discount.format('rank')})) FILTER (rel AND rank <= {k}), 0) AS g{k}" for k in ev.KS)
    return f"""WITH {VECTORS}, {_QRELS}, er AS (SELECT d.query_id, rank, qr.vec_id IS NOT NULL AS rel FROM d10 d LEFT JOIN qr ON qr.query_id = d.query_id AND qr.vec_id = d.vec_id),
    es AS (SELECT query_id, any_value(m) AS m, {sums}, min(rank) FILTER (rel) AS first FROM er JOIN nrel USING (query_id) GROUP BY query_id) {" UNION ALL ".join(parts)}"""


_M = f"WITH {VECTORS}, {_QRELS}, {_metrics_sql('d10', 'md')}"
_ALL = f"""{_M}, {_metrics_sql("s10", "ms")}, {rrf_sql(0.5, 60, 10)}, {_metrics_sql("rrf", "mh")},
ma AS (SELECT 'dense' AS method, * FROM md UNION ALL SELECT 'second', * FROM ms UNION ALL SELECT 'hybrid', * FROM mh)"""

_STRATA = r"""
b AS (SELECT doc_id, lang, source, len(regexp_extract_all(text, '\n')) AS n FROM documents),
top AS (SELECT source FROM b GROUP BY source ORDER BY count(*) DESC, source LIMIT 6),
st AS (SELECT doc_id, lang, lang || '_' || CASE WHEN source IN (SELECT source FROM top) THEN source ELSE 'Other' END || '_' ||
       CASE WHEN n = 0 THEN 'none' WHEN n <= 3 THEN 'low' WHEN n <= 6 THEN 'medium' ELSE 'high' END AS stratum FROM b),
sized AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS size FROM st),
sp AS (SELECT doc_id, lang, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || doc_id), doc_id) <= round(0.2::double * size) THEN 'test' ELSE 'train' END AS split FROM sized WHERE size >= 5)
"""

QUERIES = {
    "retrieval_metrics": (retrieval_metrics, f"{_M} SELECT * FROM md"),
    "eval_metrics": (eval_metrics, _eval_sql()),
    "metric_summary": (
        metric_summary,
        f"""{_M} SELECT metric, k, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median,
        count(value) AS count, count(*) AS total FROM md GROUP BY metric, k""",
    ),
    "metric_pivot": (
        metric_pivot,
        f"""{_ALL} SELECT method, {", ".join(f"round(avg(value) FILTER (metric = '{m}' AND k = {k}), 6) AS {m}_{k}" for m, k in (("map", 0), ("mrr", 0), ("ndcg", 5), ("precision", 5), ("recall", 5)))} FROM ma GROUP BY method""",
    ),
    "metric_export": (
        metric_export,
        f"""{_M} SELECT query_id, (SELECT string_agg(vec_id::varchar, '|' ORDER BY rank) FROM d10 WHERE d10.query_id = md.query_id) AS retrieved,
        printf('%.4f', max(value) FILTER (metric = 'mrr')) AS mrr, printf('%.4f', max(value) FILTER (metric = 'precision' AND k = 5)) AS p5 FROM md GROUP BY query_id""",
    ),
    "latency_stats": (
        latency_stats,
        """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95,
        round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS min, max(value) AS max, round(stddev_samp(value) / avg(value), 6) AS cv FROM events WHERE isfinite(value) GROUP BY event_type""",
    ),
    "latency_windows": (
        latency_windows,
        "SELECT CAST(date_trunc('day', ts) AS timestamp) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY ALL",
    ),
    "generation_overlap": (
        generation_overlap,
        r"""WITH t AS (SELECT *, lag(text) OVER w AS said, lag(role) OVER w AS by_role FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        r AS (SELECT *, list_filter(list_distinct(string_split(lower(said), '')), lambda x: x <> '') AS ca, list_filter(list_distinct(string_split(lower(text), '')), lambda x: x <> '') AS cb,
              list_distinct(regexp_extract_all(lower(said), '\S+')) AS wa, list_distinct(regexp_extract_all(lower(text), '\S+')) AS wb FROM t WHERE role = 'assistant' AND by_role = 'user')
        SELECT conv_id, turn, round(CASE WHEN said <> '' THEN length(text) / length(said) ELSE 0 END, 6) AS length_ratio,
               round(CASE WHEN len(ca) > 0 THEN len(list_intersect(ca, cb)) / len(ca) ELSE 0 END, 6) AS char_overlap,
               round(CASE WHEN len(wa) > 0 THEN len(list_intersect(wa, wb)) / len(wa) ELSE 0 END, 6) AS word_overlap FROM r""",
    ),
    "winloss": (
        winloss,
        f"""{_ALL} SELECT metric, k, count(*) FILTER (a > b) AS wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (a < b) AS losses, round(avg(a - b), 6) AS mean_diff,
        round(CASE WHEN avg(b) <> 0 THEN 100 * avg(a - b) / avg(b) END, 6) AS pct_diff
        FROM (SELECT query_id, metric, k, max(value) FILTER (method = 'dense') AS a, max(value) FILTER (method = 'second') AS b FROM ma GROUP BY ALL) GROUP BY metric, k""",
    ),
    "paired_tests": (
        paired_tests,
        f"""{_ALL}, f AS (SELECT * FROM ma WHERE metric IN ('precision', 'recall') AND k = 5 OR metric IN ('mrr', 'map')),
        p AS (SELECT a.method AS method1, b.method AS method2, a.metric, a.k, a.value AS x, b.value AS y FROM f a JOIN f b ON a.query_id = b.query_id AND a.metric = b.metric AND a.k = b.k AND a.method < b.method),
        g AS (SELECT method1, method2, metric, k, count(*) AS n, avg(y - x) AS mean_diff, CASE WHEN stddev_samp(x - y) > 1e-12 THEN avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))) END AS t,
              CASE WHEN sqrt((var_samp(x) + var_samp(y)) / 2) > 1e-12 THEN (avg(y) - avg(x)) / sqrt((var_samp(x) + var_samp(y)) / 2) ELSE 0 END AS d FROM p GROUP BY ALL)
        SELECT method1, method2, metric, k, n, round(mean_diff, 6) AS mean_diff, round(t, 6) AS t, round(d, 6) AS cohens_d,
               CASE WHEN abs(round(d, 6)) < 0.2 THEN 'negligible' WHEN abs(round(d, 6)) < 0.5 THEN 'small' WHEN abs(round(d, 6)) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude,
               round(0.05::double / count(*) OVER (), 9) AS bonferroni_alpha FROM g""",
    ),
    "paired_p_values": (paired_p_values, None),
    "confidence_intervals": (
        confidence_intervals,
        f"""{_M} SELECT metric, k, n, round(m, 6) AS mean, round(s, 6) AS std, round(m - h, 6) AS ci_low, round(m + h, 6) AS ci_high FROM (
        SELECT metric, k, count(value) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s, coalesce(1.96 * stddev_samp(value) / sqrt(count(value)), 0) AS h FROM md GROUP BY metric, k)""",
    ),
    "t_intervals": (t_intervals, None),
    "score_correlation": (
        score_correlation,
        "SELECT count(*) AS n, round(corr(n_chars, quality), 6) AS r, round(regr_slope(quality, n_chars), 9) AS slope, round(regr_intercept(quality, n_chars), 6) AS intercept FROM documents JOIN labels USING (doc_id)",
    ),
    "stratify": (stratify, f"WITH {_STRATA} SELECT doc_id, stratum, split FROM sp"),
    "split_stats": (split_stats, f"WITH {_STRATA} SELECT split, lang, count(*) AS n FROM sp GROUP BY ALL"),
    "grid_search": (
        grid_search,
        f"""WITH {VECTORS}, {_QRELS}, g AS (SELECT * FROM (SELECT unnest({ALPHAS}::double[]) AS alpha), (SELECT unnest({RRF_KS}) AS rrf_k)),
        pr AS (SELECT query_id, vec_id, d20.rank AS dr, s20.rank AS sr FROM d20 FULL JOIN s20 USING (query_id, vec_id)),
        sc AS (SELECT alpha, rrf_k, pr.query_id, pr.vec_id, round(coalesce(alpha / (rrf_k + dr), 0) + coalesce((1 - alpha) / (rrf_k + sr), 0), 9) AS s, least(dr, sr) AS mr,
               (qr.vec_id IS NOT NULL)::int AS rel FROM g, pr LEFT JOIN qr ON qr.query_id = pr.query_id AND qr.vec_id = pr.vec_id),
        rk AS (SELECT *, row_number() OVER (PARTITION BY alpha, rrf_k, query_id ORDER BY s DESC, mr, vec_id DESC) AS rank FROM sc QUALIFY rank <= 10),
        pq AS (SELECT alpha, rrf_k, query_id, max(CASE WHEN rank <= 3 THEN rel ELSE 0 END)::double AS s3, sum(CASE WHEN rank <= 3 THEN rel ELSE 0 END) / least(3, count(*)) AS p3,
               sum(rel) / any_value(m) AS r, sum(rel) / count(*) AS p FROM rk JOIN nrel USING (query_id) GROUP BY ALL),
        ob AS (SELECT alpha, rrf_k, round(0.35 * avg(s3) + 0.30 * avg(p3) + 0.20 * avg(r) + 0.15 * avg(p) - 0.025, 6) AS score FROM pq GROUP BY ALL)
        SELECT alpha, rrf_k, score, row_number() OVER (ORDER BY score DESC, abs(alpha - 0.5), abs(rrf_k - 60), alpha, rrf_k) = 1 AS is_winner FROM ob""",
    ),
    "score_bands": (
        score_bands,
        """SELECT event_type, CASE WHEN v >= 0.8 THEN 'excellent' WHEN v >= 0.6 THEN 'good' WHEN v >= 0.4 THEN 'fair' WHEN v >= 0.2 THEN 'poor' ELSE 'very poor' END AS band, count(*) AS count
        FROM (SELECT event_type, value / ceil(greatest(value, 1.0) / 100) / 100 AS v FROM events WHERE value IS NOT NULL) GROUP BY ALL""",
    ),
}
