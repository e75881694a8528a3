"""Model rerankers with deterministic scorers, scans, set operations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vectors import dot
from millrace.operators import models, ranking, reports
from millrace.operators.agent import query_type
from millrace.plans.evaluation import _ALL, RRF_KS, _methods, grid_search
from millrace.plans.evaluation import QUERIES as EVALUATED
from millrace.plans.retrieval import TOKENS, VECTORS, bm25_topk, dense, read, second, text_queries, vector_queries
from millrace.sources import qa


def semantic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second ranking's candidates in the order of the cosine."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("dv"))
    rows = second(spark, sf_dir).join(vector_queries(spark, sf_dir).withColumnRenamed("embedding", "qv"), "query_id").join(vectors, "vec_id")
    return models.semantic_rerank(rows, F.col("qv"), F.col("dv")).select("query_id", "vec_id", "score", "original_score", "rank")


def maxsim_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction with each vector taken as four token vectors of 16 dimensions."""
    cut = lambda c: F.array(*(F.slice(c, 16 * i + 1, 16) for i in range(4)))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), cut(F.col("embedding")).alias("d"))
    rows = dense(spark, sf_dir).join(vector_queries(spark, sf_dir).select("query_id", cut(F.col("embedding")).alias("q")), "query_id").join(vectors, "vec_id")
    scored = rows.select("query_id", "vec_id", F.round(models.max_sim(F.col("q"), F.col("d")), 6).alias("score"))
    return ranking.top_k(scored, None, [F.desc("score"), F.asc("vec_id")])


def _shared_words(queries: list[str], texts: list[str]) -> list[float]:
    """A deterministic scorer: how many of the query's distinct words the text has."""
    return [float(len(set(q.lower().split()) & set(t.lower().split()))) for q, t in zip(queries, texts)]


def cross_encoder_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25_topk(spark, sf_dir).join(text_queries(spark, sf_dir).select("query_id", F.col("text").alias("q")), "query_id").join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return models.pair_rerank(rows, _shared_words, "q", "text", 5).select("query_id", "doc_id", "score", "original_score", "rank")


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


def key_value_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan(read(spark, sf_dir, "documents"), {"lang": "fr", "source": "src3"}).select("doc_id")


def substring_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan(read(spark, sf_dir, "documents"), contains="License").select("doc_id")


def browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 documents by id: a limit that is the feature."""
    return reports.scan(read(spark, sf_dir, "documents"), limit=20, order="doc_id").select("doc_id", "lang")


def answer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "lang").alias("external_id"), F.col("doc_id").alias("chunk_id"))
    return reports.chunks_by_document(docs)


def split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where("quality = 1")
    return reports.keep_split(read(spark, sf_dir, "documents").select("doc_id", "lang"), labels, "doc_id")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the queries and of the documents: in both, in one alone."""
    words = lambda df: df.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("term")).where("term <> ''")
    a, b = words(read(spark, sf_dir, "benchmark")), words(read(spark, sf_dir, "documents"))
    parts = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a)}
    frames = [f.groupBy().agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name)) for name, f in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select(F.col("doc_id"), F.col("quality")), "doc_id", "left")
    return joined.select("doc_id", reports.document_name(F.when(F.col("quality") == 1, F.col("doc_id")), F.when(F.col("lang") != "en", F.col("source"))).alias("name"))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    good = F.length("text") >= 50
    runs = docs.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"))
    return reports.ingest_summary(runs)


def content_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.content_stats(read(spark, sf_dir, "documents"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic judgements of user turns: 0 (failed) to 5 by their length."""
    n = F.length("text")
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return turns.select("conv_id", "turn", "role", (n % 6).alias("faithfulness"), (1 + n % 5).alias("relevance"), (1 + n % 4).alias("helpfulness"))


def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.judge_summary(_judged(spark, sf_dir))


def pairwise_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return reports.improvements(rows, "key", "relevance", "helpfulness")


def paired_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.paired_effect(_judged(spark, sf_dir), ["role"], "relevance", "helpfulness")


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compare_runs(_methods(spark, sf_dir), "method", ["dense", "hybrid", "second"])


def grid_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.heatmap(grid_search(spark, sf_dir), "alpha", "rrf_k", RRF_KS)


def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return reports.log_counts(turns.select(F.col("text").alias("answer"), F.when(F.col("role") == "user", F.col("text")).alias("context")))


def query_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    analysis = F.when(F.col("turn") % 3 == 0, "A Technical question").when(F.col("turn") % 3 == 1, "needs clarification").otherwise("chat")
    return turns.select("conv_id", "turn", query_type(analysis).alias("query_type"))


def _posts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as questions that list the documents 3i and 3i + 1, documents as answers."""
    i = F.col("item_id")
    asked = read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q_"), i.cast("string")).alias("external_id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("body"),
        F.array(F.lit("t")).alias("tags"),
        F.lit(1).alias("question_type"),
        F.array((3 * i).cast("string"), (3 * i + 1).cast("string")).alias("related_posts"),
    )
    given = read(spark, sf_dir, "documents").select(F.concat(F.lit("a_"), F.col("doc_id").cast("string")).alias("external_id"), F.col("text").alias("body"), F.lit(None).cast("string").alias("summary"))
    return asked, given


def answer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.answer_documents(*_posts(spark, sf_dir)).select("external_id", F.md5("text").alias("text_md5"), "question_title", "has_question_context")


def evaluation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, given = _posts(spark, sf_dir)
    return qa.evaluation_queries(asked, given).select("query_id", "kind", "query_text", F.array_join("relevant", ",").alias("relevant"))


_JUDGED = "j AS (SELECT conv_id, turn, role, length(text) % 6 AS f, 1 + length(text) % 5 AS r, 1 + length(text) % 4 AS h FROM conversations WHERE text IS NOT NULL)"

_POSTS = "q AS (SELECT 'q_' || item_id AS qid, item_id, left(text, 60) AS title, text, unnest([3 * item_id, 3 * item_id + 1]) AS n FROM benchmark)"

QUERIES = {
    "answer_documents": (
        answer_documents,
        f"""WITH {_POSTS}, l AS (SELECT n, arg_min(title, qid) AS title, min(qid) AS qid FROM q GROUP BY n), s AS (SELECT DISTINCT item_id, title FROM q)
        SELECT 'a_' || doc_id AS external_id, md5(text) AS text_md5, coalesce(l.title, s.title) AS question_title, coalesce(l.title, s.title) IS NOT NULL AS has_question_context
        FROM documents LEFT JOIN l ON l.n = doc_id LEFT JOIN s ON s.item_id = doc_id WHERE trim(text) <> ''""",
    ),
    "evaluation_queries": (
        evaluation_queries,
        rf"""WITH {_POSTS}, k AS (SELECT qid, title, any_value(text) AS body, string_agg('a_' || n, ',' ORDER BY 'a_' || n) AS relevant FROM q WHERE n IN (SELECT doc_id FROM documents) GROUP BY ALL),
        t AS (SELECT qid, relevant, 'title' AS kind, trim(title) AS query_text FROM k
              UNION ALL SELECT qid, relevant, 'short', array_to_string(string_split_regex(trim(title), '\s+')[1:6], ' ') FROM k
              UNION ALL SELECT qid, relevant, 'sentence', trim(split_part(body, '.', 1)) FROM k)
        SELECT qid || ':' || kind AS query_id, kind, query_text, relevant FROM t WHERE length(query_text) > 10""",
    ),
    "semantic_rerank": (
        semantic_rerank,
        f"""WITH {VECTORS} SELECT s.query_id, s.vec_id, c.score, s.score AS original_score,
        CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY c.score DESC, s.rank) AS int) AS rank FROM s10 s JOIN cosines c ON c.query_id = s.query_id AND c.vec_id = s.vec_id""",
    ),
    "maxsim_rerank": (
        maxsim_rerank,
        f"""WITH {VECTORS}, m AS (SELECT d.query_id, d.vec_id, round({" + ".join("greatest(" + ", ".join(f"list_inner_product(q.e[{16 * i + 1}:{16 * i + 16}], c.e[{16 * j + 1}:{16 * j + 16}])" for j in range(4)) + ")" for i in range(4))}, 6) AS score
        FROM d10 d JOIN q ON q.query_id = d.query_id JOIN c ON c.vec_id = d.vec_id)
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank FROM m""",
    ),
    "cross_encoder_rerank": (
        cross_encoder_rerank,
        rf"""WITH {TOKENS}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r0 FROM bm25 QUALIFY r0 <= 10),
        s AS (SELECT query_id, r.doc_id, r.score AS original_score, r0, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '\S+')), list_distinct(regexp_extract_all(lower(d.text), '\S+')))) AS double) AS score
              FROM r JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = r.doc_id)
        SELECT query_id, doc_id, score, original_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS int) AS rank FROM s QUALIFY rank <= 5""",
    ),
    "vector_norms": (vector_norms, "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS double[]), CAST(embedding AS double[]))), 6) AS norm FROM embeddings"),
    "key_value_scan": (key_value_scan, "SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3'"),
    "substring_scan": (substring_scan, "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')"),
    "browse": (browse, "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20"),
    "answer_map": (answer_map, "SELECT source || ':' || lang AS external_id, count(DISTINCT doc_id) AS n_chunks FROM documents GROUP BY 1"),
    "split_filter": (split_filter, "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "set_operations": (
        set_operations,
        r"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM documents)
        SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    ),
    "document_names": (document_names, "SELECT doc_id, CASE WHEN quality = 1 THEN CAST(doc_id AS varchar) WHEN lang <> 'en' THEN source ELSE 'unknown' END AS name FROM documents LEFT JOIN labels USING (doc_id)"),
    "ingest_summary": (
        ingest_summary,
        """SELECT count(DISTINCT source) AS runs, count(*) AS total, count(*) FILTER (length(text) >= 50) AS successful, count(*) FILTER (length(text) < 50) AS failed,
        round(count(*) FILTER (length(text) >= 50) / count(*), 6) AS success_rate FROM documents""",
    ),
    "content_stats": (content_stats, "SELECT count(text) AS n, round(avg(length(text)), 6) AS avg_chars, CAST(min(length(text)) AS int) AS min_chars, CAST(max(length(text)) AS int) AS max_chars FROM documents"),
    "judge_summary": (
        judge_summary,
        f"""WITH {_JUDGED} SELECT count(*) AS total, count(*) FILTER (f > 0) AS judged, round(avg(f) FILTER (f > 0), 6) AS avg_faithfulness, round(avg(r) FILTER (f > 0), 6) AS avg_relevance,
        round(avg(h) FILTER (f > 0), 6) AS avg_helpfulness, round((avg(f) FILTER (f > 0) + avg(r) FILTER (f > 0) + avg(h) FILTER (f > 0)) / 3, 6) AS overall FROM j""",
    ),
    "pairwise_improvement": (
        pairwise_improvement,
        f"WITH {_JUDGED} SELECT conv_id || ':' || turn AS key, CAST(r - h AS int) AS diff, round(CASE WHEN h <> 0 THEN 100 * (r - h) / h ELSE 0 END, 6) AS pct FROM j",
    ),
    "paired_effect": (
        paired_effect,
        f"""WITH {_JUDGED} SELECT role, count(*) AS n, round(CASE WHEN stddev_samp(r - h) > 1e-12 THEN avg(r - h) / (stddev_samp(r - h) / sqrt(count(*))) END, 6) AS t,
        round(CASE WHEN stddev_pop(r - h) > 1e-12 THEN avg(r - h) / stddev_pop(r - h) ELSE 0 END, 6) AS effect FROM j GROUP BY role""",
    ),
    "run_comparison": (
        run_comparison,
        f"{_ALL} SELECT metric, k, {', '.join(f"round(avg(value) FILTER (method = '{m}'), 6) AS {m}" for m in ('dense', 'hybrid', 'second'))} FROM ma GROUP BY metric, k",
    ),
    "grid_heatmap": (
        grid_heatmap,
        f"SELECT alpha, {', '.join(f'max(score) FILTER (rrf_k = {k}) AS rrf_k_{k}' for k in RRF_KS)} FROM ({EVALUATED['grid_search'][1]}) GROUP BY alpha",
    ),
    "log_counts": (
        log_counts,
        """SELECT count(*) AS total, count(*) FILTER (role = 'user' AND length(text) > 0) AS retrieved, count(*) FILTER (NOT coalesce(role = 'user' AND length(text) > 0, false)) AS direct,
        round(avg(length(text)), 6) AS avg_answer_chars FROM conversations WHERE text IS NOT NULL""",
    ),
    "query_types": (
        query_types,
        "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'technical' WHEN 1 THEN 'clarification' ELSE 'general' END AS query_type FROM conversations WHERE text IS NOT NULL",
    ),
}
