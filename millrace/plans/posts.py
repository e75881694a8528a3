"""Question and answer files read by the library, pipelines built from configs, and the agent around them.

The files are written from the test tables: benchmark items become questions
that list two documents each, documents become answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import agent, experiments, pipeline, ranking, reports, store
from millrace.plans.evaluation import ALPHAS, RRF_KS, grid_search, truth_of
from millrace.plans.evaluation import QUERIES as EVALUATED
from millrace.plans.retrieval import TOKENS, dense, read, second, text_queries
from millrace.session import new_folder, shuffles_dropped, written
from millrace.sources import qa
from millrace.sources.config import load_adapter


def _literal(lines: Column) -> Column:
    """A list literal of strings in single quotes."""
    quoted = F.transform(lines, lambda x: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def folder_of(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the two tables as CSV files."""
    item, lines = F.col("item_id"), F.split("text", "\n")
    asked = read(spark, sf_dir, "benchmark").select(
        item.alias("Question Id"),
        F.substring("text", 1, 60).alias("Question Title"),
        _literal(F.concat(F.array(F.concat(F.lit("About "), F.substring("text", 1, 20))), lines)).alias("Question Body"),
        F.when(item % 2 == 0, _literal(F.array(F.lit("one"), F.lit("two's")))).otherwise("one, two's").alias("Tags"),
        F.when(item % 5 != 0, item % 3 + 1).cast("string").alias("Question Type"),
        F.when(item % 2 == 0, F.concat(F.lit("["), (3 * item).cast("string"), F.lit(", "), (3 * item + 1).cast("string"), F.lit("]"))).otherwise(F.concat((3 * item).cast("string"), F.lit(","), (3 * item + 1).cast("string"))).alias("Answer Posts"),
    )
    given = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("Answer Id"), _literal(lines).alias("Answer Body"), F.when(F.size(lines) > 1, _literal(F.slice(lines, 1, 3))).alias("Summary")
    )
    folder = new_folder(spark, "posts")
    for name, frame in (("question.csv", asked), ("answer.csv", given)):
        frame.write.csv(f"{folder}/{name}", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return folder


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the two files."""
    asked, given = qa.post_files(spark, folder_of(spark, sf_dir))
    return qa.read_csv(spark, asked), qa.read_csv(spark, given)


def qa_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa.questions(files(spark, sf_dir)[0])
    return rows.select("external_id", "title", F.md5("body").alias("body_md5"), F.array_join("tags", "|").alias("tags"), "question_type", F.array_join("related_posts", "|").alias("related_posts"))


def qa_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.answers(files(spark, sf_dir)[1]).select("external_id", F.md5("body").alias("body_md5"), F.md5("summary").alias("summary_md5"))


def qa_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, given = files(spark, sf_dir)
    docs = qa.answer_documents(qa.questions(asked), qa.answers(given))
    return docs.select("external_id", F.md5("text").alias("text_md5"), "question_title", "has_summary", F.array_join("tags", "|").alias("tags"), "question_type")


def adapter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``qa_documents`` by the adapter's contract, from the files' folder."""
    adapter = load_adapter("stackoverflow", folder=folder_of(spark, sf_dir))
    docs = adapter.to_documents(adapter.read_rows(spark), "test")
    return docs.select("external_id", F.md5("text").alias("text_md5"), "question_title", "has_summary", F.array_join("tags", "|").alias("tags"), "question_type", "source", "dataset_version", "split")


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.query_set(*files(spark, sf_dir)).select("query_id", "query_type", F.md5("query").alias("query_md5"), F.array_join("expected", "|").alias("expected"))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "documents").select(F.concat(F.lit("a_"), F.col("doc_id").cast("string")).alias("external_id"), F.explode(F.array(F.concat_ws("#", "doc_id", F.lit("0")), F.concat_ws("#", "doc_id", F.lit("1")))).alias("chunk_id"))
    found = qa.ground_truth(files(spark, sf_dir)[0], chunks)
    return found.select("query_id", F.md5("query_text").alias("text_md5"), "n_answers", F.array_join("relevant", "|").alias("relevant"))


def agent_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa.agent_questions(files(spark, sf_dir)[0])
    return rows.select("question_id", "question_type", "question_title", F.md5("question_body").alias("body_md5"), F.md5("question_full_text").alias("full_md5"), F.size("answer_posts").alias("n_posts"))


def standalone_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa.stand_alone(*files(spark, sf_dir))[0]
    return rows.select("id", "content_hash", "post_type", "has_summary", "question_type", "char_count")


def standalone_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.stand_alone(*files(spark, sf_dir))[1].select("query_id", F.md5("query").alias("query_md5"), "query_type", F.col("expected")[0].alias("expected"))


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "lang").alias("external_id"), F.col("doc_id").alias("chunk_id"))
    return reports.chunk_ids(docs).select("external_id", F.size("chunk_ids").alias("n"), F.md5(F.array_join("chunk_ids", ",")).alias("ids_md5"))


# ---- pipelines


def _shared_words(queries: list[str], texts: list[str]) -> list[float]:
    """A deterministic scorer: how many of the query's distinct words the text has."""
    return [float(len(set(q.lower().split()) & set(t.lower().split()))) for q, t in zip(queries, texts)]


CONFIG = {
    "retrieval_pipeline": {
        "retriever": {"type": "sparse"},
        "stages": [
            {"type": "score_filter", "config": {"min_score": 5.0}},
            {"type": "duplicate_filter", "config": {"dedup_by": "content"}},
            {"type": "reranker", "config": {"model_type": "cross_encoder", "top_k": 5}},
            {"type": "answer_enhancer"},
            {"type": "result_limiter", "config": {"max_results": 3}},
        ],
    }
}


def pipeline_from_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    retrievers = {"sparse": pipeline.sparse_retriever(read(spark, sf_dir, "documents"), payload=["text"])}
    built = pipeline.from_config(CONFIG, retrievers, scorers={"default": _shared_words})
    return built.run(text_queries(spark, sf_dir)).select("query_id", "doc_id", "score", "original_rank", "rank", "retrieval_method", "answer_quality")


def answer_enhancer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer of its own query."""
    docs = read(spark, sf_dir, "documents").withColumns({"question_title": F.when(F.col("lang") != "de", F.col("source")), "tags": F.array("lang", "source"), "has_question_context": F.col("lang") == "en", "retrieval_method": F.lit("dense")})
    return ranking.enhance_answers(docs).select("doc_id", "question_title", F.array_join("programming_tags", ",").alias("programming_tags"), "has_question_context", "answer_quality", "enhanced", "retrieval_method")


def _text_and_vector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents that have a vector, and the query set: vectors of ids divisible by 100, with the first six words of their document.

    They are joined once and written, as searches read them once for each block of queries.
    """
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("vec_id"), "text")
    corpus = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").join(docs, "vec_id")
    with shuffles_dropped(spark):
        corpus = written(corpus, "text-and-vector")
    words = F.array_join(F.slice(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), 1, 6), " ")
    return corpus, corpus.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", words.alias("text"))


def _retrievers(corpus: DataFrame) -> dict[str, pipeline.Stage]:
    made = {"dense": pipeline.dense_retriever(corpus, "vec_id"), "sparse": pipeline.sparse_retriever(corpus, "vec_id")}
    return made | {"hybrid": pipeline.hybrid_retriever(made["dense"], made["sparse"], id_col="vec_id"), "semantic": pipeline.semantic_retriever(made, "vec_id")}


def hybrid_text_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search of vectors fused with BM25 of texts."""
    corpus, queries = _text_and_vector(spark, sf_dir)
    found = pipeline.from_unified_config({"embedding": {"dense": {}, "sparse": {}}}, _retrievers(corpus)).run(queries)
    return found.select("query_id", "vec_id", "score", "rank", "retrieval_method")


def label_fall_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels before metadata: quality from the labels where it isn't 0, else from the metadata."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    docs = docs.select("doc_id", F.struct("quality", "lang").alias("labels"), F.struct((F.col("n_chars") % 2).cast("int").alias("quality"), "source").alias("metadata"))
    stage = pipeline.stage_of({"type": "metadata_filter", "config": {"criteria": {"quality": 1, "lang": ["en", "fr"], "source": {"not_in": ["src0"]}}}})
    return stage(None, docs).select("doc_id")


# ---- grids, statistics, checks, the agent


def grid_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best setting for every other query, evaluated on the queries between them."""
    d, s = written(dense(spark, sf_dir, 20), "dense"), written(second(spark, sf_dir, 20), "second")
    qrels, totals = truth_of(spark, sf_dir, d, s)
    found = experiments.final_evaluation(d, s, qrels, ALPHAS, RRF_KS, F.col("query_id") % 200 == 0, totals=totals)
    return found.select("alpha", "rrf_k", "metric", "k", "mean", "count")


def grid_by_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_parameter(grid_search(spark, sf_dir), "alpha")


def _two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return turns.select("conv_id", "turn", F.explode(F.create_map(F.lit("clarity"), F.struct((n % 5).cast("double").alias("a"), (n % 4).cast("double").alias("b")), F.lit("correctness"), F.struct((n % 7).cast("double").alias("a"), (n % 6).cast("double").alias("b")))).alias("metric", "s")).select("conv_id", "turn", "metric", "s.a", "s.b")


def score_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.comparison(_two_scores(spark, sf_dir), "metric", "a", "b")
    return rows.drop("p_value", "significant_05", "significant_01")


def score_comparison_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.comparison(_two_scores(spark, sf_dir), "metric", "a", "b").select("metric", "p_value", "significant_05", "significant_01")


def upload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), (F.length("text") >= 50).alias("uploaded"))
    return store.upload_counts(points, "doc_id", F.col("uploaded"))


def chunk_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "documents").withColumns({"external_id": F.when(F.col("lang") != "en", F.col("doc_id").cast("string")), "uri": F.lit("u")})
    meta = store.chunk_meta(chunks.drop("doc_id"), config_hash="c0ffee", git_commit="abc")
    return meta.select("doc_id", "chunk_id", "doc_sha256", "source", "external_id", "dataset_version", "chunk_index", "num_chunks", "char_count", "split", F.col("labels")["lang"].alias("label_lang"), "config_hash")


def vector_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.vector_search_test(read(spark, sf_dir, "embeddings").withColumn("vec_id", F.col("vec_id").cast("long")), "vec_id", "embedding")


def agent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent's retrieval of every benchmark item; every third one has its context already."""
    docs = read(spark, sf_dir, "documents")
    states = text_queries(spark, sf_dir).select("query_id", "text", F.when(F.col("query_id") % 3 == 0, F.lit("given")).alias("context"))
    built = pipeline.simple("sparse", {"sparse": pipeline.sparse_retriever(docs, payload=["text"])})
    return agent.retrieve(states, built, k=3).select("query_id", F.md5("context").alias("context_md5"), "num_results", F.round("top_result_score", 6).alias("top_result_score"))


def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    reply = F.when(F.col("turn") % 3 == 0, "I would retrieve this.").when(F.col("turn") % 3 == 1, "DIRECT")
    return turns.select("conv_id", "turn", agent.routing(reply).alias("r")).select("conv_id", "turn", "r.*")


def judged_with_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that fails at first for some questions and always for others."""
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.concat_ws(":", "conv_id", "turn").alias("question"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("context"))
    return agent.judge(turns, _judge).select("question", "faithfulness", "relevance", "helpfulness", "attempts", "has_context")


def _judge(question: str, answer: str, context: str | None, attempt: int) -> str:
    n = len(answer)
    if n % 7 == 0 or (n % 3 == 0 and attempt == 1):
        return "no verdict"
    return f'{{"faithfulness": {1 + n % 6}, "relevance": {1 + n % 5}, "helpfulness": {1 + n % 4}}}'


_LINES = "string_split(text, chr(10))"
_Q = f"""q AS (SELECT item_id, left(text, 60) AS title, 'About ' || left(text, 20) AS head, replace(text, chr(10), ' ') AS body, CASE WHEN item_id % 5 <> 0 THEN CAST(item_id % 3 + 1 AS int) END AS kind FROM benchmark)"""
_A = f"""a AS (SELECT doc_id, replace(text, chr(10), ' ') AS body, CASE WHEN len({_LINES}) > 1 THEN array_to_string({_LINES}[1:3], ' ') END AS summary, CASE WHEN len({_LINES}) > 1 THEN array_to_string({_LINES}[1:2], ' ') END AS two,
    CASE WHEN len({_LINES}) > 1 THEN '[' || array_to_string(list_transform({_LINES}[1:3], lambda x: '''' || replace(replace(x, '\\', '\\\\'), '''', '\\''') || ''''), ', ') || ']' END AS raw_summary FROM documents)"""
_BLANKLESS = f"array_to_string(list_filter(list_transform({_LINES}, lambda x: trim(x)), lambda x: x <> ''), ' ')"

QUERIES = {
    "qa_questions": (
        qa_questions,
        f"""WITH {_Q} SELECT 'q_' || item_id AS external_id, trim(title) AS title, md5(head || ' ' || body) AS body_md5, 'one|two''s' AS tags, kind AS question_type, (3 * item_id) || '|' || (3 * item_id + 1) AS related_posts FROM q""",
    ),
    "qa_answers": (qa_answers, f"WITH {_A} SELECT 'a_' || doc_id AS external_id, md5(body) AS body_md5, md5(coalesce(summary, '')) AS summary_md5 FROM a"),
    "qa_documents": (
        qa_documents,
        f"""WITH {_Q}, {_A}, l AS (SELECT n, arg_min(title, item_id) AS title, arg_min(kind, item_id) AS kind, min(item_id) AS first FROM (SELECT *, unnest([3 * item_id, 3 * item_id + 1]) AS n FROM q) GROUP BY n),
        j AS (SELECT a.*, l.first, CASE WHEN l.first IS NOT NULL THEN l.first ELSE s.item_id END AS item FROM a LEFT JOIN l ON l.n = doc_id LEFT JOIN q s ON s.item_id = doc_id WHERE trim(a.body) <> '')
        SELECT 'a_' || doc_id AS external_id, md5(j.body || CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || chr(10) || 'Summary: ' || summary ELSE '' END) AS text_md5, trim(q.title) AS question_title,
               coalesce(summary, '') <> '' AS has_summary, CASE WHEN q.item_id IS NOT NULL THEN 'one|two''s' ELSE '' END AS tags, q.kind AS question_type FROM j LEFT JOIN q ON q.item_id = j.item""",
    ),
    "query_set": (
        query_set,
        rf"""WITH {_Q}, {_A}, k AS (SELECT item_id, title, head || ' ' || body AS body, n FROM (SELECT *, unnest(CASE WHEN item_id % 2 = 1 THEN [3 * item_id, 3 * item_id + 1, -item_id] ELSE [-item_id] END) AS n FROM q) WHERE length(title) > 10),
        f AS (SELECT item_id, title, body, abs(n) AS doc, n >= 0 AND NOT (n = 0 AND item_id = 0) AS listed FROM k WHERE abs(n) IN (SELECT doc_id FROM documents)),
        g AS (SELECT item_id, any_value(title) AS title, any_value(body) AS body, CASE WHEN bool_or(listed) THEN string_agg('a_' || doc, '|' ORDER BY doc) FILTER (listed) ELSE any_value('a_' || doc) END AS expected FROM f GROUP BY item_id),
        t AS (SELECT 'eval_q2a_' || item_id AS query_id, 'question_title_to_answer' AS query_type, title AS query, expected, 10 AS least FROM g
              UNION ALL SELECT 'eval_q2a_short_' || item_id, 'question_short_to_answer', array_to_string(list_filter(string_split_regex(title, '\s+'), lambda w: w <> '')[1:6], ' '), expected, 10 FROM g
              UNION ALL SELECT 'eval_qbody2a_' || item_id, 'question_body_to_answer', CASE WHEN contains(body, '.') THEN split_part(body, '.', 1) ELSE left(body, 100) END, expected, 20 FROM g
              UNION ALL SELECT 'eval_a2a_' || doc_id, 'answer_summary_to_answer', two, 'a_' || doc_id, 15 FROM a WHERE length(raw_summary) > 20)
        SELECT query_id, query_type, md5(query) AS query_md5, expected FROM t WHERE length(query) > least""",
    ),
    "ground_truth": (
        ground_truth,
        r"""WITH q AS (SELECT item_id, left(text, 60) || ' [' || array_to_string(list_transform(list_concat(['About ' || left(text, 20)], string_split(text, chr(10))), lambda x: '''' || replace(replace(x, '\', '\\'), '''', '\''') || ''''), ', ') || ']' AS t
            FROM benchmark WHERE item_id % 2 = 0 AND trim(left(text, 60)) <> ''),
        c AS (SELECT item_id, string_agg(doc_id || '#' || n, '|' ORDER BY doc_id || '#' || n) AS relevant FROM q JOIN documents ON doc_id IN (3 * item_id, 3 * item_id + 1), (VALUES (0), (1)) v(n) GROUP BY item_id)
        SELECT CAST(item_id AS varchar) AS query_id, md5(trim(t)) AS text_md5, CAST(2 AS int) AS n_answers, coalesce(relevant, '') AS relevant FROM q LEFT JOIN c USING (item_id)""",
    ),
    "agent_questions": (
        agent_questions,
        f"""WITH {_Q} SELECT CAST(item_id AS varchar) AS question_id, kind AS question_type, head AS question_title, md5(body) AS body_md5, md5(head || chr(10) || chr(10) || regexp_replace(body, '\\s+$', '')) AS full_md5, CAST(2 AS int) AS n_posts
        FROM q WHERE kind IS NOT NULL AND item_id % 2 = 0""",
    ),
    "standalone_documents": (
        standalone_documents,
        f"""WITH q AS (SELECT item_id, left(text, 60) AS title, trim('About ' || left(text, 20)) || CASE WHEN {_BLANKLESS} <> '' THEN ' ' || {_BLANKLESS} ELSE '' END AS body, CASE WHEN item_id % 5 <> 0 THEN CAST(item_id % 3 + 1 AS int) END AS kind FROM benchmark),
        a AS (SELECT doc_id, {_BLANKLESS} AS body, CASE WHEN len({_LINES}) > 1 THEN nullif(array_to_string(list_filter(list_transform({_LINES}[1:3], lambda x: trim(x)), lambda x: x <> ''), ' '), '') END AS summary FROM documents),
        p AS (SELECT 'q_' || item_id AS id, CASE WHEN title <> '' AND body <> '' THEN 'Title: ' || title || chr(10) || chr(10) || 'Question: ' || body ELSE title || body END AS content, 'question' AS post_type, false AS has_summary, kind AS question_type FROM q
              UNION ALL SELECT 'a_' || doc_id, CASE WHEN summary IS NOT NULL THEN 'Answer: ' || body || chr(10) || chr(10) || 'Summary: ' || summary ELSE body END, 'answer', summary IS NOT NULL, NULL FROM a)
        SELECT id, left(sha256(content), 12) AS content_hash, post_type, has_summary, question_type, CAST(length(content) AS int) AS char_count FROM p WHERE trim(content) <> ''""",
    ),
    "standalone_queries": (
        standalone_queries,
        f"""WITH a AS (SELECT doc_id, CASE WHEN len({_LINES}) > 1 THEN array_to_string(list_filter(list_transform({_LINES}[1:3], lambda x: trim(x)), lambda x: x <> ''), ' ') END AS summary FROM documents),
        t AS (SELECT 'eval_q_' || item_id AS query_id, left(text, 60) AS query, 'question_title' AS query_type, 'q_' || item_id AS expected FROM benchmark WHERE length(left(text, 60)) > 10
              UNION ALL SELECT 'eval_a_' || doc_id, trim(split_part(summary, '.', 1)) || '.', 'answer_summary', 'a_' || doc_id FROM a WHERE length(summary) > 20)
        SELECT query_id, md5(query) AS query_md5, query_type, expected FROM t WHERE length(query) > 10""",
    ),
    "id_map": (id_map, "SELECT source || ':' || lang AS external_id, CAST(count(*) AS int) AS n, md5(string_agg(doc_id, ',' ORDER BY doc_id)) AS ids_md5 FROM documents GROUP BY 1"),
    "pipeline_from_config": (
        pipeline_from_config,
        rf"""WITH {TOKENS}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r0 FROM bm25 QUALIFY r0 <= 10),
        u AS (SELECT r.*, d.text FROM r JOIN documents d USING (doc_id) WHERE score >= 5.0 QUALIFY row_number() OVER (PARTITION BY query_id, left(d.text, 200) ORDER BY r0) = 1),
        s AS (SELECT query_id, u.doc_id, u.text, r0, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '\S+')), list_distinct(regexp_extract_all(lower(u.text), '\S+')))) AS double) AS score FROM u JOIN benchmark b ON item_id = query_id),
        f AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS int) AS rank FROM s QUALIFY rank <= 3)
        SELECT query_id, doc_id, score, CAST(r0 AS int) AS original_rank, rank, 'sparse+enhanced' AS retrieval_method,
               CASE WHEN (length(text) > 200)::int + regexp_matches(lower(text), '```|<code>|def |function|class ')::int >= 2 THEN 'medium' ELSE 'low' END AS answer_quality FROM f""",
    ),
    "answer_enhancer": (
        answer_enhancer,
        """SELECT doc_id, CASE WHEN lang <> 'de' THEN source ELSE 'N/A' END AS question_title, lang || ',' || source AS programming_tags, lang = 'en' AS has_question_context,
        CASE WHEN p >= 3 THEN 'high' WHEN p >= 2 THEN 'medium' ELSE 'low' END AS answer_quality, true AS enhanced, 'dense+enhanced' AS retrieval_method FROM (
        SELECT *, (length(text) > 200)::int + regexp_matches(lower(text), '```|<code>|def |function|class ')::int + (lang = 'en')::int + 1 AS p FROM documents)""",
    ),
    "hybrid_text_vector": (
        hybrid_text_vector,
        rf"""WITH c AS (SELECT vec_id, CAST(embedding AS double[]) AS e, text FROM embeddings JOIN documents ON doc_id = vec_id),
        q AS (SELECT vec_id AS query_id, e, array_to_string(list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda w: w <> '')[1:6], ' ') AS t FROM c WHERE vec_id % 100 = 0),
        dr AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.e, c.e), 6) DESC, vec_id) AS rank FROM q, c WHERE vec_id <> query_id QUALIFY rank <= 20),
        dt AS (SELECT vec_id AS doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM c), qt AS (SELECT query_id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM q),
        qf AS (SELECT query_id, term, count(*) AS wq FROM qt GROUP BY ALL), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), lens AS (SELECT doc_id, count(*) AS length FROM dt GROUP BY doc_id),
        totals AS (SELECT count(*) AS n, avg(length) AS mean_length FROM lens), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        bm25 AS (SELECT query_id, doc_id AS vec_id, round(sum(wq * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))), 6) AS score FROM qf JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id), totals GROUP BY ALL),
        sr AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM bm25 QUALIFY rank <= 20),
        p AS (SELECT query_id, vec_id, round(coalesce(0.5 / (60 + dr.rank), 0) + coalesce(0.5 / (60 + sr.rank), 0), 9) AS score, least(dr.rank, sr.rank) AS m FROM dr FULL JOIN sr USING (query_id, vec_id))
        SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m, vec_id DESC) AS int) AS rank, 'hybrid' AS retrieval_method FROM p QUALIFY rank <= 10""",
    ),
    "label_fall_through": (
        label_fall_through,
        """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE CASE WHEN coalesce(quality, 0) <> 0 THEN quality ELSE n_chars % 2 END = 1 AND lang IN ('en', 'fr') AND source NOT IN ('src0')""",
    ),
    "grid_by_alpha": (
        grid_by_alpha,
        f"SELECT alpha, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max, count(*) AS n FROM ({EVALUATED['grid_search'][1]}) GROUP BY alpha",
    ),
    "grid_test": (grid_test, None),
    "score_comparison": (
        score_comparison,
        """WITH t AS (SELECT length(text) AS n FROM conversations WHERE text IS NOT NULL),
        s AS (SELECT 'clarity' AS metric, CAST(n % 5 AS double) AS a, CAST(n % 4 AS double) AS b FROM t UNION ALL SELECT 'correctness', n % 7, n % 6 FROM t)
        SELECT metric, count(*) AS n, round(avg(a), 6) AS a_mean, round(stddev_pop(a), 6) AS a_std, median(a) AS a_median, min(a) AS a_min, max(a) AS a_max,
               round(avg(b), 6) AS b_mean, round(stddev_pop(b), 6) AS b_std, median(b) AS b_median, min(b) AS b_min, max(b) AS b_max,
               round(avg(a - b), 6) AS mean_diff, round(avg(CASE WHEN b > 0 THEN 100 * (a - b) / b ELSE 0 END), 6) AS mean_pct, median(a - b) AS median_diff,
               count(*) FILTER (a > b) AS wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (a < b) AS losses,
               round(CASE WHEN stddev_samp(a - b) > 1e-12 THEN avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) END, 6) AS t,
               round(CASE WHEN stddev_pop(a - b) > 1e-12 THEN avg(a - b) / stddev_pop(a - b) ELSE 0 END, 6) AS effect FROM s GROUP BY metric
        UNION ALL SELECT 'overall', count(*), round(avg(a), 6), round(stddev_pop(a), 6), median(a), min(a), max(a), round(avg(b), 6), round(stddev_pop(b), 6), median(b), min(b), max(b),
               round(avg(a - b), 6), round(avg(CASE WHEN b > 0 THEN 100 * (a - b) / b ELSE 0 END), 6), median(a - b), count(*) FILTER (a > b), count(*) FILTER (a = b), count(*) FILTER (a < b),
               round(CASE WHEN stddev_samp(a - b) > 1e-12 THEN avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) END, 6), round(CASE WHEN stddev_pop(a - b) > 1e-12 THEN avg(a - b) / stddev_pop(a - b) ELSE 0 END, 6) FROM s""",
    ),
    "score_comparison_p": (score_comparison_p, None),
    "upload_counts": (
        upload_counts,
        "SELECT count(*) AS total, count(*) FILTER (length(text) >= 50) AS successful, count(*) FILTER (NOT coalesce(length(text) >= 50, false)) AS failed, count(DISTINCT source) AS documents, round(count(*) / count(DISTINCT source), 6) AS avg_chunks FROM documents",
    ),
    "chunk_meta": (
        chunk_meta,
        """WITH d AS (SELECT *, CASE WHEN lang <> 'en' THEN CAST(doc_id AS varchar) ELSE 'unknown' END AS external_id_, sha256(trim(regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g'))) AS h FROM documents)
        SELECT source || ':' || external_id_ || ':' || left(h, 12) AS doc_id, source || ':' || external_id_ || ':' || left(h, 12) || '#c0000' AS chunk_id, h AS doc_sha256, source, external_id_ AS external_id, 'unknown' AS dataset_version,
        CAST(0 AS int) AS chunk_index, CAST(1 AS int) AS num_chunks, CAST(length(text) AS int) AS char_count, 'all' AS split, lang AS label_lang, 'c0ffee' AS config_hash FROM d""",
    ),
    "vector_smoke": (vector_smoke, "SELECT 'vector_search' AS test_name, count(*) > 0 AS passed, CAST(least(count(*), 3) AS bigint) AS n_results, CAST(max(len(embedding)) AS int) AS vector_size FROM embeddings"),
    "agent_context": (
        agent_context,
        f"""WITH {TOKENS}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM bm25 QUALIFY k <= 3),
        c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY k) AS context, count(*) AS n, max(score) AS top FROM r JOIN documents USING (doc_id) GROUP BY query_id)
        SELECT item_id AS query_id, md5(CASE WHEN item_id % 3 = 0 THEN 'given' ELSE coalesce(context, '') END) AS context_md5, CASE WHEN item_id % 3 <> 0 THEN coalesce(n, 0) END AS num_results, CASE WHEN item_id % 3 <> 0 THEN coalesce(top, 0.0) END AS top_result_score
        FROM benchmark LEFT JOIN c ON c.query_id = item_id""",
    ),
    "routed_questions": (
        routed_questions,
        """SELECT conv_id, turn, turn % 3 <> 1 AS needs_retrieval, CASE turn % 3 WHEN 0 THEN 'I WOULD RETRIEVE THIS.' WHEN 1 THEN 'DIRECT' ELSE 'RETRIEVE (fallback)' END AS routing_decision,
        CASE WHEN turn % 3 = 1 THEN 'generator' ELSE 'retriever' END AS next_node FROM conversations WHERE text IS NOT NULL""",
    ),
    "judged_with_retries": (
        judged_with_retries,
        """WITH j AS (SELECT conv_id || ':' || turn AS question, length(text) AS n, length(text) % 7 = 0 OR length(text) % 6 = 5 AS bad FROM conversations WHERE text IS NOT NULL)
        SELECT question, CASE WHEN bad THEN 0 ELSE 1 + n % 6 END AS faithfulness, CASE WHEN bad THEN 0 ELSE 1 + n % 5 END AS relevance, CASE WHEN bad THEN 0 ELSE 1 + n % 4 END AS helpfulness,
        CAST(CASE WHEN bad THEN 3 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS int) AS attempts, false AS has_context FROM j""",
    ),
}
QUERIES["adapter_documents"] = (adapter_documents, f"SELECT *, 'stackoverflow_sosum' AS source, '1.0.0' AS dataset_version, 'test' AS split FROM ({QUERIES['qa_documents'][1]})")
