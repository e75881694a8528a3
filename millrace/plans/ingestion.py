"""Text functions, validation, cleaning, chunking, identifiers, the store and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.llm_json import extract_json, verdict
from millrace.operators import agent, documents, embedding_cache, merge_store, models, store
from millrace.operators.substring_index import SubstringIndex
from millrace.plans.retrieval import read
from millrace.session import new_folder


def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return documents.identifiers(docs, F.col("source"), F.col("doc_id").cast("string"), F.col("text")).select("doc_id", "doc_sha256", "built_id", "chunk_id", "point_uuid")


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.cache_key(F.col("text"), F.lit("dense"), F.lit("m")).alias("cache_key"))


def validate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.validate(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "valid", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = documents.clean_documents(read(spark, sf_dir, "pages"), "html", unicode=False)
    return cleaned.select("page_id", F.md5("html").alias("text_md5"), "char_count", "token_estimate")


def clean_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = documents.clean_documents(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.md5("text").alias("text_md5"), "char_count", "token_estimate")


def _ratio(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "documents").select("doc_id", F.round(fn(F.col("text")), 6).alias("ratio"))

    return run


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        tx.has_code(t).alias("has_code"),
        tx.has_table(t).alias("has_table"),
        tx.leakage_risk(t).alias("leakage"),
        t.rlike(r"\s{10,}").alias("white_space"),
        F.size(tx.long_lines(t)).alias("n_long_lines"),
        F.size(tx.invalid_characters(t)).alias("n_invalid"),
    )


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n_sentences"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = documents.chunk(read(spark, sf_dir, "documents"), "semantic", target=500)
    return chunks.select("doc_id", "chunk_index", F.md5("chunk_text").alias("text_md5"), F.length("chunk_text").alias("char_count"))


def _chunks(strategy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents.chunk(read(spark, sf_dir, "documents"), strategy)

    return run


def auto_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunk_by_content(read(spark, sf_dir, "documents"))


def content_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.content_strategy(F.col("text")).alias("strategy"))


def num_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.count_chunks(sentence_chunks(spark, sf_dir)).select("doc_id", F.col("num_chunks")).distinct()


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) where the document's text holds the item's."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return documents.containment(read(spark, sf_dir, "documents"), items)


def substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item, its first word (in any case) and its first two characters: how many documents hold them, through one index."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    needles = {"item": F.col("text"), "word": F.split_part(F.trim("text"), F.lit(" "), F.lit(1)), "start": F.left("text", F.lit(2))}
    asked = items.select("item_id", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), n.alias("item")) for kind, n in needles.items()))).alias("n"))
    asked = asked.select(F.struct("n.kind", "item_id").alias("asked"), "n.item")
    found = SubstringIndex(spark).add(docs).search(docs, asked, item_col="asked", ignore_case=F.col("asked.kind") == "word")
    counts = found.groupBy("asked").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_id").alias("doc_ids"))
    return counts.select("asked.kind", "asked.item_id", "n_docs", "doc_ids")


def embedding_cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's key and the sum of its cached vector, its number of words; filled in two runs and a third that finds nothing missing."""
    docs = read(spark, sf_dir, "documents")
    cache = embedding_cache.EmbeddingCache(spark, new_folder(spark, "embedding-cache"), "hashed")
    added = [cache.fill(rows, models.hashed_embedder, rounds=2) for rows in (docs.where("lang = 'en'"), docs, docs)]
    counts = (F.lit(n).cast("long").alias(name) for n, name in zip(added, ("n_first", "n_second", "n_third")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b).cast("long")
    return cache.lookup(docs).select("doc_id", "cache_key", total.alias("n_words"), *counts)


def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qrels(spark, sf_dir).groupBy("doc_id").agg(F.min("item_id").alias("item_id"))
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return docs.join(pairs, "doc_id", "left").join(labels, "doc_id", "left").select("doc_id", F.coalesce("item_id", F.lit(-1).cast("long")).alias("item_id"), F.coalesce("item_id", F.col("quality").cast("long"), F.lit(-1).cast("long")).alias("fallback"))


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.collection_stats(read(spark, sf_dir, "documents"), ["lang", "source"])


def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents keyed by content; those of even id come as the second load."""
    docs = read(spark, sf_dir, "documents").select(F.md5("text").alias("id"), "doc_id")
    return store.upsert(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), order=F.col("doc_id"))


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three upserts into one collection: all documents, those in English revised, those labelled toxic revised again."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    english = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "source", (F.col("n_chars") + 1).alias("n_chars"))
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("toxic").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    held = merge_store.MergeStore(spark, new_folder(spark, "merge-store"), buckets=8)
    for revision, rows in enumerate((docs, english, toxic), 1):
        held.write("documents", rows.withColumn("revision", F.lit(revision)))
    return held.read("documents").select("id", "source", "n_chars", "revision")


def verify_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return store.verify_upload(docs, docs.where("length(text) >= 200"), "doc_id")


def smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.smoke_tests(read(spark, sf_dir, "documents"))


def parse_llm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction cascade over answers made of each conversation turn's id."""
    turns = read(spark, sf_dir, "conversations").where("turn IS NOT NULL")
    n = F.col("turn").cast("string")
    body = F.concat(F.lit('{"is_faithful": true, "confidence": 0.'), n, F.lit(', "severity": "minor"}'))
    form = F.col("turn") % 4
    answer = (
        F.when(form == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```")))
        .when(form == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("It is "), body, F.lit(" I think")))
        .otherwise(F.lit("no object here"))
    )
    v = verdict(answer)
    return turns.select("conv_id", "turn", extract_json(answer).alias("json"), v["is_faithful"].alias("is_faithful"), F.round(v["confidence"], 6).alias("confidence"), v["severity"].alias("severity"))


def memory_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.memory_tail(read(spark, sf_dir, "conversations"), keep=3).select("conv_id", "n_kept", F.md5("memory").alias("text_md5"))


def self_rag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop over user turns with deterministic stand-ins: the verifier accepts once the attempt reaches turn % 4."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    states = turns.select(F.col("turn").cast("string").alias("question"), F.col("text").alias("context"))

    def generate(question, context, attempt, feedback):
        return F.concat_ws(":", attempt.cast("string"), question)

    def check(question, context, answer):
        tried, wanted = F.split_part(answer, F.lit(":"), F.lit(1)).cast("int"), question.cast("int") % 4
        good = tried >= wanted
        return F.to_json(F.struct(good.alias("is_faithful"), (~good).alias("hallucination_detected"), F.lit(0.5).alias("confidence"), F.lit("major").alias("severity")))

    return agent.self_rag_stats(agent.self_rag(states, generate, check))


_NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_CODE = r"'```\w*\n', 'def \w+\s*\(', 'function \w+\s*\(', 'class \w+\s*[\(\{:]', '(import|from)\s+\w+.*\n\s*(import|from)', '\{\s*\n.*\n\s*\}'"
_SENTENCES = r"list_filter([trim(s, e' \n\t\r\x0b\x0c') for s in string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))], lambda s: s <> '')"

_SENTENCE_CHUNKS = f"""
d AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
w AS (SELECT doc_id, 1 AS i, s[1] AS cur, 0 AS chunk FROM d WHERE len(s) > 0
      UNION ALL
      SELECT w.doc_id, i + 1, CASE WHEN length(cur) + 1 + length(s[i + 1]) <= 500 THEN cur || ' ' || s[i + 1] ELSE s[i] || ' ' || s[i + 1] END,
             chunk + CASE WHEN length(cur) + 1 + length(s[i + 1]) <= 500 THEN 0 ELSE 1 END
      FROM w JOIN d ON d.doc_id = w.doc_id WHERE i < len(s)),
sc AS (SELECT doc_id, chunk, arg_max(cur, i) AS t FROM w GROUP BY ALL)
"""

QUERIES = {
    "doc_ids": (
        doc_ids,
        rf"""WITH h AS (SELECT doc_id, source, sha256({_NORM}) AS doc_sha256 FROM documents),
        b AS (SELECT *, source || ':' || doc_id || ':' || left(doc_sha256, 12) AS built_id FROM h), c AS (SELECT *, built_id || '#c0000' AS chunk_id FROM b)
        SELECT doc_id, doc_sha256, built_id, chunk_id, regexp_replace(left(sha256(chunk_id), 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') AS point_uuid FROM c""",
    ),
    "cache_keys": (cache_keys, "SELECT doc_id, left(sha256(text || ':dense:m'), 16) AS cache_key FROM documents"),
    "validate_docs": (
        validate_docs,
        rf"""WITH t AS (SELECT doc_id, source, text, length(text) AS n, {_NORM} AS norm FROM documents),
        f AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS nth FROM t),
        m AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS x FROM documents) WHERE x <> '' GROUP BY ALL) GROUP BY doc_id),
        e AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM documents)
        SELECT doc_id, n_errors = 0 AS valid, n_errors, n_warnings FROM (SELECT doc_id,
          CAST((norm = '')::int + (n < 50)::int + (n > 1000000)::int + (regexp_matches(text, '(?i)lorem ipsum') OR regexp_matches(text, '\A.{{0,10}}\n?\z') OR (n > 50 AND left(text, 1) <> chr(10) AND left(text, 51) = repeat(left(text, 1), 51)))::int
            + (coalesce(most, 0) > 0.5 * n)::int + regexp_matches(text, '[^a-zA-Z0-9 .,!?;:()\[\]{{}}"''\-\n\t<>/&=#@%*+_|\\`~$^]')::int + (nth > 1)::int + (coalesce(source, '') = '')::int AS int) AS n_errors,
          CAST((n // 4 < 10)::int + (n // 4 > 100000)::int + (len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 1000)) > 0)::int + regexp_matches(text, '\s{{10,}}')::int
            + (CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains({list(tx.ENGLISH_WORDS)}, x))) / len(w) END < 0.7)::int AS int) AS n_warnings
        FROM f LEFT JOIN m USING (doc_id) JOIN e USING (doc_id))""",
    ),
    "clean_pages": (
        clean_pages,
        r"""WITH c AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
            '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g')) AS t FROM pages)
        SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS int) AS char_count, CAST(length(t) // 4 AS int) AS token_estimate FROM c""",
    ),
    "clean_nfkc": (clean_nfkc, None),
    "english_ratio": (
        _ratio(tx.english_ratio),
        rf"""SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains({list(tx.ENGLISH_WORDS)}, x))) / len(w) END, 6) AS ratio
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM documents)""",
    ),
    "char_ratio": (
        _ratio(tx.max_char_ratio),
        """SELECT doc_id, round(coalesce(max(c), 0) / greatest(max(n), 1), 6) AS ratio FROM (SELECT doc_id, n, x, count(*) FILTER (x <> '') AS c
        FROM (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS x FROM documents) GROUP BY ALL) GROUP BY doc_id""",
    ),
    "text_flags": (
        text_flags,
        rf"""SELECT doc_id, list_bool_or([regexp_matches(text, p) for p in [{_CODE}]]) OR (regexp_matches(text, '(?i)\bclass\s+\w+') AND
            (regexp_matches(text, '(?i)class \w+\s*:|class \w+\s*\(|class \w+.*extends|class \w+.*implements|(public|private)\s+class') OR len(c) > 1
             OR len(list_filter(c, lambda x: regexp_matches(x, '[{{}}();]|def |import |function '))) > 0)) AS has_code,
          regexp_matches(text, '\|.*\|.*\||\t.*\t.*\t|┌─+┬─+┐|<table>') AS has_table,
          CASE WHEN contains(upper(text), 'Q:') AND contains(upper(text), 'ANSWER:') THEN 'HIGH' WHEN contains(upper(text), 'Q:') OR contains(upper(text), 'ANSWER:') THEN 'LOW' ELSE 'NONE' END AS leakage,
          regexp_matches(text, '\s{{10,}}') AS white_space,
          CAST(least(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 1000)), 5) AS int) AS n_long_lines,
          CAST(len(list_distinct(regexp_extract_all(text, '[^a-zA-Z0-9 .,!?;:()\[\]{{}}"''\-\n\t<>/&=#@%*+_|\\`~$^]'))) AS int) AS n_invalid
        FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)\bclass\s+\w+')) AS c FROM documents)""",
    ),
    "sentence_split": (sentence_split, f"SELECT doc_id, CAST(len({_SENTENCES}) AS int) AS n_sentences FROM documents"),
    "sentence_chunks": (sentence_chunks, f"WITH RECURSIVE {_SENTENCE_CHUNKS} SELECT doc_id, CAST(chunk AS int) AS chunk_index, md5(t) AS text_md5, CAST(length(t) AS int) AS char_count FROM sc"),
    "recursive_chunks": (_chunks("recursive"), None),
    "code_chunks": (_chunks("code_aware"), None),
    "table_chunks": (_chunks("table_aware"), None),
    "auto_chunks": (auto_chunks, None),
    "content_strategy": (
        content_strategy,
        r"""SELECT doc_id, CASE WHEN regexp_matches(text, '```|def \w+\(|function \w+\(|class \w+') THEN 'code_aware'
        WHEN regexp_matches(text, '\|.*\|.*\||\t.*\t.*\t') THEN 'table_aware' ELSE 'recursive' END AS strategy FROM documents""",
    ),
    "num_chunks": (num_chunks, f"WITH RECURSIVE {_SENTENCE_CHUNKS} SELECT doc_id, count(*) AS num_chunks FROM sc GROUP BY doc_id"),
    "qrels": (qrels, "SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"),
    "substring_index": (
        substring_index,
        """SELECT kind, item_id, count(*) AS n_docs, CAST(sum(doc_id) AS bigint) AS doc_ids FROM documents d JOIN (
          SELECT 'item' AS kind, item_id, text AS item FROM benchmark UNION ALL SELECT 'word', item_id, lower(split_part(trim(text), ' ', 1)) FROM benchmark UNION ALL SELECT 'start', item_id, left(text, 2) FROM benchmark
        ) b ON contains(CASE WHEN kind = 'word' THEN lower(d.text) ELSE d.text END, item) GROUP BY kind, item_id""",
    ),
    "embedding_cache": (
        embedding_cache_fill,
        r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang = 'en', false) AS en FROM documents)
        SELECT doc_id, left(sha256(text || ':dense:hashed'), 16) AS cache_key, CAST(len(regexp_extract_all(text, '[^\s\p{Z}\x0b\x1c-\x1f\x{85}]+')) AS bigint) AS n_words,
        (SELECT count(DISTINCT text) FROM d WHERE en) AS n_first, (SELECT count(DISTINCT text) FROM d) - (SELECT count(DISTINCT text) FROM d WHERE en) AS n_second, CAST(0 AS bigint) AS n_third FROM d""",
    ),
    "first_match_join": (
        first_match_join,
        """SELECT doc_id, coalesce(item_id, -1) AS item_id, coalesce(item_id, quality, -1) AS fallback FROM documents
        LEFT JOIN (SELECT doc_id, min(item_id) AS item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id) USING (doc_id) LEFT JOIN labels USING (doc_id)""",
    ),
    "collection_stats": (
        collection_stats,
        """SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'ALL' END AS dimension,
        CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source END AS value, count(*) AS count, round(avg(length(text)), 6) AS avg_length
        FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""",
    ),
    "upsert_points": (
        upsert_points,
        """WITH n AS (SELECT md5(text) AS id, max(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
        SELECT md5(text) AS id, doc_id FROM documents WHERE doc_id % 2 = 1 AND md5(text) NOT IN (SELECT id FROM n) UNION ALL SELECT id, doc_id FROM n""",
    ),
    "store_merge": (
        store_merge,
        """WITH t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
        SELECT doc_id AS id, 'toxic' AS source, 0 AS n_chars, 3 AS revision FROM t UNION ALL
        SELECT doc_id, source, CASE WHEN lang = 'en' THEN n_chars + 1 ELSE n_chars END, CASE WHEN lang = 'en' THEN 2 ELSE 1 END FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t)""",
    ),
    "verify_upload": (
        verify_upload,
        "SELECT count(*) AS expected, count(*) FILTER (length(text) >= 200) AS found, count(*) FILTER (length(text) < 200) AS missing, count(*) FILTER (length(text) >= 200) >= 0.9 * count(*) AS passed FROM documents",
    ),
    "smoke": (
        smoke,
        """SELECT 'not_empty' AS test_name, count(*) > 0 AS passed FROM documents UNION ALL SELECT 'fields_present', count(*) = count(*) FILTER (doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL) FROM documents
        UNION ALL SELECT 'text_quality', avg((length(text) >= 10)::int) >= 0.8 FROM documents""",
    ),
    "parse_llm_json": (
        parse_llm_json,
        """SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN '{"is_faithful": true, "confidence": 0.' || turn || ', "severity": "minor"}' END AS json,
        turn % 4 < 3 AS is_faithful, round(CASE WHEN turn % 4 < 3 THEN CAST('0.' || turn AS double) ELSE 0.5 END, 6) AS confidence,
        CASE WHEN turn % 4 < 3 THEN 'minor' ELSE 'moderate' END AS severity FROM conversations WHERE turn IS NOT NULL""",
    ),
    "memory_tail": (
        memory_tail,
        """SELECT conv_id, count(*) AS n_kept, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id""",
    ),
    "self_rag_stats": (
        self_rag_stats,
        """SELECT count(*) AS n, round(avg(greatest(turn % 4, 1)), 6) AS avg_iterations, count(*) AS converged, count(*) FILTER (turn % 4 > 1) AS corrected
        FROM conversations WHERE role = 'user' AND text IS NOT NULL""",
    ),
}
