"""Search, fusion, reranking and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import fusion, ranking, search
from millrace.operators.lexical_index import DOT, LexicalIndex
from millrace.operators.vector_index import VectorIndex
from millrace.session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of all vector searches: rows whose id is divisible by 100, against all rows."""
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0)
    return rows.select(F.col("vec_id").alias("query_id"), "embedding")


def dense(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return search.dense_top_k(read(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), k)


def second(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The other ranking of fusion queries: dot product over the first 16 dimensions."""
    return search.dense_top_k(read(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), k, metric="dot", dims=16)


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


VECTORS = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS double[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings),
cosines AS (SELECT query_id, vec_id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM q, c WHERE vec_id <> query_id),
dots AS (SELECT query_id, vec_id, round(list_inner_product(q.e[1:16], c.e[1:16]), 6) AS score FROM q, c WHERE vec_id <> query_id),
cosine_ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank FROM cosines),
dot_ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank FROM dots),
d10 AS (SELECT * FROM cosine_ranks WHERE rank <= 10), s10 AS (SELECT * FROM dot_ranks WHERE rank <= 10),
d20 AS (SELECT * FROM cosine_ranks WHERE rank <= 20), s20 AS (SELECT * FROM dot_ranks WHERE rank <= 20)
"""


def rrf_sql(alpha: float, k: int, top: int) -> str:
    return f"""
pairs AS (SELECT query_id, vec_id, d20.rank AS dr, s20.rank AS sr FROM d20 FULL JOIN s20 USING (query_id, vec_id)),
fused AS (SELECT query_id, vec_id, round(coalesce({alpha} / ({k} + dr), 0) + coalesce((1 - {alpha}) / ({k} + sr), 0), 9) AS score,
                 least(dr, sr) AS min_rank FROM pairs),
rrf AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, min_rank, vec_id DESC) AS int) AS rank FROM fused QUALIFY rank <= {top})
"""


TOKENS = """
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
qf AS (SELECT query_id, term, count(*) AS wq FROM qt GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
lens AS (SELECT doc_id, count(*) AS length FROM dt GROUP BY doc_id),
totals AS (SELECT count(*) AS n, avg(length) AS mean_length FROM lens),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sparse AS (SELECT query_id, doc_id, CAST(sum(wq * tf) AS double) AS score FROM qf JOIN tf USING (term) GROUP BY ALL),
sparse10 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS int) AS rank FROM sparse QUALIFY rank <= 10),
bm25 AS (SELECT query_id, doc_id, round(sum(wq * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))), 6) AS score
         FROM qf JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id), totals GROUP BY ALL)
"""


def dense_minmax_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranking.min_max(dense(spark, sf_dir)).withColumn("norm_score", F.round("norm_score", 6))
    return ranking.score_filter(scored, 0.3, "norm_score")


def sparse_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sparse_top_k(read(spark, sf_dir, "documents"), text_queries(spark, sf_dir))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_top_k(read(spark, sf_dir, "documents"), text_queries(spark, sf_dir))


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``bm25_topk`` by the stored index."""
    return LexicalIndex(spark).add(read(spark, sf_dir, "documents")).search(text_queries(spark, sf_dir))


def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``sparse_dot_topk`` by the stored index."""
    return LexicalIndex(spark).add(read(spark, sf_dir, "documents")).search(text_queries(spark, sf_dir), weighting=DOT)


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows in three fifths of the cells: the vectors have hardly any clusters, so fewer cells find less than 0.9 of them."""
    index = VectorIndex.build(read(spark, sf_dir, "embeddings"))
    return index.search(vector_queries(spark, sf_dir), probes=max(1, -(-len(index.centroids) * 3 // 5)))


def ivf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``dense_topk`` by the clustered index, all cells that may hold a match."""
    return VectorIndex.build(read(spark, sf_dir, "embeddings")).search(vector_queries(spark, sf_dir), probes=None)


def bm25_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = sparse_dot_topk(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return fusion.bm25_rerank(cand, text_queries(spark, sf_dir)).select("query_id", "doc_id", "score", "original_score", "rank")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(dense(spark, sf_dir, 20), second(spark, sf_dir, 20))


def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted_sum(dense(spark, sf_dir, 20), second(spark, sf_dir, 20))


def hybrid_alpha_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = dense(spark, sf_dir, 20), second(spark, sf_dir, 20)
    runs = [fusion.rrf(d, s, alpha).select(F.lit(alpha).alias("alpha"), "query_id", "vec_id", "rank") for alpha in (0.0, 0.5, 1.0)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    return rows.select("conv_id", "turn", F.array_join(search.route(F.col("text")), ",").alias("strategy"))


def strategy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merge_strategies([("dense", dense(spark, sf_dir, 20)), ("sparse", second(spark, sf_dir, 20))], {"dense": 1.0, "sparse": 0.5})


def ensemble_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = dense(spark, sf_dir, 20), second(spark, sf_dir, 20)
    return fusion.ensemble(d.select("query_id", "vec_id", "rank"), [(d, 0.6), (s, 0.4)]).select("query_id", "vec_id", "score", "rank")


def multistage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = dense(spark, sf_dir, 20), second(spark, sf_dir, 20)
    return fusion.multi_stage(d, s, d, 20, 5).select("query_id", "vec_id", "rank")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = {"lang": ["en", "fr"], "quality": 1, "n_chars": {">=": 500, "<": 5000}, "toxic": {"!=": 1}}
    return ranking.metadata_filter(labelled(spark, sf_dir), criteria).select("doc_id")


def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = read(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source"))
    return ranking.tag_filter(tagged, ["en"], ["src0", "src1"]).select("doc_id")


def _deduplicated(by: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "documents").withColumn("external_id", F.concat_ws(":", "source", "lang"))
        return ranking.duplicate_filter(docs, by, query=None, order="doc_id").select("doc_id")

    return run


def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", ranking.answer_quality(F.col("text"), F.col("lang") == "en", F.size(F.array("lang", "source"))).alias("answer_quality"))


def context_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25_topk(spark, sf_dir).join(text_queries(spark, sf_dir).select("query_id", F.col("text").alias("q")), "query_id")
    rows = ranking.enrich_context(rows, F.col("q"), F.lit("answer"), F.lit("web"))
    return rows.select("query_id", "doc_id", "rank_position", F.md5("query_used").alias("query_md5"), "result_type", "source_platform")


def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25_topk(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return ranking.assemble_context(rows).select("query_id", F.md5("context").alias("context_md5"))


def _min_max_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT query_id, vec_id, rank, CASE WHEN max(score) OVER w - min(score) OVER w > 1e-10
        THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 / rank END AS score
        FROM {source} WINDOW w AS (PARTITION BY query_id))"""


def _dedup_sql(key: str) -> str:
    return f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) AS n FROM documents) WHERE n = 1"


QUERIES = {
    "dense_topk": (dense, f"WITH {VECTORS} SELECT query_id, vec_id, score, rank FROM d10"),
    "dense_minmax_filter": (
        dense_minmax_filter,
        f"""WITH {VECTORS} SELECT * FROM (SELECT query_id, vec_id, score, rank, round(CASE WHEN max(score) OVER w > min(score) OVER w
        THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END, 6) AS norm_score
        FROM d10 WINDOW w AS (PARTITION BY query_id)) WHERE norm_score >= 0.3""",
    ),
    "sparse_dot_topk": (sparse_dot_topk, f"WITH {TOKENS} SELECT query_id, doc_id, score, rank FROM sparse10"),
    "bm25_topk": (
        bm25_topk,
        f"WITH {TOKENS} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS int) AS rank FROM bm25 QUALIFY rank <= 10",
    ),
    "bm25_rerank": (
        bm25_rerank,
        f"""WITH {TOKENS},
        cl AS (SELECT s.query_id, s.doc_id, s.score, s.rank, length, count(*) OVER w AS cn, avg(length) OVER w AS cm FROM sparse10 s JOIN lens USING (doc_id) WINDOW w AS (PARTITION BY query_id)),
        ct AS (SELECT cl.*, t.term, t.tf, wq, count(*) OVER (PARTITION BY cl.query_id, t.term) AS cdf FROM cl JOIN tf t USING (doc_id) JOIN qf ON qf.query_id = cl.query_id AND qf.term = t.term),
        sc AS (SELECT query_id, doc_id, round(sum(wq * ln(1 + (cn - cdf + 0.5) / (cdf + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / cm)))), 6) AS score FROM ct GROUP BY ALL)
        SELECT s.query_id, s.doc_id, coalesce(sc.score, 0) AS score, s.score AS original_score,
               CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY coalesce(sc.score, 0) DESC, s.rank) AS int) AS rank
        FROM sparse10 s LEFT JOIN sc USING (query_id, doc_id)""",
    ),
    "hybrid_rrf": (hybrid_rrf, f"WITH {VECTORS}, {rrf_sql(0.5, 60, 10)} SELECT query_id, vec_id, score, min_rank, rank FROM rrf"),
    "hybrid_weighted": (
        hybrid_weighted,
        f"""WITH {VECTORS}, {_min_max_sql("d20", "dn")}, {_min_max_sql("s20", "sn")},
        f AS (SELECT query_id, vec_id, round(0.5 * coalesce(dn.score, 0) + 0.5 * coalesce(sn.score, 0), 6) AS score FROM dn FULL JOIN sn USING (query_id, vec_id))
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS int) AS rank FROM f QUALIFY rank <= 10""",
    ),
    "hybrid_alpha_extremes": (
        hybrid_alpha_extremes,
        f"""WITH {VECTORS}, {rrf_sql(0.5, 60, 10)}
        SELECT 0.0::double AS alpha, query_id, vec_id, rank FROM s10 UNION ALL SELECT 0.5::double, query_id, vec_id, rank FROM rrf
        UNION ALL SELECT 1.0::double, query_id, vec_id, rank FROM d10""",
    ),
    "route_queries": (
        route_queries,
        r"""SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '\S+')) <= 3 THEN 'sparse'
        WHEN regexp_matches(lower(text), 'how to|what is|explain|describe') THEN 'dense' ELSE 'hybrid' END AS strategy
        FROM conversations WHERE role = 'user' AND text IS NOT NULL""",
    ),
    "strategy_merge": (
        strategy_merge,
        f"""WITH {VECTORS}, m AS (SELECT query_id, vec_id, CASE WHEN d20.rank IS NULL THEN 1 ELSE 0 END AS side, coalesce(d20.rank, s20.rank) AS r,
            round(CASE WHEN d20.score IS NULL THEN s20.score WHEN s20.score IS NULL THEN d20.score ELSE (d20.score * 1.0 + s20.score * 0.5) / 1.5 END, 6) AS score
            FROM d20 FULL JOIN s20 USING (query_id, vec_id))
        SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, side, r, vec_id) AS int) AS rank FROM m QUALIFY rank <= 10""",
    ),
    "ensemble_rerank": (
        ensemble_rerank,
        f"""WITH {VECTORS}, j AS (SELECT d20.query_id, d20.vec_id, d20.rank AS r, d20.score AS a, coalesce(s20.score, 0) AS b FROM d20 LEFT JOIN s20 USING (query_id, vec_id)),
        n AS (SELECT query_id, vec_id, r,
              CASE WHEN max(a) OVER w > min(a) OVER w THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) ELSE a END AS a,
              CASE WHEN max(b) OVER w > min(b) OVER w THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) ELSE b END AS b
              FROM j WINDOW w AS (PARTITION BY query_id)),
        e AS (SELECT query_id, vec_id, r, round(0.6 * a + 0.4 * b, 6) AS score FROM n)
        SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS int) AS rank FROM e QUALIFY rank <= 10""",
    ),
    "multistage_rerank": (
        multistage_rerank,
        f"""WITH {VECTORS}, a AS (SELECT d20.query_id, d20.vec_id, d20.score, row_number() OVER (PARTITION BY d20.query_id ORDER BY coalesce(s20.score, 0) DESC, d20.rank) AS r1
            FROM d20 LEFT JOIN s20 USING (query_id, vec_id))
        SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1) AS int) AS rank FROM a QUALIFY rank <= 5""",
    ),
    "metadata_filter": (metadata_filter, "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') AND quality = 1 AND n_chars >= 500 AND n_chars < 5000 AND toxic <> 1"),
    "tag_filter": (tag_filter, "SELECT doc_id FROM documents WHERE lang = 'en' AND source NOT IN ('src0', 'src1')"),
    "duplicate_filter_external": (_deduplicated("external_id"), _dedup_sql("source, lang")),
    "duplicate_filter_content": (_deduplicated("content"), _dedup_sql("left(text, 200)")),
    "duplicate_filter_both": (_deduplicated("both"), _dedup_sql("source, lang, text")),
    "answer_quality": (
        answer_quality,
        """SELECT doc_id, CASE WHEN p >= 3 THEN 'high' WHEN p >= 2 THEN 'medium' ELSE 'low' END AS answer_quality FROM (
        SELECT doc_id, (length(text) > 200)::int + regexp_matches(lower(text), '```|<code>|def |function|class ')::int + (lang = 'en')::int + 1 AS p FROM documents)""",
    ),
    "context_enrich": (
        context_enrich,
        f"""WITH {TOKENS}, r AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS int) AS rank_position FROM bm25 QUALIFY rank_position <= 10)
        SELECT query_id, doc_id, rank_position, md5(text) AS query_md5, 'answer' AS result_type, 'unknown' AS source_platform FROM r JOIN benchmark ON item_id = query_id""",
    ),
    "context_join": (
        context_join,
        f"""WITH {TOKENS}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM bm25 QUALIFY k <= 10)
        SELECT query_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY k)) AS context_md5 FROM r JOIN documents USING (doc_id) GROUP BY query_id""",
    ),
}
# the indexes give what the searches without them give
QUERIES |= {
    "bm25_index": (bm25_index, QUERIES["bm25_topk"][1]),
    "sparse_index": (sparse_index, QUERIES["sparse_dot_topk"][1]),
    "ivf_exact": (ivf_exact, QUERIES["dense_topk"][1]),
    "ivf_topk": (ivf_topk, None),
}
