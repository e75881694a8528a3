"""Dense, sparse and BM25 search, and the router between them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators.ranking import top_k
from millrace.session import written


#: Scores held at once.
_SCORES = 1 << 22


class _Best:
    """The k best (score down, id up) of each query seen so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def add(self, names: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of each query (row) for each id (column); -inf is no match."""
        k = self.k
        # the k best of each query here and all that tie with the last of them, then in order
        cut = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(names), -np.inf)
        at, j = np.nonzero((scores >= cut[:, None]) & np.isfinite(scores))
        rows = [np.concatenate(x) for x in zip(self.rows, (names[at], ids[j], scores[at, j]))]
        order = np.lexsort((rows[1], -rows[2], rows[0]))
        rows = [x[order] for x in rows]
        keep = np.arange(len(order)) - np.searchsorted(rows[0], rows[0]) < k
        self.rows = [x[keep] for x in rows]

    def batch(self, id_col: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.rows], names=["query_id", id_col, "score"])


def dense_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    dims: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = 4096,
) -> DataFrame:
    """query_id, id, score (6 digits), rank: the k nearest of all rows for every query.

    ``queries`` has query_id and the vector column; a row is no match for the
    query of its own id.  Queries go to the corpus in blocks of at most
    ``block`` vectors; each task keeps its k best of a block by one matrix
    product, so k rows per task and query are shuffled.  Ties: smaller id.
    """
    spark = corpus.sparkSession
    if metric not in ("cosine", "dot"):
        raise ValueError("metric is cosine or dot")

    def matrix(column: pa.Array) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(column), -1)[:, :dims] if len(column) else np.zeros((0, 1))
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return x

    n_queries = queries.count()
    blocks = max(1, -(-n_queries // block))
    found = None
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        asked = mine.select("query_id", vector_col).toArrow().combine_chunks()
        vectors = asked.column(1).combine_chunks() if asked.num_rows else pa.array([], pa.list_(pa.float32()))
        shipped = spark.sparkContext.broadcast((asked.column(0).to_numpy(), matrix(vectors)))

        def nearest(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            names, q = shipped.value
            best = _Best(k)
            for batch in batches:
                # so many rows at once that a block of scores takes some 32 MB
                step = max(1, _SCORES // max(1, len(names)))
                for at in range(0, batch.num_rows if len(names) else 0, step):
                    rows = batch.slice(at, step)
                    ids = rows.column(0).to_numpy()
                    scores = np.round(q @ matrix(rows.column(1)).T, 6) + 0.0
                    scores[names[:, None] == ids[None, :]] = -np.inf
                    best.add(names, ids, scores)
            yield best.batch(id_col)

        part = corpus.select(F.col(id_col).cast("long").alias(id_col), vector_col).where(F.size(vector_col) > 0).mapInArrow(nearest, f"query_id bigint, `{id_col}` bigint, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, [F.desc("score"), F.asc(id_col)])


def bm25_weight(tf: Column, df: Column, n: Column, length: Column, mean_length: Column, k1: float, b: float, idf: bool = True) -> Column:
    saturated = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * saturated if idf else saturated


def sparse_scores(query_weights: DataFrame, postings: DataFrame, id_col: str) -> DataFrame:
    """Dot product of sparse vectors (query_id, term, wq) and (id, term, wd): sum over shared terms of wq * wd."""
    matched = query_weights.join(postings, "term")
    return matched.groupBy("query_id", id_col).agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def _lexical_top_k(
    docs: DataFrame, queries: DataFrame, k: int, id_col: str, digits: int, statistics: Callable[[list[str]], Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], block: int
) -> DataFrame:
    """The k best documents of every query under a sum of term weights.

    Queries go out in blocks of at most ``block``, as postings of their terms;
    ``statistics`` gets a block's terms and returns the weights of (term
    numbers, counts, lengths) in documents.  The terms of a batch of documents
    meet the postings of the block, and a task keeps its k best per query, so
    neither documents nor pairs of documents and queries are shuffled.
    """
    spark = docs.sparkSession
    blocks = _blocks(queries, block)
    found = None
    for at in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at)
        asked = [(r["query_id"], Counter(_terms(r["text"]))) for r in mine.select("query_id", "text").collect()]
        terms = sorted({t for _, c in asked for t in c})
        number = {t: i for i, t in enumerate(terms)}
        rows = sorted((number[t], j, n) for j, (_, counts) in enumerate(asked) for t, n in counts.items())
        postings = np.array(rows, np.int64).reshape(-1, 3)
        first = np.searchsorted(postings[:, 0], np.arange(len(terms) + 1))
        shipped = spark.sparkContext.broadcast((np.array([q for q, _ in asked], np.int64), number, first, postings[:, 1], postings[:, 2].astype(np.float64), statistics(terms)))

        def nearest(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            names, known, first, query, wanted, weigh = shipped.value
            best, n = _Best(k), len(names)

            def flush(ids: list[int], sizes: list[int], lengths: list[int], term: list[int], tf: list[int]) -> None:
                owner, term = np.repeat(np.arange(len(ids)), sizes), np.array(term, np.int64)
                weights = weigh(term, np.array(tf, np.float64), np.repeat(np.array(lengths, np.float64), sizes))
                # every posting of every term that a document holds
                many = first[term + 1] - first[term]
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[term], many)
                sums = np.bincount(np.repeat(owner, many) * n + query[at], np.repeat(weights, many) * wanted[at], minlength=len(ids) * n)
                scores = sums.reshape(len(ids), n).T
                best.add(names, np.array(ids, np.int64), np.where(scores > 0, np.round(scores, digits), -np.inf))

            held: tuple[list[int], ...] = ([], [], [], [], [])
            for batch in batches if n else ():
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    words = _terms(text.as_py())
                    counts = Counter(map(known.get, words))
                    counts.pop(None, None)
                    if counts:
                        for kept, new in zip(held, ([i], [len(counts)], [len(words)], counts.keys(), counts.values())):
                            kept.extend(new)
                    if len(held[0]) >= 1024 or len(held[3]) * n > _SCORES:
                        flush(*held)
                        held = ([], [], [], [], [])
            if held[0]:
                flush(*held)
            yield best.batch(id_col)

        part = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(nearest, f"query_id bigint, `{id_col}` bigint, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, [F.desc("score"), F.asc(id_col)])


def _blocks(queries: DataFrame, block: int) -> int:
    return max(1, -(-queries.count() // block))


_TERM = re.compile("[a-z0-9]+")


def _terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", block: int = 256) -> DataFrame:
    """Term-frequency dot product, not normalised; ties by id."""
    return _lexical_top_k(docs, queries, k, id_col, 9, lambda terms: _raw_counts, block)


def _raw_counts(term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return tf


class _Bm25:
    def __init__(self, df: np.ndarray, n: int, mean_length: float, k1: float, b: float, idf: bool) -> None:
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5)) if idf else np.ones(len(df))
        self.mean_length, self.k1, self.b = mean_length, k1, b

    def __call__(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * (tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean_length)))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, idf: bool = True, id_col: str = "doc_id", block: int = 256) -> DataFrame:
    """BM25 of every query against all documents; score to 6 digits, ties by id.

    Document frequencies are counted once and for the queries' terms only, by
    an aggregate that is combined before its shuffle; lengths and counts come
    from the document itself.  Jobs run when this is called.
    """
    sized = docs.select(tokens(F.coalesce("text", F.lit(""))).alias("t"))
    totals = sized.where(F.size("t") > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("m")).first()

    asked = queries.select(F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term")).distinct()
    frequencies = sized.select(F.explode(F.array_distinct("t")).alias("term")).join(asked, "term", "left_semi").groupBy("term").count()
    if _blocks(queries, block) > 1:
        frequencies = written(frequencies, "frequencies")

    def statistics(terms: list[str]) -> _Bm25:
        counts = frequencies
        if _blocks(queries, block) > 1:
            counts = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")), "term")  # terms of one block
        df = {r["term"]: r["count"] for r in counts.collect()} if terms else {}
        return _Bm25(np.array([df.get(t, 0) for t in terms], np.float64), totals["n"], totals["m"] or 1.0, k1, b, idf)

    return _lexical_top_k(docs, queries, k, id_col, 6, statistics, block)


# Phrases of conceptual queries.
CONCEPTUAL = ("how to", "what is", "explain", "describe")


def route(text: Column, available: Sequence[str] = ("dense", "sparse", "hybrid"), rules: Mapping[str, Sequence[str]] | None = None, default: str | None = None) -> Column:
    """Strategies for a query: short ones sparse, conceptual ones dense, others hybrid (or both).

    A configured phrase in the query overrides; unknown strategies are left
    out; if none is left, the default or the first available one.
    """
    lowered = F.lower(text)
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    conceptual = F.lit(False)
    for phrase in CONCEPTUAL:
        conceptual = conceptual | lowered.contains(phrase)
    strings = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    present = lambda *names: strings([n for n in names if n in available])
    otherwise = present("hybrid") if "hybrid" in available else present("dense", "sparse") if {"dense", "sparse"} <= set(available) else present()
    chosen = F.when(n_words <= 3, present("sparse")).when(conceptual, present("dense")).otherwise(otherwise)
    for phrase, names in reversed(list((rules or {}).items())):
        chosen = F.when(lowered.contains(phrase.lower()), present(*names)).otherwise(chosen)
    fallback = strings([default or available[0]])
    return F.when(F.size(chosen) > 0, chosen).otherwise(fallback)
