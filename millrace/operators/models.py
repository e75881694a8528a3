"""Rerankers and embedders whose scores come from a model, passed in as a function."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.vectors import cosine, dot, sigmoid
from millrace.operators.fusion import rerank

#: (queries, texts) -> scores, for a batch of pairs
PairScorer = Callable[[list[str], list[str]], list[float]]
#: texts -> vectors, for a batch
Embedder = Callable[[list[str]], list[list[float]]]

_PROVIDERS: dict[str, Callable[..., Embedder]] = {}


def register_provider(name: str, make: Callable[..., Embedder]) -> None:
    """Make an embedding provider known by name; ``make(**config)`` returns the embedder."""
    _PROVIDERS[name] = make


def provider(config: dict) -> Embedder:
    name = config.get("provider", "")
    if name not in _PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}; registered: {sorted(_PROVIDERS)}")
    return _PROVIDERS[name](**{k: v for k, v in config.items() if k != "provider"})


def hashed_embedder(dims: int = 16) -> Embedder:
    """A deterministic stand-in for tests: every token adds to a coordinate chosen by its hash."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in (t or "").lower().split():
                v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % dims] += 1.0
            out.append(v)
        return out

    return embed


register_provider("hashed", hashed_embedder)


@F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
def sparse_weights(texts: pd.Series) -> pd.Series:
    """Term frequencies of a text as a map, the sparse embedding; counted in one pass per text."""
    return texts.map(lambda t: {w: float(n) for w, n in Counter(re.findall("[a-z0-9]+", (t or "").lower())).items()})


def sparse_ids(buckets: int = 1 << 20):
    """A sparse embedder of token ids: {CRC-32 of the term modulo ``buckets``: term frequency}."""

    @F.pandas_udf(T.MapType(T.LongType(), T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> dict[int, float]:
            out: dict[int, float] = {}
            for term, n in Counter(re.findall("[a-z0-9]+", (text or "").lower())).items():
                at = zlib.crc32(term.encode()) % buckets
                out[at] = out.get(at, 0.0) + n
            return out

        return texts.map(one)

    return embed


def pair_rerank(results: DataFrame, scorer: PairScorer, query_col: str, text_col: str, top: int | None = None, id_col: str = "doc_id", activate: bool = False) -> DataFrame:
    """Cross-encoder rerank: the model scores every (query, text) pair in Arrow batches.

    ``activate`` puts raw scores through a sigmoid.  A failing model fails the
    query.  Keeps original_score and original_rank; ties keep their order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"query_id": pdf["query_id"], id_col: pdf[id_col], "score": scorer(pdf["q"].fillna("").tolist(), pdf["t"].fillna("").tolist())})

    kinds = f"query_id {results.schema['query_id'].dataType.simpleString()}, `{id_col}` {results.schema[id_col].dataType.simpleString()}, score double"
    scores = results.select("query_id", id_col, F.col(query_col).alias("q"), F.col(text_col).alias("t")).mapInPandas(run, kinds)
    if activate:
        scores = scores.withColumn("score", sigmoid(F.col("score")))
    return rerank(results, scores, top, id_col)


def semantic_rerank(results: DataFrame, query_vector: Column, doc_vector: Column, top: int | None = None, id_col: str = "vec_id") -> DataFrame:
    """Order by the cosine of the query's and the document's vectors."""
    scores = results.select("query_id", id_col, F.round(cosine(query_vector, doc_vector), 6).alias("score"))
    return rerank(results, scores, top, id_col)


def max_sim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Late interaction: for each query token vector its best dot product among the document's, summed."""
    best = F.transform(query_tokens, lambda q: F.array_max(F.transform(doc_tokens, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
