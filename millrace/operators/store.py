"""The point store: keyed idempotent upsert, embeddings with a cache, checks after ingest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.vectors import sparse_parts
from millrace.operators.search import dense_top_k


def to_points(chunks: DataFrame, key: Column, payload: list[str], dense: str | None = None, sparse: str | None = None) -> DataFrame:
    """id (a UUID of the key), vectors, payload and which embeddings there are."""
    has_dense = F.col(dense).isNotNull() if dense else F.lit(False)
    has_sparse = F.col(sparse).isNotNull() if sparse else F.lit(False)
    kinds = F.array_compact(F.array(F.when(has_dense, "dense"), F.when(has_sparse, "sparse")))
    columns = [tx.uuid_of(key).alias("id"), F.struct(*payload).alias("payload"), kinds.alias("embedding_types"), has_dense.alias("has_dense"), has_sparse.alias("has_sparse")]
    if dense:
        columns.append(F.col(dense).alias("dense"))
    if sparse:
        indices, values = sparse_parts(F.col(sparse))
        columns.append(F.when(has_sparse, F.struct(indices.alias("indices"), values.alias("values"))).alias("sparse"))
    return chunks.select(*columns)


def keyed_points(docs: DataFrame, external_id: str = "external_id") -> DataFrame:
    """Adds ``id``: the UUID of the external id, so that a document inserted again replaces itself, or a random one where there is none."""
    known = F.nullif(F.col(external_id).cast("string"), F.lit(""))
    return docs.withColumn("id", F.coalesce(tx.uuid_of(known), F.expr("uuid()")))


def chunk_meta(chunks: DataFrame, config_hash: str, git_commit: str | None = None, text_col: str = "text") -> DataFrame:
    """Chunks with their ids and the defaults of what they don't bring; every other column goes into ``labels``.

    Ids come from source, external id and the hash of the text.
    """
    have = set(chunks.columns)
    default = lambda name, value, kind="string": F.coalesce(F.col(name).cast(kind), F.lit(value)) if name in have else F.lit(value).cast(kind)
    digest, source, external = tx.content_hash(F.col(text_col)), default("source", "unknown"), default("external_id", "unknown")
    index = default("chunk_index", 0, "int")
    document = tx.doc_id(source, external, digest)
    own = {"source", "external_id", "dataset_version", "uri", "chunk_index", "num_chunks", "token_estimate", "split", "labels", text_col}
    rest = F.create_map(*(x for c in chunks.columns if c not in own for x in (F.lit(c), F.col(c).cast("string")))) if have - own else F.create_map().cast("map<string,string>")
    labels = F.map_concat(F.map_filter(F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*(have - own))), rest) if "labels" in have else rest
    return chunks.select(
        document.alias("doc_id"),
        tx.chunk_id(document, index).alias("chunk_id"),
        digest.alias("doc_sha256"),
        F.col(text_col).alias("text"),
        source.alias("source"),
        default("dataset_version", "unknown").alias("dataset_version"),
        external.alias("external_id"),
        default("uri", None).alias("uri"),
        index.alias("chunk_index"),
        default("num_chunks", 1, "int").alias("num_chunks"),
        default("token_estimate", None, "int").alias("token_count"),
        F.length(text_col).alias("char_count"),
        default("split", "all").alias("split"),
        labels.alias("labels"),
        F.lit(git_commit).cast("string").alias("git_commit"),
        F.lit(config_hash).alias("config_hash"),
    )


def upsert(old: DataFrame | None, new: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and the last row of each key of ``new``.

    Applying it twice changes nothing.  The last row is found by a combined
    aggregate of whole rows, not by a window over a key's rows.
    """
    rows = [F.col(c) for c in new.columns]
    hashed = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in new.dtypes]
    last = new.groupBy(key).agg(F.max_by(F.struct(*rows), order if order is not None else F.xxhash64(*hashed)).alias("r")).select("r.*")
    return last if old is None else old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


class PointStore:
    """Collections as Parquet versions under one folder; a pointer table names the current one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[str]:
        fs, path = self._fs(f"{self.root}/{name}")
        done = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
        return sorted(p.getName() for p in done if fs.exists(self._fs(f"{p.toString()}/_SUCCESS")[1]))

    def read(self, name: str) -> DataFrame | None:
        found = self._versions(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{found[-1]}") if found else None

    def write(self, name: str, points: DataFrame) -> DataFrame:
        """Upsert into a new version; readers of the old one are not disturbed."""
        found = self._versions(name)
        version = f"v{len(found):08d}-{uuid.uuid4().hex[:8]}"
        upsert(self.read(name), points).write.parquet(f"{self.root}/{name}/{version}")
        return self.read(name)

    def recreate(self, name: str) -> None:
        fs, path = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)

    def spec(self, name: str) -> dict | None:
        """What a collection was created for: dim, metric, sparse."""
        fs, path = self._fs(f"{self.root}/{name}/spec.json")
        if not fs.exists(path):
            return None
        return json.loads("".join(r["value"] for r in self.spark.read.text(path.toString()).collect()))

    def ensure(self, name: str, points: DataFrame, dense: str = "dense", sparse: str = "sparse", dims: int = 384, metric: str = "cosine") -> dict:
        """The collection's spec, created from the points if there is none; vectors of another length or metric are errors.

        The dimension is that of the vectors, ``dims`` without any.
        """
        have, known = set(points.columns), self.spec(name)
        sizes = points.where(F.col(dense).isNotNull()).agg(F.min(F.size(dense)).alias("lo"), F.max(F.size(dense)).alias("hi")).first() if dense in have else None
        found = sizes["lo"] if sizes else None
        if found is not None and found != sizes["hi"]:
            raise ValueError(f"vectors of {found} to {sizes['hi']} dimensions")
        wanted = {"dim": found or (known or {}).get("dim", dims), "metric": metric, "sparse": sparse in have or bool((known or {}).get("sparse"))}
        if known and (known["dim"], known["metric"]) != (wanted["dim"], metric):
            raise ValueError(f"collection {name} holds {known['metric']} vectors of {known['dim']} dimensions, not {metric} of {wanted['dim']}")
        if known != wanted:
            fs, path = self._fs(f"{self.root}/{name}/spec.json")
            out = fs.create(path, True)
            out.write(bytearray(json.dumps(wanted, sort_keys=True).encode()))
            out.close()
        return wanted

    def canary(self, name: str) -> str:
        return f"{name}_canary"

    def drop_canaries(self) -> list[str]:
        fs, root = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        gone = [n for n in names if "_canary" in n]
        for n in gone:
            self.recreate(n)
        return gone


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], name: str, cache: DataFrame | None = None, text_col: str = "text", batch: int = 32, retries: int = 3, dims: int = 384) -> DataFrame:
    """Adds cache_key and embedding; texts in the cache (cache_key, embedding) are not embedded again.

    Each distinct text is embedded once.  A batch that fails ``retries`` times
    gets zero vectors of ``dims``.
    """
    keyed = chunks.withColumn("cache_key", tx.cache_key(F.col(text_col), F.lit("dense"), F.lit(name)))
    todo = keyed.select("cache_key", text_col).groupBy("cache_key").agg(F.first(text_col).alias("t"))
    if cache is not None:
        todo = todo.join(cache.select("cache_key"), "cache_key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list[list[float]] = []
            for at in range(0, len(pdf), batch):
                texts = pdf["t"].iloc[at : at + batch].tolist()
                for attempt in range(retries):
                    try:
                        vectors += model(texts)
                        break
                    except Exception:  # a provider may fail in any way; the last failure falls back
                        if attempt == retries - 1:
                            vectors += [[0.0] * dims for _ in texts]
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "embedding": vectors})

    fresh = todo.mapInPandas(run, "cache_key string, embedding array<double>")
    known = fresh if cache is None else cache.select("cache_key", "embedding").unionByName(fresh)
    return keyed.join(known, "cache_key", "left")


def grown_cache(cache: DataFrame | None, embedded: DataFrame) -> DataFrame:
    """The cache (cache_key, embedding) with the new vectors of :func:`embed`; zero vectors of failed batches are not remembered."""
    fresh = embedded.where(F.exists("embedding", lambda x: x != 0)).groupBy("cache_key").agg(F.first("embedding").alias("embedding"))
    return fresh if cache is None else cache.select("cache_key", "embedding").unionByName(fresh.join(cache.select("cache_key"), "cache_key", "left_anti"))


def embed_as(strategy: str, chunks: DataFrame, dense: Callable[[list[str]], list[list[float]]] | None = None, sparse: Callable[[Column], Column] | None = None, name: str = "unknown", text_col: str = "text", **options) -> DataFrame:
    """Adds embedding, sparse or both, as the strategy (dense, sparse, hybrid) says; see :func:`embed` for options.

    ``sparse`` gives a map of a text's terms; where it gives null the map is empty.
    """
    if strategy not in ("dense", "sparse", "hybrid"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if (strategy != "sparse" and dense is None) or (strategy != "dense" and sparse is None):
        raise ValueError(f"strategy {strategy} lacks a model")
    if strategy != "sparse":
        chunks = embed(chunks, dense, name, text_col=text_col, **options)
    if strategy != "dense":
        chunks = chunks.withColumn("sparse", F.coalesce(sparse(F.col(text_col)), F.create_map().cast("map<string,double>")))
    return chunks


def upload_counts(points: DataFrame, document: str, uploaded: Column) -> DataFrame:
    """total, successful, failed, documents and chunks per document of an upload."""
    good = F.coalesce(uploaded, F.lit(False))
    counts = points.groupBy(document).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"))
    total, documents = F.coalesce(F.sum("n"), F.lit(0)), F.count(document)
    return counts.agg(
        total.alias("total"), F.coalesce(F.sum("good"), F.lit(0)).alias("successful"), (total - F.coalesce(F.sum("good"), F.lit(0))).alias("failed"), documents.alias("documents"), F.round(F.when(documents > 0, total / documents), 6).alias("avg_chunks")
    )


def vector_search_test(corpus: DataFrame, id_col: str = "id", vector_col: str = "dense", k: int = 3, dims: int = 384) -> DataFrame:
    """(test_name, passed, n_results, vector_size): whether a search with a constant vector finds anything."""
    first = corpus.where(F.size(vector_col) > 0).select(F.size(vector_col).alias("n")).first()
    size = first["n"] if first else dims
    spark = corpus.sparkSession
    asked = spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.array_repeat(F.lit(0.1).cast("float"), size).alias(vector_col))
    found = dense_top_k(corpus, asked, k, id_col=id_col, vector_col=vector_col).agg(F.count(F.lit(1)).alias("n_results"))
    return found.select(F.lit("vector_search").alias("test_name"), (F.col("n_results") > 0).alias("passed"), "n_results", F.lit(size if first else None).cast("int").alias("vector_size"))


def verify_upload(sample: DataFrame, stored: DataFrame, key: str = "id", needed: float = 0.9) -> DataFrame:
    """expected, found, missing, passed: how many of the sampled keys are stored."""
    have = stored.select(key).distinct().withColumn("__have", F.lit(1))
    counts = sample.select(key).distinct().join(have, key, "left").agg(F.count(F.lit(1)).alias("expected"), F.count("__have").alias("found"))
    return counts.select("expected", "found", (F.col("expected") - F.col("found")).alias("missing"), (F.col("found") >= needed * F.col("expected")).alias("passed"))


def smoke_tests(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shortest: int = 10) -> DataFrame:
    """(test_name, passed): not empty, required fields present, texts long enough; in one pass."""
    good = F.avg((F.length(text_col) >= shortest).cast("double"))
    tests = chunks.agg(
        (F.count(F.lit(1)) > 0).alias("not_empty"),
        (F.count(F.lit(1)) == F.count_if(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(source_col).isNotNull())).alias("fields_present"),
        F.coalesce(good >= 0.8, F.lit(False)).alias("text_quality"),
    )
    return tests.selectExpr("stack(3, 'not_empty', not_empty, 'fields_present', fields_present, 'text_quality', text_quality) as (test_name, passed)")


def smoke_summary(tests: DataFrame, needed: float = 0.8) -> DataFrame:
    rate = F.avg(F.col("passed").cast("double"))
    return tests.agg(F.count(F.lit(1)).alias("n_tests"), F.count_if("passed").alias("n_passed"), F.round(rate, 6).alias("pass_rate"), (rate >= needed).alias("passed"))


def collection_stats(rows: DataFrame, dimensions: list[str], text_col: str = "text") -> DataFrame:
    """(dimension, value, count, avg_length) for each dimension and ALL, from one pass of grouping sets."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = rows.groupingSets(sets, *map(F.col, dimensions)).agg(
        F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("count"), F.round(F.avg(F.length(text_col)), 6).alias("avg_length")
    )
    n = len(dimensions)
    dimension, value = F.lit("ALL"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        mine = F.col("__g") == (2**n - 1) ^ (1 << (n - 1 - i))
        dimension, value = F.when(mine, d).otherwise(dimension), F.when(mine, F.col(d).cast("string")).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "count", "avg_length")
