"""Composable retrieval pipelines: a retriever and the stages after it, built by hand or from a config.

A retriever is (queries, None, **options) -> results with query_id, an id,
score and rank; other stages turn results into results.  Plans are lazy, so a
stage that can't be built fails its pipeline at once, and settings that a stage
doesn't know are errors.
"""

from __future__ import annotations

import glob
import inspect
import json
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import fusion, models, ranking, search
from millrace.sources.config import deep_merge, load

#: (queries, results or None, **options) -> results
Stage = Callable[..., DataFrame]
RETRIEVER_TYPES = ("dense", "sparse", "hybrid", "semantic")


@dataclass
class RetrievalPipeline:
    """Named stages in order, the first of which retrieves.

    ``run`` passes each stage its own options over the general ones; of the
    general ones a stage takes those it knows.
    """

    stages: list[tuple[str, Stage]] = field(default_factory=list)
    config: Mapping[str, Any] = field(default_factory=dict)

    def add(self, name: str, stage: Stage, position: int | None = None) -> RetrievalPipeline:
        self.stages.insert(len(self.stages) if position is None else position, (name, stage))
        return self

    def remove(self, name: str) -> bool:
        before = len(self.stages)
        self.stages = [s for s in self.stages if s[0] != name]
        return len(self.stages) < before

    def get(self, name: str) -> Stage | None:
        return next((s for n, s in self.stages if n == name), None)

    def run(self, queries: DataFrame, config: Mapping[str, Mapping[str, Any]] | None = None, **options: Any) -> DataFrame:
        if not self.stages or getattr(self.stages[0][1], "needs_results", False):
            raise ValueError("a pipeline needs a retriever first")
        if unknown := set(config or {}) - {name for name, _ in self.stages}:
            raise ValueError(f"options for stages that the pipeline doesn't have: {sorted(unknown)}")
        results = None
        for name, stage in self.stages:
            results = stage(queries, results, **{**options, **dict((config or {}).get(name, {}))})
        return results


def _wrap(fn: Callable[..., DataFrame], renamed: Mapping[str, str] | None = None, **defaults: Any) -> Callable[..., Stage]:
    """A stage of a function of results; ``renamed`` maps a config's names to the function's."""
    names = renamed or {}
    known = set(inspect.signature(fn).parameters)
    takes_queries = "queries" in known

    def build(**settings: Any) -> Stage:
        given = {**defaults, **{names.get(k, k): v for k, v in settings.items() if v is not None}}
        if unknown := set(given) - known:
            raise ValueError(f"{fn.__name__} has no setting {sorted(unknown)}")

        def stage(queries: DataFrame, results: DataFrame, **options: Any) -> DataFrame:
            more = {names.get(k, k): v for k, v in options.items() if names.get(k, k) in known}
            return fn(results, **({"queries": queries} if takes_queries else {}), **{**given, **more})

        stage.needs_results = True
        return stage

    return build


def _texts(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Results with the text of their query beside them; broadcasting it is left to the planner, which knows its size."""
    return results.join(queries.select("query_id", F.col("text").alias("__query")), "query_id")


def cross_encoder(results: DataFrame, queries: DataFrame, scorer: models.PairScorer, top: int | None = None, id_col: str = "doc_id", text_col: str = "text", activate: bool = False) -> DataFrame:
    return models.pair_rerank(_texts(results, queries), scorer, "__query", text_col, top, id_col, activate).drop("__query")


def bm25(results: DataFrame, queries: DataFrame, top: int | None = None, id_col: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    return fusion.bm25_rerank(results, queries, k1, b, top, id_col)


def semantic(results: DataFrame, queries: DataFrame, top: int | None = None, id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    rows = results.join(queries.select("query_id", F.col(vector).alias("__vector")), "query_id")
    return models.semantic_rerank(rows, F.col("__vector"), F.col(vector), top, id_col).drop("__vector")


def late_interaction(results: DataFrame, queries: DataFrame, top: int | None = None, id_col: str = "doc_id", vectors: str = "token_vectors") -> DataFrame:
    rows = results.join(queries.select("query_id", F.col(vectors).alias("__vectors")), "query_id")
    scores = rows.select("query_id", id_col, F.round(models.max_sim(F.col("__vectors"), F.col(vectors)), 6).alias("score"))
    return fusion.rerank(results, scores, top, id_col)


def reranker(settings: Mapping[str, Any], scorers: Mapping[str, models.PairScorer] | None = None) -> Stage:
    """A reranker of a config: model_type, model_name, top_k, apply_sigmoid, stages or parts.

    Models come in as ``scorers`` by name; a config that names one that isn't
    there fails.  ``bge`` is a cross encoder whose scores go through a sigmoid.
    The ``multistage`` reranker keeps 10 and then 5 unless told otherwise; the
    ``ensemble`` sums its parts' normalised scores by their weights.
    """
    kind = settings.get("model_type")
    rest = {k: v for k, v in settings.items() if k not in ("model_type", "weight")}
    names = {"top_k": "top"}
    if kind in ("cross_encoder", "bge", "cohere"):
        name = rest.pop("model_name", "default")
        if name not in (scorers or {}):
            raise ValueError(f"no scorer {name!r}; there are {sorted(scorers or {})}")
        return _wrap(cross_encoder, names | {"apply_sigmoid": "activate"}, scorer=scorers[name], activate=kind == "bge")(**rest)
    if kind in ("bm25", "semantic", "colbert"):
        return _wrap({"bm25": bm25, "semantic": semantic, "colbert": late_interaction}[kind], names)(**rest)
    if kind == "multistage":
        parts = [reranker({**{"top_k": k}, **rest[name]}, scorers) for name, k in (("stage1", 10), ("stage2", 5))]
        return _chained(parts)
    if kind == "ensemble":
        parts = [(reranker({k: v for k, v in p.items() if k != "top_k"}, scorers), float(p.get("weight", 1.0))) for p in rest.get("rerankers", [])]
        if not parts:
            raise ValueError("an ensemble needs rerankers")
        return _ensemble(parts, rest.get("top_k"), rest.get("id_col", "doc_id"))
    raise ValueError(f"unknown reranker {kind!r}")


def _chained(stages: Sequence[Stage]) -> Stage:
    def run(queries: DataFrame, results: DataFrame, **options: Any) -> DataFrame:
        for i, stage in enumerate(stages):
            results = stage(queries, results.drop("original_score", "original_rank") if i else results, **options)
        return results

    run.needs_results = True
    return run


def _ensemble(parts: Sequence[tuple[Stage, float]], top: int | None, id_col: str) -> Stage:
    def run(queries: DataFrame, results: DataFrame, **options: Any) -> DataFrame:
        scores = [(stage(queries, results, **options).select("query_id", id_col, "score"), weight) for stage, weight in parts]
        return fusion.ensemble(results.withColumnRenamed("score", "original_score"), scores, options.get("top", top), id_col)

    run.needs_results = True
    return run


def _fall_through(results: DataFrame, criteria: Mapping[str, Any], lookup: Mapping[str, Column] | None = None) -> DataFrame:
    """The metadata filter; where there are label and metadata maps, each key is looked up in both."""
    if lookup is None and "labels" in results.columns:
        lookup = {k: ranking.label_or_metadata(results, k) for k in criteria}
    return ranking.metadata_filter(results, criteria, lookup)


def _enrich(results: DataFrame, queries: DataFrame, post_type: str = "post_type", source: str = "source") -> DataFrame:
    column = lambda name: F.col(name) if name in results.columns else F.lit(None).cast("string")
    return ranking.enrich_context(_texts(results, queries), F.col("__query"), column(post_type), column(source)).drop("__query")


#: Stage types of a config, all of them wired.
STAGE_TYPES: dict[str, Callable[..., Stage]] = {
    "score_filter": _wrap(ranking.score_filter, min_score=0.3),
    "duplicate_filter": _wrap(ranking.duplicate_filter, {"dedup_by": "by"}),
    "tag_filter": _wrap(ranking.tag_filter, {"required_tags": "required", "excluded_tags": "excluded"}),
    "metadata_filter": _wrap(_fall_through),
    "result_limiter": _wrap(ranking.limit_results, max_results=5),
    "answer_enhancer": _wrap(ranking.enhance_answers),
    "context_enricher": _wrap(_enrich),
}


def retriever_type(config: Mapping[str, Any]) -> str:
    """retrieval.type, else the embedding strategy, else hybrid if both sections exist, else dense."""
    named = config.get("retrieval", {}).get("type") or config.get("embedding", {}).get("strategy")
    both = {"dense", "sparse"} <= set(config.get("embedding", {}))
    return named or ("hybrid" if both else "dense")


def _retriever(kind: str, retrievers: Mapping[str, Stage]) -> Stage:
    if kind not in retrievers:
        raise ValueError(f"unknown retriever {kind!r}; there are {sorted(retrievers)}")
    return retrievers[kind]


def stage_of(stage: Mapping[str, Any], scorers: Mapping[str, models.PairScorer] | None = None, extra: Mapping[str, Callable[..., Stage]] | None = None) -> Stage:
    """A stage of a config entry {type, config}; an unknown type is an error."""
    kinds = STAGE_TYPES | dict(extra or {})
    if stage["type"] == "reranker" and "reranker" not in kinds:
        return reranker(stage.get("config", {}), scorers)
    if stage["type"] not in kinds:
        raise ValueError(f"unknown stage {stage['type']!r}; there are {sorted([*kinds, 'reranker'])}")
    return kinds[stage["type"]](**stage.get("config", {}))


def from_config(
    config: Mapping[str, Any], retrievers: Mapping[str, Stage], extra: Mapping[str, Callable[..., Stage]] | None = None, scorers: Mapping[str, models.PairScorer] | None = None
) -> RetrievalPipeline:
    """The retriever of the config's type and its stages ({type, config}).

    A ``retrieval_pipeline`` section names its retriever (dense by default) and
    stages; without it the ``retrieval`` section does, see :func:`retriever_type`.
    """
    section = config.get("retrieval_pipeline")
    kind = section.get("retriever", {}).get("type", "dense") if section else retriever_type(config)
    built = RetrievalPipeline(config=config).add("retriever", _retriever(kind, retrievers))
    for stage in (section or config.get("retrieval", {})).get("stages", []):
        built.add(stage["type"], stage_of(stage, scorers, extra))
    return built


def simple(kind: str, retrievers: Mapping[str, Stage], config: Mapping[str, Any] | None = None) -> RetrievalPipeline:
    """A pipeline of a retriever alone: dense, sparse, hybrid or semantic."""
    return RetrievalPipeline(config=config or {}).add("retriever", _retriever(kind, retrievers))


def reranked(config: Mapping[str, Any], retrievers: Mapping[str, Stage], scorer: models.PairScorer | None = None, **settings: Any) -> RetrievalPipeline:
    """Hybrid retrieval if the config has a sparse section, else dense; reranked if there is a model."""
    built = simple("hybrid" if config.get("embedding", {}).get("sparse") else "dense", retrievers, config)
    return built.add("reranker", reranker({"model_type": "cross_encoder", **settings}, {"default": scorer})) if scorer else built


def from_retriever_config(folder: str, kind: str, retrievers: Mapping[str, Stage], over: Mapping[str, Any] | None = None) -> RetrievalPipeline:
    """The retriever of the config file of that name in ``folder``, with ``over`` merged into it."""
    found = {name: path for name, _, path in list_configs(folder)}
    if kind not in found:
        raise ValueError(f"no config {kind!r}; there are {sorted(found)}")
    config = deep_merge(load(found[kind]), over or {})
    return simple(config.get("retriever", {}).get("type", kind), retrievers, config)


def from_unified_config(config: Mapping[str, Any], retrievers: Mapping[str, Stage], kind: str | None = None) -> RetrievalPipeline:
    """The retriever alone, of the given type or the one the config shows."""
    settings = dict(config.get("retrieval") or {"top_k": 10})
    for shared in ("embedding", "qdrant"):
        if shared in config:
            settings.setdefault(shared, config[shared])
    return simple(kind or retriever_type(config), retrievers, settings)


def list_configs(folder: str) -> list[tuple[str, str, str]]:
    """(name, description, path) of every JSON or YAML config of a folder, by name; one that can't be read says so."""
    out = []
    for path in sorted(p for end in ("json", "yml", "yaml") for p in glob.glob(os.path.join(folder, f"*.{end}"))):
        name = os.path.splitext(os.path.basename(path))[0]
        try:
            section = load(path).get("retrieval_pipeline", {})
            said = f"{section.get('retriever', {}).get('type', 'unknown')} retrieval with {len(section.get('stages', []))} stages"
        except (OSError, ValueError, RuntimeError, AttributeError) as wrong:
            said = f"can't be read: {wrong}"
        out.append((name, said, path))
    return sorted(out)


def switch_config(folder: str, name: str, to: str) -> None:
    """Make the named config the one in the JSON file ``to``; other keys of that file stay, an unknown name is an error."""
    found = {n: path for n, _, path in list_configs(folder)}
    if name not in found:
        raise ValueError(f"no config {name!r}; there are {sorted(found)}")
    before = load(to) if os.path.exists(to) else {}
    after = deep_merge(before, {"retrieval_config": name}) | {"retrieval_pipeline": load(found[name]).get("retrieval_pipeline", {})}
    with open(to, "w") as out:
        json.dump(after, out, indent=2, sort_keys=True)


def as_documents(results: DataFrame, text_col: str = "text") -> DataFrame:
    """query_id, rank, text and all else as one ``metadata`` struct: documents without their ranking."""
    rest = [c for c in results.columns if c not in ("query_id", "rank", text_col)]
    return results.select("query_id", "rank", F.col(text_col).alias("text"), F.struct(*rest).alias("metadata"))


def dense_retriever(corpus: DataFrame, id_col: str = "doc_id", vector_col: str = "embedding", payload: Sequence[str] = (), **defaults: Any) -> Stage:
    """Cosine search of ``corpus`` for queries with a vector; options k, min_score."""

    def run(queries: DataFrame, results: DataFrame | None, k: int = 10, min_score: float = 0.0, **_: Any) -> DataFrame:
        found = search.dense_top_k(corpus, queries, k, id_col=id_col, vector_col=vector_col, **defaults)
        return _with_payload(ranking.above(found, min_score), corpus, id_col, payload).withColumn("retrieval_method", F.lit("dense"))

    return run


def sparse_retriever(corpus: DataFrame, id_col: str = "doc_id", payload: Sequence[str] = (), **defaults: Any) -> Stage:
    """BM25 search of ``corpus`` for queries with a text; options k, min_score."""

    def run(queries: DataFrame, results: DataFrame | None, k: int = 10, min_score: float = 0.0, **_: Any) -> DataFrame:
        found = search.bm25_top_k(corpus, queries, k, id_col=id_col, **defaults)
        return _with_payload(ranking.above(found, min_score), corpus, id_col, payload).withColumn("retrieval_method", F.lit("sparse"))

    return run


def _with_payload(found: DataFrame, corpus: DataFrame, id_col: str, payload: Sequence[str]) -> DataFrame:
    return found.join(corpus.select(F.col(id_col), *payload), id_col) if payload else found


def hybrid_retriever(dense: Stage, sparse: Stage, alpha: float = 0.5, rrf_k: int = 60, method: str = "rrf", factor: int = 2, id_col: str = "doc_id", corpus: DataFrame | None = None, payload: Sequence[str] = ()) -> Stage:
    """Both retrievers at ``factor`` times the depth, fused by rank (rrf) or normalised score (weighted_sum)."""

    def run(queries: DataFrame, results: DataFrame | None, k: int = 10, min_score: float = 0.0, **options: Any) -> DataFrame:
        sides = [r(queries, None, k=factor * k, **options).select("query_id", id_col, "score", "rank") for r in (dense, sparse)]
        weight = options.get("alpha", alpha)
        if method == "rrf":
            fused = fusion.rrf(*sides, weight, options.get("rrf_k", rrf_k), k, id_col).drop("min_rank")
        else:
            fused = fusion.weighted_sum(*sides, weight, k, id_col)
        found = ranking.above(fused, min_score)
        return (_with_payload(found, corpus, id_col, payload) if corpus is not None else found).withColumn("retrieval_method", F.lit("hybrid"))

    return run


def semantic_retriever(retrievers: Mapping[str, Stage], id_col: str = "doc_id", weights: Mapping[str, float] | None = None, rules: Mapping[str, Sequence[str]] | None = None) -> Stage:
    """Each query to the strategies that its text calls for, their results merged."""

    def run(queries: DataFrame, results: DataFrame | None, k: int = 10, **options: Any) -> DataFrame:
        routed = queries.withColumn("__strategies", search.route(F.col("text"), list(retrievers), rules))
        found = []
        for name, retriever in retrievers.items():
            mine = routed.where(F.array_contains("__strategies", name)).drop("__strategies")
            found.append((name, retriever(mine, None, k=k, **options)))
        return fusion.merge_strategies(found, weights or {}, k, id_col).withColumn("retrieval_method", F.lit("semantic"))

    return run
