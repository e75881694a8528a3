"""Agent steps over whole batches; models come in as functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.llm_json import extract_json, verdict

#: (question, context, attempt, feedback) -> answer, as columns
Generator = Callable[[Column, Column, Column, Column], Column]
#: (question, context, answer) -> the verifier's raw answer
Verifier = Callable[[Column, Column, Column], Column]


def query_type(analysis: Column) -> Column:
    """technical, clarification or general, by what the analysis says."""
    text = F.lower(analysis)
    return F.when(text.contains("technical"), "technical").when(text.contains("clarification"), "clarification").otherwise("general")


def remember(history: Column, *entries: Column, keep: int = 20) -> Column:
    """The history with new entries, cut to the last ``keep``."""
    grown = F.concat(F.coalesce(history, F.array().cast("array<string>")), F.array(*entries)) if entries else history
    return F.slice(grown, F.greatest(F.lit(1), F.size(grown) - keep + 1), keep)


def memory_tail(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", text: str = "text", keep: int = 20) -> DataFrame:
    """The last ``keep`` turns of each conversation: n_kept and their joined text.

    Only numbers are gathered per conversation first; the texts that stay are
    at most ``keep`` per conversation.
    """
    from millrace.operators.ranking import top_k

    last = top_k(turns, keep, [F.desc(order)], conversation)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda r: r["t"]), "\n")
    return last.groupBy(conversation).agg(F.count(F.lit(1)).alias("n_kept"), joined.alias("memory"))


def self_rag(states: DataFrame, generate: Generator, verify: Verifier, max_iterations: int = 3) -> DataFrame:
    """Generate, verify and revise each state (question, context) until it holds.

    A state stops when its answer is faithful, in the last iteration, or when
    the verifier is over 0.8 confident of a minor flaw.  The iterations are a
    fixed number of projections on the same rows, so the batch never moves, and
    neither model is asked again about a state that has stopped.  Adds answer,
    verification, iterations, history (iteration, answer, verification, action),
    converged and corrected (faithful in the end after a hallucination before).
    """
    none = F.lit(None)
    rows = states.withColumns({"answer": none.cast("string"), "verification": verdict(F.lit("")), "iterations": F.lit(0), "__done": F.lit(False), "__seen": F.lit(False)})
    for i in range(1, max_iterations + 1):
        feedback = F.when(F.lit(i > 1), F.array_join("verification.issues", "; ")).otherwise("")
        rows = rows.withColumn("__try", F.when(~F.col("__done"), generate(F.col("question"), F.col("context"), F.lit(i), feedback)))
        open_ = ~F.col("__done")
        rows = rows.withColumn("__v", F.when(open_, verdict(verify(F.col("question"), F.col("context"), F.col("__try")))))
        v = F.col("__v")
        stop = v["is_faithful"] | ((v["confidence"] > 0.8) & (v["severity"] == "minor"))
        step = F.struct(F.lit(i).alias("iteration"), F.col("__try").alias("answer"), v.alias("verification"), F.lit("initial" if i == 1 else "revision").alias("action"))
        rows = rows.withColumns(
            {
                "answer": F.when(open_, F.col("__try")).otherwise(F.col("answer")),
                "verification": F.when(open_, v).otherwise(F.col("verification")),
                "iterations": F.when(open_, F.lit(i)).otherwise(F.col("iterations")),
                "history": F.when(open_, F.concat("history", F.array(step)) if i > 1 else F.array(step)).otherwise(F.col("history") if i > 1 else F.array(step)),
                "__seen": F.col("__seen") | (open_ & F.coalesce(v["hallucination_detected"], F.lit(False))),
                "__done": F.col("__done") | F.coalesce(stop, F.lit(False)),
            }
        ).drop("__try", "__v")
    faithful = F.col("verification.is_faithful")
    return rows.withColumns({"converged": faithful, "corrected": faithful & F.col("__seen")}).drop("__done", "__seen")


def retrieve(states: DataFrame, pipeline, k: int = 10, text: str = "text", context: str = "context") -> DataFrame:
    """Context of the states (query_id, text, context) that have none yet, from the pipeline's ``k`` results.

    Adds num_results, retrieval_method and top_result_score, null for states
    whose context was given.  A state without results has an empty context.
    """
    from millrace.operators.ranking import assemble_context

    given = F.coalesce(F.col(context), F.lit("")) != ""
    results = pipeline.run(states.where(~given).drop(context), k=k)
    told = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_results"), F.max_by("retrieval_method", -F.col("rank")).alias("retrieval_method"), F.max_by("score", -F.col("rank")).alias("top_result_score"))
    found = assemble_context(results, text).withColumnRenamed("context", "__found").join(told, "query_id")
    joined = states.join(found, "query_id", "left")
    return joined.select(
        *(c for c in states.columns if c != context),
        F.when(given, F.col(context)).otherwise(F.coalesce("__found", F.lit(""))).alias(context),
        F.when(~given, F.coalesce("num_results", F.lit(0).cast("long"))).alias("num_results"),
        F.when(~given, F.coalesce("retrieval_method", F.lit("none"))).alias("retrieval_method"),
        F.when(~given, F.coalesce("top_result_score", F.lit(0.0))).alias("top_result_score"),
    )


#: What a generator is told, by style; the placeholders are columns.
PROMPTS = {
    "strict": "Use the context alone. Say so if it doesn't hold the answer.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:",
    "guided": "The question was read as: {analysis}\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer in steps, naming the part of the context that each rests on:",
    "open": "Context, if it helps:\n{context}\n\nQuestion: {question}\nAnswer:",
}


def prompt(style: str, question: Column, context: Column, analysis: Column | None = None) -> Column:
    """The prompt of a style; without context it says so."""
    if style not in PROMPTS:
        raise ValueError(f"unknown style {style!r}; there are {sorted(PROMPTS)}")
    named = {"question": question, "context": F.when(F.coalesce(context, F.lit("")) == "", "No context available").otherwise(context), "analysis": F.lit("") if analysis is None else analysis}
    parts = re.split(r"\{(\w+)\}", PROMPTS[style])
    return F.concat(*(F.coalesce(named[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def answers(model: Callable[[list[str]], list[str]], prompts: Column) -> Column:
    """What a model (texts -> texts, in batches) says to prompts; null prompts are not put to it."""

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        asked = texts.notna()
        if asked.any():
            out[asked] = model(texts[asked].tolist())
        return out

    return ask(prompts)


def verified(states: DataFrame, verify: Verifier) -> DataFrame:
    """Adds ``verification``: the verifier's judgement of each answer (question, context, answer), parsed, with cautious defaults."""
    return states.withColumn("verification", verdict(verify(F.col("question"), F.col("context"), F.col("answer"))))


def routing(reply: Column) -> Column:
    """(needs_retrieval, routing_decision, next_node) of a router's reply; without one retrieval is the safe way."""
    decision = F.coalesce(F.upper(F.trim(reply)), F.lit("RETRIEVE (fallback)"))
    needed = decision.contains("RETRIEVE")
    return F.struct(needed.alias("needs_retrieval"), decision.alias("routing_decision"), F.when(needed, "retriever").otherwise("generator").alias("next_node"))


def interpretation(reply: Column) -> Column:
    """(query_type, next_node, plan, reasoning) of an interpreter's JSON; a direct answer where it can't be read."""
    read = F.from_json(extract_json(reply), "query_type string, next_node string, plan array<string>, reasoning string")
    ok = read["query_type"].isNotNull() & read["next_node"].isNotNull()
    return F.struct(
        F.when(ok, read["query_type"]).otherwise("none").alias("query_type"),
        F.when(ok, read["next_node"]).otherwise("generator").alias("next_node"),
        F.when(ok, F.coalesce(read["plan"], F.array().cast("array<string>"))).otherwise(F.array(F.lit("Answer directly."))).alias("plan"),
        F.when(ok, F.coalesce(read["reasoning"], F.lit(""))).otherwise("The reply could not be read.").alias("reasoning"),
    )


SCORES = ("faithfulness", "relevance", "helpfulness")


def judge(rows: DataFrame, model: Callable[[str, str, str | None, int], str], retries: int = 3, scores: Sequence[str] = SCORES, least: int = 1, most: int = 5, batch: int | None = None) -> DataFrame:
    """question, the scores, justification, answer, has_context, attempts of rows (question, answer, context).

    ``model`` (question, answer, context, attempt) replies with JSON.  A reply
    that isn't, that lacks a score or has one out of range is asked for again;
    after ``retries`` failures the scores are 0 and the justification tells the
    last failure.  With ``batch``, the model gets lists of up to so many
    questions, answers and contexts and replies with a list; only rows without
    a good reply are asked for again, together.  A call that fails, or replies
    with another number, is a failure of all its rows.
    """

    def read(reply: str) -> dict:
        found = json.loads(reply)
        for name in scores:
            if not isinstance(found.get(name), (int, float)) or not least <= found[name] <= most:
                raise ValueError(f"{name} is {found.get(name)!r}, not {least} to {most}")
        return found

    def ask(asked: list[tuple], rows: list[int], attempt: int) -> list[tuple[int, str | Exception]]:
        try:
            if batch is None:
                return [(i, model(asked[i][0] or "", asked[i][1] or "", asked[i][2], attempt)) for i in rows]
            replies = model([asked[i][0] or "" for i in rows], [asked[i][1] or "" for i in rows], [asked[i][2] for i in rows], attempt)
            if len(replies) != len(rows):
                raise ValueError(f"{len(replies)} replies to {len(rows)} rows")
            return list(zip(rows, replies))
        except Exception as failed:
            return [(i, failed) for i in rows]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            asked = list(zip(pdf["question"], pdf["answer"], pdf["context"]))
            told: list[tuple[dict, str, int]] = [({}, "", 0)] * len(asked)
            open_ = list(range(len(asked)))
            for attempt in range(1, retries + 1):
                for replies in (ask(asked, open_[i : i + (batch or 1)], attempt) for i in range(0, len(open_), batch or 1)):
                    for i, reply in replies:
                        try:
                            if isinstance(reply, Exception):
                                raise reply
                            told[i] = (read(reply), "", attempt)
                        except Exception as failed:  # a model may fail in any way; the last failure is told
                            told[i] = ({}, f"failed {retries} times: {str(failed)[:100]}", attempt)
                open_ = [i for i in open_ if told[i][1]]
            out = [[q, *(int(found.get(s, 0)) for s in scores), str(found.get("justification", wrong)), a, bool(c), attempt] for (q, a, c), (found, wrong, attempt) in zip(asked, told)]
            yield pd.DataFrame(out, columns=["question", *scores, "justification", "answer", "has_context", "attempts"])

    return rows.select("question", "answer", "context").mapInPandas(run, "question string, " + ", ".join(f"{s} int" for s in scores) + ", justification string, answer string, has_context boolean, attempts int")


def self_rag_stats(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("iterations"), 6).alias("avg_iterations"),
        F.count_if("converged").alias("converged"),
        F.count_if("corrected").alias("corrected"),
    )
