"""JSON objects in the answers of language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_json(answer: Column) -> Column:
    """The JSON text of an answer: fenced as json, fenced, the whole answer, or its first flat braces; null if none parses."""
    candidates = (
        F.regexp_extract(answer, r"(?s)```json\s*(.*?)\s*```", 1),
        F.regexp_extract(answer, r"(?s)```\s*(.*?)\s*```", 1),
        F.trim(answer),
        F.regexp_extract(answer, r"\{[^}]+\}", 0),
    )
    parsed = F.filter(F.array(*candidates), lambda c: c.startswith("{") & F.try_parse_json(c).isNotNull())
    return F.try_element_at(parsed, F.lit(1))


def verdict(answer: Column) -> Column:
    """A verifier's answer as a struct; what is missing gets the cautious default."""
    schema = "is_faithful boolean, hallucination_detected boolean, confidence double, severity string, issues array<string>, recommendation string, reasoning string"

    def filled(read: Column) -> Column:
        return F.struct(
            F.coalesce(read["is_faithful"], F.lit(False)).alias("is_faithful"),
            F.coalesce(read["hallucination_detected"], F.lit(True)).alias("hallucination_detected"),
            F.coalesce(read["confidence"], F.lit(0.5)).alias("confidence"),
            F.coalesce(read["severity"], F.lit("moderate")).alias("severity"),
            F.coalesce(read["issues"], F.array().cast("array<string>")).alias("issues"),
            F.coalesce(read["recommendation"], F.lit("revise")).alias("recommendation"),
            F.coalesce(read["reasoning"], F.lit("")).alias("reasoning"),
        )

    # through an array of one, so that the answer is parsed once and not again for every field that is used
    return F.transform(F.array(F.from_json(extract_json(answer), schema)), filled)[0]
