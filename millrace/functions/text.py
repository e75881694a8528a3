"""Text functions as Column expressions (JVM-side but for the character count)."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entities in the order in which they are decoded (&amp;lt; becomes <).
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))

# Words that mark English text.
ENGLISH_WORDS = ("the", "and", "to", "of", "a", "in", "is", "it", "you", "that", "he", "was", "for", "on", "are", "as", "with", "his", "they", "i")

# Fixed value: every character outside this class makes a text invalid.
INVALID_CHARACTER = r"""[^a-zA-Z0-9 .,!?;:()\[\]{}"'\-\n\t<>/&=#@%*+_|\\`~$^]"""

# Patterns that tell code and tables.
CODE_PATTERNS = (
    r"(?m)```\w*\n",
    r"(?m)def \w+\s*\(",
    r"(?m)function \w+\s*\(",
    r"(?m)class \w+\s*[\(\{:]",
    r"(?m)(import|from)\s+\w+.*\n\s*(import|from)",
    r"(?m)\{\s*\n.*\n\s*\}",
)
CLASS_CONTEXT = (r"(?mi)class \w+\s*:", r"(?mi)class \w+\s*\(", r"(?mi)class \w+.*extends", r"(?mi)class \w+.*implements", r"(?mi)(public|private)\s+class")
TABLE_PATTERNS = (r"(?m)\|.*\|.*\|", r"(?m)\t.*\t.*\t", r"┌─+┬─+┐", r"<table>")
FACTORY_CODE_PATTERNS = ("```", r"def \w+\(", r"function \w+\(", r"class \w+")
FACTORY_TABLE_PATTERNS = (r"(?m)\|.*\|.*\|", r"(?m)\t.*\t.*\t")


def normalize_text(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)


def doc_id(source: Column, external_id: Column, digest: Column) -> Column:
    return F.concat_ws(":", source, external_id, F.substring(digest, 1, 12))


def chunk_id(document: Column, index: Column) -> Column:
    return F.format_string("%s#c%04d", document, index)


def uuid_of(c: Column) -> Column:
    """A UUID string from the first 16 bytes of the SHA-256."""
    return F.regexp_replace(F.substring(F.sha2(c, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def cache_key(text: Column, kind: Column, model: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", text, kind, model), 256), 1, 16)


def strip_html(c: Column) -> Column:
    """Tags become spaces, then the six entities are decoded in order."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, character in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(character))
    return c


def clean_text(c: Column, html: bool = True) -> Column:
    return normalize_text(strip_html(c) if html else c)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), 0)


def english_ratio(c: Column) -> Column:
    """Share of marker words among the words; 0.0 without words."""
    found = words(c)
    marked = F.filter(found, lambda w: w.isin(*ENGLISH_WORDS))
    return F.when(F.size(found) > 0, F.size(marked) / F.size(found)).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def max_char_ratio(texts: pd.Series) -> pd.Series:
    """Share of the most frequent character; 0.0 for an empty text.

    Counting characters with array functions makes an array element of each
    and takes some thirty times as long as one pass in C per text.
    """
    return texts.map(lambda t: max(Counter(t).values()) / len(t) if t else 0.0)


def invalid_characters(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(INVALID_CHARACTER), 0))


def suspicious(c: Column) -> Column:
    """Which of the three suspicious patterns a text has, as an array of names."""
    return F.array_compact(
        F.array(
            F.when(c.rlike("(?i)lorem ipsum"), "placeholder"),
            F.when(c.rlike(r"\A.{0,10}\n?\Z"), "too short"),
            F.when(c.rlike(r"\A(.)\1{50,}"), "repeated"),
        )
    )


def long_lines(c: Column, limit: int = 1000, most: int = 5) -> Column:
    """Positions of the first lines of more than ``limit`` characters."""
    lines = F.split(c, "\n")
    at = F.transform(lines, lambda line, i: F.when(F.length(line) > limit, i))
    return F.slice(F.array_compact(at), 1, most)


def sentences(c: Column) -> Column:
    """Sentences end at . ! or ? before white space; trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return found


def has_code(c: Column) -> Column:
    """Obvious code, or the word "class" in a context that is code."""
    lines = F.filter(F.split(c, "\n"), lambda line: line.rlike(r"(?i)\bclass\s+\w+"))
    in_code = F.exists(lines, lambda line: line.rlike(r"[{}();]|def |import |function "))
    return _any(c, CODE_PATTERNS) | (c.rlike(r"(?i)\bclass\s+\w+") & (_any(c, CLASS_CONTEXT) | (F.size(lines) > 1) | in_code))


def has_table(c: Column) -> Column:
    return _any(c, TABLE_PATTERNS)


def content_strategy(c: Column, use_semantic: bool = False) -> Column:
    """The chunking strategy that suits a text."""
    return (
        F.when(_any(c, FACTORY_CODE_PATTERNS), "code_aware")
        .when(_any(c, FACTORY_TABLE_PATTERNS), "table_aware")
        .otherwise("semantic" if use_semantic else "recursive")
    )


def leakage_risk(c: Column) -> Column:
    """HIGH if a text has both a question and an answer marker, LOW for one, else NONE."""
    text = F.upper(c)
    question, answer = text.contains("Q:"), text.contains("ANSWER:")
    return F.when(question & answer, "HIGH").when(question | answer, "LOW").otherwise("NONE")


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
