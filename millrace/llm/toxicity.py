"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding takes letters apart from their marks, lowers case, maps look-alike
letters and digit substitutions to one letter each and turns everything else
into single spaces, so that ``1D10T``, ``ídiot`` and ``idiot`` meet.  The
lexicon holds whole words of any length and word beginnings with log-odds
weights learned from labelled rows; hits inside exception phrases don't count.
The weighted hits of the whole text, normalised by its length, go through a
small logistic model.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize
from millrace.llm.words import pieces, valid

# Characters that stand for another letter.  l and i fold together since 1, ! and | stand for both.
LOOKALIKES = {
    "a": "@4аαᴀ",
    "b": "8вʙ",
    "c": "¢сϲᴄ",
    "d": "ԁᴅ",
    "e": "3€еεᴇ",
    "g": "9ɡ",
    "h": "һн",
    "i": "1!|lіιıɩӏ",
    "j": "ј",
    "k": "кκ",
    "m": "мᴍ",
    "n": "пηɴ",
    "o": "0оοσᴏ",
    "p": "рρ",
    "s": "5$ѕ",
    "t": "7+тτ",
    "u": "υᴜ",
    "v": "ѵν",
    "w": "ԝѡ",
    "x": "хχ×",
    "y": "уγ",
    "z": "2ᴢ",
}

# Mild insults used where there are no labels to learn from.
SEED_LEXICON = ("idiot", "moron", "stupid", "imbecile", "scum", "loser", "worthless", "pathetic", "disgusting", "vermin", "dumbass", "retard")

# Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "pond scum", "soap scum", "idiot proof", "sore loser", "stupid question")

_INVISIBLE = "­​‌‍⁠﻿"


class _Fold(dict):
    """Translation table filled on demand: one entry per character met."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:
            c = chr(code - 0xFEE0).lower()
        found = _SUBSTITUTES.get(c, None if c in _INVISIBLE or unicodedata.combining(c) else c if c.isalpha() or unicodedata.category(c)[0] == "M" else " ")
        self[code] = found
        return found


_SUBSTITUTES = {x: letter for letter, others in LOOKALIKES.items() for x in others}
_FOLD = _Fold()
# ! + | stand for letters only inside a word; elsewhere they are punctuation
_EDGE = {"!": " ", "|": " ", "+": " "}


def fold(text: str) -> str:
    """Folded words with one space before each and after the last; one space if there is none."""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).lower()
    for mark in _EDGE:
        if mark in text:
            text = _outside(text, mark)
    words = text.translate(_FOLD).split()
    return f" {' '.join(words)} " if words else " "


def _outside(text: str, mark: str) -> str:
    parts = text.split(mark)
    out = [parts[0]]
    for before, after in zip(parts, parts[1:]):
        inside = before[-1:].isalnum() and after[:1].isalnum()
        out += [mark if inside else " ", after]
    return "".join(out)


def lexicon_counts(text: str, shortest: int = 4, longest: int = 8) -> set[str]:
    """Candidate entries of a text: its words, whatever their length, and their beginnings of ``shortest`` to ``longest`` letters.

    A whole word ends with a space, a beginning (which words of another ending
    share) doesn't.
    """
    out = set()
    for word in set(fold(text).split()):
        out.add(f" {word} ")
        out.update([f" {word[:k]}" for k in range(shortest, min(longest, len(word)) + 1)])
    return out


@dataclass
class Model:
    weights: dict[str, float]
    coefficients: list[float]  # bias, then one per feature
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(entry := fold(phrase), (len(entry), None))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) on the folded text: the longest entry at each place, exceptions taken out."""
        if not self.weights and not self.exceptions:
            return []
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for last, (length, weight) in self.automaton().iter(folded):
            start = last + 1 - length
            if weight is None:
                spared.append((start, last + 1))
            elif start not in best or best[start][0] < last + 1:
                best[start] = (last + 1, weight)
        if not spared:
            return [(a, b, w) for a, (b, w) in best.items()]
        # of the spared spans that begin at a place or before it the farthest end tells whether one holds the hit
        spared.sort()
        begins, farthest = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
        return [(a, b, w) for a, (b, w) in best.items() if not (i := bisect_right(begins, a)) or farthest[i - 1] < b]

    def features(self, text: str) -> list[float]:
        folded = fold(text)
        n_words = folded.count(" ") - 1
        found = self.hits(folded)
        total = sum(w for _, _, w in found)
        return [
            math.log1p(total),
            math.log1p(100 * total / max(n_words, 1)),
            math.log1p(len({folded[a:b] for a, b, _ in found})),
            math.log1p(total / math.sqrt(max(n_words, 1))),
        ]

    def score(self, text: str) -> float:
        x = self.coefficients[0] + sum(c * v for c, v in zip(self.coefficients[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


#: An entry has to be in so many toxic rows to be learned.
LEAST = 4


def select_lexicon(counts: Iterable[tuple[str, int, int]], n_toxic: int, n_clean: int, least: int = LEAST, margin: float = 1.5) -> dict[str, float]:
    """Entries in at least ``least`` toxic rows whose log-odds, less one standard error, reach ``margin``.

    The best-supported come first, beginnings before whole words of the same
    support; an entry that begins with one already taken adds nothing and is
    left out.
    """
    ranked = []
    for entry, toxic, clean in counts:
        odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        if toxic >= least and odds - math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)) >= margin:
            ranked.append((odds * math.sqrt(toxic), entry, odds))
    taken: dict[str, float] = {}
    for _, entry, odds in sorted(ranked, key=lambda r: (-r[0], r[1])):
        if not any(entry[:k] in taken for k in range(2, len(entry))):
            taken[entry] = min(odds, 6.0)
    return taken


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> list[float]:
    """Bias and coefficients by Newton's method on the ridge-penalised likelihood."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


#: Used where labels of both kinds are missing: about three hits in a hundred words reach 0.7.
UNTRAINED = Model({f" {fold(w).strip()}": 3.0 for w in SEED_LEXICON}, [-3.0, 0.5, 0.9, 0.5, 0.5])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 12_000,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """Learn lexicon and logistic model from about ``sample_rows`` labelled rows.

    The sample is bounded: rows whose id hashes low enough, all of them if
    there are no more.  Entries are counted on the executors; the driver gets
    those in at least ``LEAST`` toxic rows of the sample that are four times as
    frequent among toxic rows.  The logistic
    model is fitted to one half of the sample with a lexicon of the other half,
    so that entries that are toxic by chance aren't taken at face value; the
    lexicon that is kept comes from both.  An id with several labels is
    toxic if one says so; null labels are left out.  Without labels of both
    kinds the untrained model is returned.  Other columns of ``docs`` are not
    read, whatever their names.  A weight is at most 6, log-odds of 400 to 1.
    """
    labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    scale = 1 << 30
    total = labels.count()
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity")), F.lit(scale))
    # bounded by sample_rows, so it can go to every executor and the texts stay where they are
    chosen = labels.where(place < int(scale * min(1.0, sample_rows / max(total, 1)))).select(
        F.col(id_col).alias("__id"), (F.col("toxic") > 0).alias("toxic"), (F.pmod(F.xxhash64(F.col(id_col), F.lit("half")), F.lit(2)) == 0).alias("learns")
    )
    texts = docs.select(F.col(id_col).alias("__of"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))  # other columns may have any name
    rows = texts.join(F.broadcast(chosen), F.col("__of") == F.col("__id")).select("toxic", "learns", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {key: Counter() for key in names.values()}
            for toxic, learns, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts[toxic, learns].update(lexicon_counts(text))
                counts[toxic, learns][""] += 1
                if sum(map(len, counts.values())) > 200_000:  # what a worker holds is bounded
                    yield table_of(counts)
                    counts = {key: Counter() for key in names.values()}
            yield table_of(counts)

    def table_of(counts: dict[tuple[bool, bool], Counter]) -> pa.RecordBatch:
        entries = list({}.fromkeys(e for c in counts.values() for e in c))
        columns = {name: pa.array([counts[key][e] for e in entries], pa.int64()) for name, key in names.items()}
        return pa.RecordBatch.from_pydict({"entry": pa.array(entries, pa.string())} | columns)

    names = {"toxic_a": (True, True), "clean_a": (False, True), "toxic_b": (True, False), "clean_b": (False, False)}
    counted = materialize(
        rows.mapInArrow(count, "entry string, " + ", ".join(f"{n} bigint" for n in names))
        .groupBy("entry")
        .agg(*(F.sum(n).alias(n) for n in names))
        .where(f"toxic_a + toxic_b >= {LEAST} OR entry = ''"),
        "toxicity-counts",
    )
    totals = counted.where("entry = ''").first()
    toxic_a, clean_a, toxic_b, clean_b = (totals[n] for n in names) if totals else (0, 0, 0, 0)
    if not toxic_a + toxic_b or not clean_a + clean_b:
        return UNTRAINED
    # what can reach the margin in the whole sample or in its half: four times as frequent among toxic rows
    likely = lambda toxic, clean, n_toxic, n_clean: f"({toxic} + 0.5D) * {n_clean + 1} >= 4 * ({clean} + 0.5D) * {n_toxic + 1}"
    both = likely("toxic_a + toxic_b", "clean_a + clean_b", toxic_a + toxic_b, clean_a + clean_b)
    kept = counted.where(f"entry <> '' AND ({both} OR {likely('toxic_a', 'clean_a', toxic_a, clean_a)})")
    counts = {r["entry"]: (r["toxic_a"], r["clean_a"], r["toxic_b"], r["clean_b"]) for r in kept.collect()}
    whole = select_lexicon(((e, c[0] + c[2], c[1] + c[3]) for e, c in counts.items()), toxic_a + toxic_b, clean_a + clean_b)
    half = select_lexicon(((e, c[0], c[1]) for e, c in counts.items()), toxic_a, clean_a)
    model = Model(half, [0.0] * 5, exceptions)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(0), "x": pa.array(found, pa.list_(pa.float64()))})

    seen = rows.where("NOT learns").select("toxic", "text").mapInArrow(measure, "toxic boolean, x array<double>").collect()
    if len({r["toxic"] for r in seen}) < 2:
        return Model(whole, UNTRAINED.coefficients, exceptions)
    # in a fixed order, so that the fit doesn't depend on how rows were dealt
    seen.sort(key=lambda r: (r["toxic"], r["x"]))
    return Model(whole, fit_logistic(np.array([r["x"] for r in seen]), np.array([float(r["toxic"]) for r in seen])), exceptions)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted (1 if score >= threshold).

    The whole text is scored; null and empty texts have no hits and the score
    of a text without any.  Bytes that are not UTF-8 count as U+FFFD.  Rows
    that repeat are scored alike, an empty table gives no rows, and other
    columns of ``docs`` are not read.  Nothing is shuffled.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1)):
                texts = [valid(t)[0] for t in texts]
                scores = [shipped.value.score(t) for t in texts]
                yield pa.RecordBatch.from_pydict(
                    {id_col: batch.column(0).slice(at, len(texts)), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())}
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rate, f"`{id_col}` {id_type}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs``, all columns, that score below ``threshold``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(batch.schema.names.index(text_col))):
                clean = [shipped.value.score(valid(t)[0]) < threshold for t in texts]
                yield batch.slice(at, len(texts)).filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
