"""Token counts by offset-mapped attribution.

A whole document is encoded once.  The tokens' character spans are joined with
section intervals by binary search, and a token that crosses a section boundary
is allocated by an explicit rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import pieces, valid

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "middle", "proportional")
# Fixed value: the pattern's white space.  The pattern looks ahead from every character of such a run, which long runs don't allow.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")


@dataclass
class Encoding:
    """A byte-level BPE vocabulary; ships as its ranks and is built once per worker."""

    ranks: dict[bytes, int]
    pattern: str = PATTERN

    @classmethod
    def load(cls, path: str = VOCABULARY, pattern: str = PATTERN) -> Encoding:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def __getstate__(self) -> tuple:
        return self.ranks, self.pattern

    def __setstate__(self, state: tuple) -> None:
        self.ranks, self.pattern = state

    def encoder(self):
        if not hasattr(self, "_built"):
            import tiktoken

            self._built = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
            self._whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
            self._lengths = np.zeros(max(self.ranks.values(), default=0) + 1, np.int64)
            for token, rank in self.ranks.items():
                self._lengths[rank] = len(token)
        return self._built

    def ids(self, text: str) -> list[int]:
        """The tokens of the whole text.

        The pattern takes a run of white space up to its last character, which
        belongs to what follows; at the end of the text it takes all of it.
        Long runs are cut out just so and merged as the one piece they are.
        """
        encode, out, at = self.encoder().encode_ordinary, [], 0
        for run in _LONG_SPACE.finditer(text) if self.pattern == PATTERN else ():
            end = run.end() - (run.end() < len(text))
            out += encode(text[at : run.start()])
            out += self._whole.encode_ordinary(text[run.start() : end])
            at = end
        return out + encode(text[at:]) if at else encode(text)

    def spans(self, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first character, one past the last character) of every token of the whole text.

        Tokens are runs of bytes; one that holds part of a character counts
        from that character's place.
        """
        ids = np.array(self.ids(text), np.int64)
        ends = np.cumsum(self._lengths[ids])
        starts = ends - self._lengths[ids]
        if len(text) == len(raw):
            return starts, ends
        place = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        return place[starts], place[ends - 1] + 1


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections of a plain text: its lines, each with its line feed; none for an empty text."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return np.array(cuts[:-1], np.int64), np.array(cuts[1:], np.int64)


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [start, end), given the tokens' character spans [first, last).

    ``start``, ``end`` and ``middle`` give a token whole to every section that
    holds its first, last or middle character (the earlier of two);
    ``proportional`` gives each section the share of its characters.
    """
    if rule == "proportional":
        length = max(int(last.max(initial=0)), int(ends.max(initial=0)))
        share = np.zeros(length + 1)
        # a token's weight spread evenly over its characters, as a running sum
        width = last - first
        np.add.at(share, first, 1 / width)
        np.add.at(share, last, -1 / width)
        upto = np.concatenate([[0.0], np.cumsum(np.cumsum(share))])
        return upto[ends] - upto[starts]
    at = {"start": first, "end": last - 1, "middle": (first + last - 1) // 2}[rule]
    at = np.sort(at)
    return (np.searchsorted(at, ends) - np.searchsorted(at, starts)).astype(np.float64)


def outside(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> float:
    """Tokens that no section holds."""
    order = np.argsort(starts, kind="stable")
    merged: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        elif b > a:
            merged.append([a, b])
    spans = np.array(merged, np.int64).reshape(-1, 2)
    return float(len(first) - allocate(first, last, spans[:, 0], spans[:, 1], rule).sum())


def attribute(
    docs: DataFrame,
    encoding: Encoding,
    rule: str = "start",
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
) -> DataFrame:
    """One row per section of each document: id, section, start, end, n_tokens, n_crossing.

    ``sections_col`` names an ``array<struct<start:int,end:int>>`` of character
    intervals [start, end), in any order, which may overlap or leave gaps and
    are cut to the text; without it the sections are the text's lines, each
    with its line feed.  ``n_crossing`` are the tokens with a character in the
    section and one outside.  Tokens of a document that no section holds are a
    row with section -1, so the lines' counts and, where sections don't
    overlap, any sections' counts add up to the document's.  A null or empty
    text has no token, and no row unless it has given sections.  Bytes that are
    not UTF-8 count as U+FFFD.  Other columns of ``docs`` are not read, whatever
    their names.

    The text is encoded once, whole, where it lies; nothing is shuffled.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shipped = docs.sparkSession.sparkContext.broadcast(encoding)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1)):
                given = batch.column(2).slice(at, len(texts)).to_pylist() if sections_col else [None] * len(texts)
                rows, columns = [], []
                for i, (raw, sections) in enumerate(zip(texts, given)):
                    text, raw = valid(raw)
                    first, last = shipped.value.spans(text, raw)
                    if sections_col:
                        limits = [(min(max(s["start"], 0), len(text)), min(max(s["end"], s["start"], 0), len(text))) for s in sections or () if s and s["start"] is not None and s["end"] is not None]
                        starts, ends = np.array(limits, np.int64).reshape(-1, 2).T
                    else:
                        starts, ends = lines(text)
                    counts = allocate(first, last, starts, ends, rule)
                    touching = np.searchsorted(first, ends) - np.searchsorted(last, starts, "right")
                    # tokens are in order and don't overlap, but for bytes of one character
                    inside = np.searchsorted(last, ends, "right") - np.searchsorted(first, starts)
                    crossing = np.maximum(touching - np.maximum(inside, 0), 0)
                    number = np.arange(len(starts))
                    rest = outside(first, last, starts, ends, rule) if sections_col else 0.0
                    if rest > 1e-9:
                        number, starts, ends = np.append(number, -1), np.append(starts, 0), np.append(ends, len(text))
                        counts, crossing = np.append(counts, rest), np.append(crossing, 0)
                    rows.append(np.full(len(number), at + i))
                    columns.append((number, starts, ends, counts, crossing))
                number, starts, ends, counts, crossing = (np.concatenate(c) for c in zip(*columns))
                yield pa.RecordBatch.from_pydict(
                    {
                        id_col: batch.column(0).take(pa.array(np.concatenate(rows))),
                        "section": pa.array(number.astype(np.int32)),
                        "start": pa.array(starts.astype(np.int32)),
                        "end": pa.array(ends.astype(np.int32)),
                        "n_tokens": pa.array(counts),
                        "n_crossing": pa.array(crossing.astype(np.int32)),
                    }
                )

    schema = f"`{id_col}` {id_type}, section int, start int, end int, n_tokens double, n_crossing int"
    chosen = [F.col(id_col), F.col(text_col)] + ([F.col(sections_col)] if sections_col else [])
    return docs.select(*chosen).mapInArrow(run, schema)
