"""SentencePiece encoding and decoding with N-best segmentation.

A text's segmentations are the paths of its piece lattice.  A forward Viterbi
pass gives the best score of every prefix; these are exact heuristics for an A*
search backward from the end, which therefore meets complete paths in order of
their score.  A lattice falls apart wherever no piece can span two characters,
so the parts of a text (mostly words) are searched alone and their N-best lists
are combined.
"""

from __future__ import annotations

import heapq
import operator
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import pieces as runs_of_texts
from millrace.llm.words import valid

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Parts of a generation of the cache; a part takes about 300 bytes.
_CACHED = 400_000
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
#: Scores at or below this mark pieces that merges never make; they cost as much as a fallback.
_NEVER = -1e8


class Pieces:
    """A vocabulary of scored pieces with byte fallback.

    ``entries`` are (piece, score, id), with U+2581 for a space; ``bytes_`` maps
    each byte to the id that stands for it.  A literal U+2581 in a text is no
    space: it is spelled in bytes, so decoding gives back exactly the text.
    """

    def __init__(self, entries: list[tuple[str, float, int]], bytes_: dict[int, int]) -> None:
        self.entries, self.bytes_ = entries, bytes_
        self._prepare()

    def __getstate__(self) -> tuple:
        return self.entries, self.bytes_

    def __setstate__(self, state: tuple) -> None:
        self.entries, self.bytes_ = state
        self._prepare()

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        entries, bytes_ = [], {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                bytes_[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                entries.append((sp.id_to_piece(i), sp.get_score(i), i))
        return cls(entries, bytes_)

    def _prepare(self) -> None:
        # every beginning of a piece, so that a scan can stop early: (score, ids) or None
        self.fallback = min((s for _, s, _ in self.entries if s > _NEVER), default=0.0) - 10.0
        self.known: dict[str, tuple[float, bytes] | None] = {}
        self.raw: dict[int, bytes] = defaultdict(bytes) | {i: bytes([b]) for b, i in self.bytes_.items()}
        before: dict[str, set[str]] = {}
        for piece, score, i in self.entries:
            text = piece.replace("▁", " ")
            self.raw[i] = text.encode()
            for k in range(1, len(text)):
                self.known.setdefault(text[:k], None)
                before.setdefault(text[k], set()).add(text[k - 1])
            self.known[text] = (max(score, self.fallback), np.int32(i).tobytes())
        # all pieces that end at each character, longest first
        self.matcher, self.singles = ahocorasick.Automaton(), set()
        for text, found in self.known.items():
            if found:
                self.matcher.add_word(text, (len(text), *found))
                if len(text) == 1:
                    self.singles.add(text)
        self.matcher.make_automaton()
        # a space never continues a piece, unless after a space: parts begin at spaces
        splits = before.get(" ", set()) <= {" "}
        # and at marks that never follow a Latin letter, where they do
        follow = {c for c, b in before.items() if any(map(_LETTER.match, b))}
        marks = {c for t, _, _ in self.entries for c in t if c.isascii() and not c.isalnum()} - follow
        q = "".join(map(re.escape, sorted(marks)))
        # a line feed in no piece stands alone
        line = "" if any("\n" in t for t, _, _ in self.entries) else "\n"
        word = rf" *[^ {q}{line}]+(?<={_LETTER.pattern})(?=[ {q}{line}]|\Z)|" if q else ""
        alone = "|\n" if line else ""
        self.parts = re.compile(rf"{word} *[^ {line}]+{alone}| +" if splits else r"(?s).+")
        # two generations: what was met again since the last change stays
        self.cache: dict[str, tuple[bytes, float, float]] = {}
        self.older: dict[str, tuple[bytes, float, float]] = {}
        #: Parts met whose pieces don't spell them.
        self.lossy: set[str] = set()

    def _spell(self, c: str) -> bytes:
        return np.array([self.bytes_[b] for b in c.encode()], np.int32).tobytes()

    def edges(self, text: str) -> list[list[tuple[int, float, bytes]]]:
        """For each end the pieces that end there: (start, score, ids)."""
        return self._lattice(text)[0]

    def _lattice(self, text: str) -> tuple[list[list[tuple[int, float, bytes]]], list[float]]:
        """The edges and, by a forward Viterbi pass, the best score of every prefix."""
        n = len(text)
        into: list[list[tuple[int, float, bytes]]] = [[] for _ in range(n + 1)]
        alpha = [0.0] + [float("-inf")] * n
        found = self.matcher.iter(text) if self.matcher else ()
        if not self.singles.issuperset(text):
            # characters without a piece are spelled in bytes, after the pieces that end with them
            spelled = [(i, (1, self.fallback, self._spell(c))) for i, c in enumerate(text) if c not in self.singles]
            found = heapq.merge(found, spelled, key=operator.itemgetter(0))
        for j, (length, score, ids) in found:
            j += 1
            i = j - length
            into[j].append((i, score, ids))
            if (a := alpha[i] + score) > alpha[j]:
                alpha[j] = a
        return into, alpha

    def best(self, parts: list[str]) -> list[tuple[bytes, float, float]]:
        """(ids, score, lead over the second-best segmentation or inf) of each part."""
        get, search = self.cache.get, self._best
        return [get(p) or search(p) for p in parts]

    def _best(self, part: str) -> tuple[bytes, float, float]:
        """The same for one part: the first two paths of the A* search."""
        if len(self.cache) >= _CACHED:
            self.older, self.cache = self.cache, {}
        if not (found := self.older.get(part)):
            paths = self.nbest_part(part, 2)
            score, ids = paths[0]
            found = (ids, score, score - paths[1][0] if len(paths) > 1 else float("inf"))
            if b"".join(map(self.raw.__getitem__, np.frombuffer(ids, np.int32).tolist())) != part.encode():
                self.lossy.add(part)
        self.cache[part] = found
        return found

    def nbest_part(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of one part: backward A* under forward Viterbi scores.

        A node is met at most n times, best rest of the text first; what is met
        later is on none of the n best paths.  So ties cost no more than n
        times the lattice.
        """
        into, alpha = self._lattice(part)
        push, pop = heapq.heappush, heapq.heappop
        met = [0] * (len(part) + 1)
        out: list[tuple[float, bytes]] = []
        serial = 0
        # (-(score so far + best score of the rest), position, order, score so far, path)
        heap: list[tuple] = [(-alpha[-1], len(part), 0, 0.0, None)]
        while heap:
            _, at, _, gone, path = pop(heap)
            if at == 0:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((gone, b"".join(ids)))
                if len(out) == n:
                    break
                continue
            if met[at] == n:
                continue
            met[at] += 1
            for i, score, piece in into[at]:
                if met[i] < n:
                    serial += 1
                    so_far = gone + score
                    push(heap, (-(so_far + alpha[i]), i, serial, so_far, (piece, path)))
        return out

    def encode(self, text: str) -> tuple[bytes, float]:
        """(ids as int32 bytes, score) of the best segmentation."""
        found = self.best(self.parts.findall(" " + text)) if text else []
        return b"".join([f[0] for f in found]), sum([f[1] for f in found])

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text, best first: (score, ids)."""
        parts = self.parts.findall(" " + text) if text else []
        return [(score, np.frombuffer(ids, np.int32).tolist()) for score, ids in self._nbest(parts, n)]

    def _nbest(self, parts: list[str], n: int) -> list[tuple[float, bytes]]:
        """(score, ids as int32 bytes) of the n best segmentations of all parts, best first."""
        first, ways = self.changes(parts, n)
        return [(score, applied(first, edits)) for score, edits in ways]

    def changes(self, parts: list[str], n: int) -> tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """Ids (int32 bytes) of the best segmentation, and the n best as (score, edits of the best).

        An edit (at, length, ids) puts ids in the place of so many bytes of the
        best's ids; a segmentation's edits are in order.  The best has none.
        """
        found = self.best(parts)
        best = list(map(operator.itemgetter(0), found))
        leads = np.fromiter(map(operator.itemgetter(2), found), np.float64, len(found))
        ways = self._combine(parts, sum(map(operator.itemgetter(1), found)), leads, n)
        places, at, before = {}, 0, 0  # where the ids of the parts that differ begin
        for k in sorted({k for _, c in ways for k in c}):
            at += sum(map(len, best[before:k]))
            places[k], before = at, k
        return b"".join(best), [(score, [(places[k], len(best[k]), ids) for k, ids in sorted(c.items())]) for score, c in ways]

    def _combine(self, parts: list[str], score: float, leads: np.ndarray, n: int) -> list[tuple[float, dict[int, bytes]]]:
        """(score, {part: ids that differ from its best}) of the n best segmentations of all parts.

        ``score`` is that of the best, ``leads`` how far the parts' second-best
        lie behind.  An alternative outside the n - 1 parts with the least
        leads is beaten by n others, so only those are searched.
        """
        near = np.arange(len(leads))
        if 0 < n - 1 < len(leads):
            near = np.flatnonzero(leads <= np.partition(leads, n - 2)[n - 2])
        near = near[np.argsort(leads[near], kind="stable")[: n - 1]]
        ways: list[tuple[float, dict[int, bytes]]] = [(score, {})]
        for k in near.tolist():
            if leads[k] == float("inf"):
                continue
            options = self.nbest_part(parts[k], n)
            grown = [(s + o - options[0][0], {**c, k: ids} if m else c) for s, c in ways for m, (o, ids) in enumerate(options)]
            ways = heapq.nsmallest(n, grown, key=lambda w: -w[0])
        return ways

    def gives_back(self, text: str, parts: list[str]) -> bool:
        """Whether decoding the best segmentation of the parts, encoded before, gives back the text.

        Pieces are decoded one by one, so it does if the parts make up the text
        and the pieces of each spell it, which was seen when it was first met.
        """
        return sum(map(len, parts)) == len(text) + bool(text) and (not self.lossy or self.lossy.isdisjoint(parts))

    def decode(self, ids: bytes | list[int]) -> str:
        """The text that was encoded; ids that stand for no text (control) give none."""
        found = np.frombuffer(ids, np.int32).tolist() if isinstance(ids, bytes) else ids
        return b"".join(map(self.raw.__getitem__, found)).decode("utf-8", "replace").removeprefix(" ")


def applied(first: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """The ids of a segmentation, given those of the best and its edits; see :meth:`Pieces.changes`."""
    if not edits:
        return first
    out, at = [], 0
    for place, length, ids in edits:
        out += (first[at:place], ids)
        at = place + length
    return b"".join([*out, first[at:]])


def expanded(encoded: DataFrame) -> DataFrame:
    """``nbest_ids`` in the place of ``nbest_edits``: the whole ids of every segmentation (DataFrame operations only)."""
    ids = """transform(nbest_edits, way -> aggregate(way, struct(cast(array() as array<int>) as done, 0 as upto),
        (s, e) -> struct(concat(s.done, slice(ids, s.upto + 1, e.at - s.upto), e.ids) as done, e.at + e.n as upto),
        s -> concat(s.done, slice(ids, s.upto + 1, size(ids)))))"""
    return encoded.withColumn("nbest_edits", F.expr(ids)).withColumnRenamed("nbest_edits", "nbest_ids")


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _nested(rows: list[list], inner: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), inner)


def encode(
    docs: DataFrame, pieces: Pieces, nbest: int = 5, id_col: str = "doc_id", text_col: str = "text", check: bool = True, edits: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, ids, n_pieces, score, nbest_scores, nbest_ids, round_trip.

    The whole text is encoded.  ``nbest_scores`` and ``nbest_ids`` are the
    scores and the ids of the up to ``nbest`` best segmentations, best first;
    ``ids`` and ``score`` are those of the first; ``round_trip`` tells whether
    decoding ``ids`` gives back the text (null: not checked).  With ``edits``
    there is ``nbest_edits`` instead of ``nbest_ids``: how each segmentation
    differs from the first, as (at, n, ids) in order, ids in the place of n
    pieces from at on; :func:`expanded` makes the ids of it.  A text's best
    segmentations differ in few places, so this holds the same in a fraction
    of the space.

    A null text counts as empty; an empty one has no piece and the one score 0.
    Bytes that are not UTF-8 count as U+FFFD.  A row's work is linear in its
    text, and nothing is shuffled; other columns of ``docs`` are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Pieces = shipped.value
        for batch in batches:
            for at, texts in runs_of_texts(batch.column(1)):
                ids, found, same = [], [], []
                for raw in texts:
                    text, _ = valid(raw)
                    parts = known.parts.findall(" " + text) if text else []
                    first, ways = known.changes(parts, nbest)
                    ids.append(first)
                    found.append(ways)
                    same.append(known.gives_back(text, parts) if check else None)
                all_scores = [score for ways in found for score, _ in ways]
                if edits:
                    name, changed = "nbest_edits", [e for ways in found for _, e in ways]
                    flat = [e for c in changed for e in c]
                    fields = [pa.array([e[0] // 4 for e in flat], pa.int32()), pa.array([e[1] // 4 for e in flat], pa.int32()), _lists([e[2] for e in flat])]
                    other = _nested(found, _nested(changed, pa.StructArray.from_arrays(fields, fields=list(kind))))
                else:
                    name, other = "nbest_ids", _nested(found, _lists([applied(first, e) for first, ways in zip(ids, found) for _, e in ways]))
                yield pa.RecordBatch.from_pydict(
                    {
                        id_col: batch.column(0).slice(at, len(texts)),
                        "ids": _lists(ids),
                        "n_pieces": pa.array([len(i) // 4 for i in ids], pa.int32()),
                        "score": pa.array([ways[0][0] for ways in found], pa.float64()),
                        "nbest_scores": _nested(found, pa.array(all_scores, pa.float64())),
                        name: other,
                        "round_trip": pa.array(same, pa.bool_()),
                    }
                )

    other = "nbest_edits array<array<struct<at:int,n:int,ids:array<int>>>>" if edits else "nbest_ids array<array<int>>"
    schema = f"`{id_col}` {id_type}, ids array<int>, n_pieces int, score double, nbest_scores array<double>, {other}, round_trip boolean"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
