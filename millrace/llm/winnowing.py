"""Benchmark decontamination by winnowing.

Of the k-gram hashes of each text the minimum of every ``window`` consecutive
ones is kept as a fingerprint.  Two texts that share ``k + window - 1`` words
in a row share a fingerprint at the same place of the shared span, so joining
the fingerprints of benchmark and documents finds every such span; each hit is
then extended to the windows of words around it, and those that are a window of
an item, word by word, count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, drop_rows, materialize, numbered, unused
from millrace.llm.words import ALNUM_LOWER, Words, grams, pieces

K, SPAN = 5, 10
_MASK = np.uint64((1 << 20) - 1)


def minima(hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the k-grams, minimum of each ``window`` consecutive ones)."""
    g = grams(hashes, k) | np.uint64(1)  # never 0, which marks a window that isn't whole
    n = len(g)
    low = g.copy()
    for j in range(1, min(window, n)):
        low[: n - j] = np.minimum(low[: n - j], g[j:])
    return g, low


def winnow(hashes: np.ndarray, last: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints): the k-grams that are the minimum of some window.

    ``last`` gives for each word the end of its text, so that no gram and no
    window crosses from one text into the next.  All k-grams that tie for the
    minimum are kept.
    """
    g, low = minima(hashes, k, window)
    n = len(g)
    at = np.arange(n)
    low[at + k + window - 1 > last[:n]] = 0
    best = low.copy()  # the greatest minimum among the windows that hold the position
    for j in range(1, min(window, n)):
        best[j:] = np.maximum(best[j:], low[: n - j])
    chosen = np.flatnonzero(best == g)
    return chosen, g[chosen]


class Index:
    """Fingerprints of one block of benchmark items, and their windows by hash."""

    def __init__(self, ids: list[str | None], texts: list[bytes], k: int = K, span: int = SPAN) -> None:
        self.k, self.span, self.ids = k, span, ids
        words = Words.of(texts, ALNUM_LOWER)
        hashes, last = words.hashes(), words.last()
        self.items = [[words.word(i) for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:])]
        self.prints = np.unique(winnow(hashes, last, k, span - k + 1)[1])
        g = grams(hashes, span)
        whole = np.flatnonzero(np.arange(len(g)) + span <= last[: len(g)])
        owner = np.searchsorted(words.first, whole, "right") - 1
        order = np.lexsort((whole, owner, g[whole]))
        g, whole, owner = g[whole][order], whole[order], owner[order]
        # of a window that an item repeats one place is kept
        once = np.ones(len(g), bool)
        once[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, self.owner, self.place = g[once], owner[once], (whole - words.first[owner])[once]
        self.windows, begins = np.unique(g, return_index=True)
        self.begins = np.append(begins, len(g))
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for n, item in enumerate(self.items):
            if 0 < len(item) < span:
                a = int(words.first[n])
                self.short[len(item)][int(grams(hashes[a : a + len(item)], len(item))[0])].append(n)
        self.short = {m: dict(found) for m, found in self.short.items()}
        self.table = self._table(self.prints)
        self.short_tables = {m: self._table(np.fromiter(found, np.uint64, len(found))) for m, found in self.short.items()}

    @staticmethod
    def _table(hashes: np.ndarray) -> np.ndarray:
        table = np.zeros(int(_MASK) + 1, bool)
        table[(hashes & _MASK).astype(np.int64)] = True
        return table

    def hits(self, words: Words) -> list[tuple[int, int, int]]:
        """(start, end, item): windows of the documents that are windows of an item.

        Every place of a window is listed with one of its items, and its first
        place in a text with all of them.  A shared fingerprint is extended to
        the windows around it, which are looked up by their hash and compared
        word by word: once with each item for each distinct window of a text,
        however often text or item repeat it.
        """
        out: list[tuple[int, int, int]] = []
        if not len(words.starts):
            return out
        hashes, last = words.hashes(), words.last()
        where, prints = winnow(hashes, last, self.k, self.span - self.k + 1)
        likely = np.flatnonzero(self.table[(prints & _MASK).astype(np.int64)])
        shared = where[likely[_among(prints[likely], self.prints)[0]]]
        around = np.unique(shared[:, None] - np.arange(self.span - self.k + 1))
        around = around[around >= 0]
        around = around[around + self.span <= last[around]]
        equal, at = _among(grams(hashes, self.span)[around], self.windows)
        self._compare(words, self.span, around[equal], at, out, lambda w: zip(self.owner[self.begins[w] : self.begins[w + 1]].tolist(), self.place[self.begins[w] : self.begins[w + 1]].tolist()))
        for m, found in self.short.items():
            g = grams(hashes, m)
            likely = np.flatnonzero(self.short_tables[m][(g & _MASK).astype(np.int64)] & (np.arange(len(g)) + m <= last[: len(g)]))
            self._compare(words, m, likely, g[likely], out, lambda h: ((item, 0) for item in found.get(h, ())))  # noqa: B023
        return out

    def _compare(self, words: Words, m: int, starts: np.ndarray, keys: np.ndarray, out: list, entries) -> None:
        """Appends the runs of m words at ``starts`` that equal one of the (item, place) that ``entries`` gives for their key."""
        seen: dict[tuple[int, bytes], int | None] = {}
        texts = np.searchsorted(words.first, starts, "right") - 1
        for start, key, text in zip(starts.tolist(), keys.tolist(), texts.tolist()):
            run = [words.word(i) for i in range(start, start + m)]
            if (place := (text, b" ".join(run))) not in seen:
                found = [item for item, p in entries(key) if self.items[item][p : p + m] == run]
                seen[place] = found[0] if found else None
                out += [(start, start + m, item) for item in found]
            elif seen[place] is not None:
                out.append((start, start + m, seen[place]))


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of the values that are among the sorted ``known``, their places there)."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    equal = np.flatnonzero(known[at] == values)
    return equal, at[equal]


def _spans(marked: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[0::2], edges[1::2])]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = K,
    span: int = SPAN,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (word ranges hit), items (ids as strings).

    A window is ``span`` consecutive words of an item (the whole item if it has
    fewer, but some); every document word inside an occurrence of a window is
    hit.  Null and empty texts have no words; an item without words never
    occurs.  Items that share an id are one item in ``items``, and an item
    without id marks words but is not listed.  An empty benchmark hits nothing.

    A benchmark of at most ``block_bytes`` of text (counted first) is one index
    that goes to every executor; documents are never shuffled then, so neither
    a hot source nor a passage that a third of them shares matters.  For a
    larger one see :func:`_in_blocks`: the fingerprints of both sides are
    joined, and only documents that share one meet the items.  Other columns of
    ``docs`` are not read.  Jobs run when this is called.
    """
    items, small = _items(benchmark, item_col, item_text_col, block_bytes)
    id_type = docs.schema[id_col].dataType.simpleString()
    if small:
        index = _broadcast_index(items, k, span)
        schema = f"`{id_col}` {id_type}, n_words bigint, {_FOUND} array<string>"
        return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_marker(index), schema)
    rows = numbered(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")))
    words, found = _in_blocks(rows, items, k, span, block_bytes)
    spans = found.select("__row", F.explode("spans").alias("s")).groupBy("__row").agg(F.collect_set("s").alias("spans"))
    spans = spans.mapInArrow(_merge, "__row bigint, spans array<struct<start:int,end:int>>")
    named = found.select("__row", F.explode("items").alias("sha")).join(items.where("id IS NOT NULL").select("sha", "id").distinct(), "sha")
    named = named.groupBy("__row").agg(F.array_sort(F.collect_set("id")).alias("items"))
    out = rows.select("__row", "__id").join(words, "__row").join(spans, "__row", "left").join(named, "__row", "left")
    no_spans = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(F.col("__id").alias(id_col), "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


_FOUND = "spans array<struct<start:int,end:int>>, items"


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = K,
    span: int = SPAN,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no window of an item; see :func:`contamination`."""
    items, small = _items(benchmark, item_col, item_text_col, block_bytes)
    if small:
        return docs.mapInArrow(_filter(_broadcast_index(items, k, span), text_col), docs.schema)
    row = unused(docs, "__row")
    rows = numbered(docs, row)
    words, found = _in_blocks(rows.select(F.col(row).alias("__row"), F.col(text_col).alias("__text")), items, k, span, block_bytes)
    dropped = materialize(found.select("__row").distinct(), "contaminated")
    discard(words, found)
    return drop_rows(rows, dropped, row)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> tuple[DataFrame, bool]:
    """(id, text, sha) of the items, and whether all of them fit one index."""
    text = F.coalesce(F.col(item_text_col), F.lit(""))
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    total = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0)) + 16)).first()[0] or 0
    return items, total <= block_bytes


def _broadcast_index(items: DataFrame, k: int, span: int):
    """The index of items of at most ``block_bytes``, for every executor."""
    rows = items.select("id", "text").collect()
    return items.sparkSession.sparkContext.broadcast(Index([r["id"] for r in rows], [r["text"].encode() for r in rows], k, span))


def _item_prints(k: int, span: int):
    """sha, text -> (m, fp): fingerprints (m = 0) of an item, or the hash of all its m words if they are fewer than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                words = Words.of(texts, ALNUM_LOWER)
                hashes = words.hashes()
                found = {(0, h) for h in winnow(hashes, words.last(), k, span - k + 1)[1].tolist()}
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    if 0 < b - a < span:
                        found.add((b - a, int(grams(hashes[a:b], b - a)[0])))
                m, h = zip(*sorted(found)) if found else ((), ())
                yield pa.RecordBatch.from_pydict({"m": pa.array(m, pa.int32()), "fp": pa.array(np.array(h, np.uint64).view(np.int64))})

    return run


def _doc_prints(k: int, span: int, lengths: list[int]):
    """row, text -> row, n_words, and the distinct (m, fp) of the document: fingerprints, and all runs of the short items' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1)):
                words = Words.of(texts, ALNUM_LOWER)
                hashes, last, first = words.hashes(), words.last(), words.first
                where, prints = winnow(hashes, last, k, span - k + 1)
                sides = [(0, where, prints)]
                for m in lengths:
                    g = grams(hashes, m)
                    whole = np.flatnonzero(np.arange(len(g)) + m <= last[: len(g)])
                    sides.append((m, whole, g[whole]))
                ms, fps = [], []
                for a, b in zip(first[:-1], first[1:]):
                    mine = [(m, np.unique(p[np.searchsorted(w, a) : np.searchsorted(w, b)])) for m, w, p in sides]
                    ms.append(np.concatenate([np.full(len(p), m, np.int32) for m, p in mine]))
                    fps.append(np.concatenate([p for _, p in mine]).view(np.int64))
                offsets = pa.array(np.cumsum([0, *map(len, ms)]).astype(np.int32))
                yield pa.RecordBatch.from_pydict(
                    {
                        "__row": batch.column(0).slice(at, len(texts)),
                        "n_words": pa.array(np.diff(first).astype(np.int64)),
                        "m": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ms))),
                        "fp": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(fps))),
                    }
                )

    return run


def _in_blocks(rows: DataFrame, items: DataFrame, k: int, span: int, block_bytes: int, group_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """((row, n_words) of rows (__row, __text), (row, spans, shas of items) by block of items).

    Equal items are one.  They are dealt into blocks of about ``block_bytes``;
    the distinct fingerprints of items and of documents are narrow tables and
    are joined once, which tells the blocks that a document has to meet.  Only
    such documents are then grouped with their blocks, in as many groups per
    block as keep each at about ``group_bytes`` of documents, and hits are
    found and extended there word by word.  The documents are read twice,
    however large the benchmark is, and nothing goes to the driver but the
    lengths of items shorter than a window.
    """
    distinct = items.groupBy("sha").agg(F.first("text").alias("text"), F.octet_length(F.first("text")).alias("size"))
    distinct = materialize(distinct, "benchmark-items")
    blocks = max(1, -(-(distinct.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    block = F.pmod(F.xxhash64("sha"), F.lit(blocks)).cast("int")
    keyed = distinct.select(block.alias("block"), "text").mapInArrow(_with_block(_item_prints(k, span)), "block int, m int, fp bigint")
    keys = materialize(keyed.distinct(), "benchmark-prints")
    lengths = sorted(r["m"] for r in keys.where("m > 0").select("m").distinct().collect())
    prints = materialize(rows.select("__row", "__text").mapInArrow(_doc_prints(k, span, lengths), "__row bigint, n_words bigint, m array<int>, fp array<bigint>"), "document-prints")
    words = materialize(prints.select("__row", "n_words"), "document-words")
    narrow = prints.select("__row", F.explode(F.arrays_zip("m", "fp")).alias("p")).select("__row", "p.m", "p.fp")
    met = materialize(narrow.join(keys, ["m", "fp"]).select("__row", "block").distinct(), "document-blocks")
    discard(prints, keys)
    texts = rows.select("__row", "__text").join(met, "__row")
    groups = F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("__text")) / group_bytes)).cast("int")
    groups = materialize(texts.groupBy("block").agg(groups.alias("groups")), "block-groups")
    dealt = texts.join(groups, "block").select("block", F.pmod(F.xxhash64("__row"), F.col("groups")).cast("int").alias("grp"), "__row", "__text")
    own = distinct.select(block.alias("block"), "sha", "text").join(groups, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "sha", "text")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        shas, ids, found = right["sha"].to_pylist(), left["__row"].combine_chunks(), [[], [], []]
        index = Index(shas, [t.encode() for t in right["text"].to_pylist()], k, span)
        for at, texts in pieces(left["__text"]):
            for d, (spans, names) in _hits(index, Words.of(texts, ALNUM_LOWER)).items():
                for out, value in zip(found, (ids[at + d].as_py(), spans, sorted(names))):
                    out.append(value)
        return pa.table({"__row": pa.array(found[0], pa.int64()), "spans": pa.array(found[1], _SPANS), "items": pa.array(found[2], pa.list_(pa.string()))})

    found = dealt.groupBy("block", "grp").cogroup(own.groupBy("block", "grp")).applyInArrow(meet, f"__row bigint, {_FOUND} array<string>")
    found = materialize(found, "contamination")
    discard(distinct, met, groups)
    return words, found


def _with_block(prints):
    """The same of rows whose first column is their block, which is put before what each run of equal blocks gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).unique().to_pylist():
                mine = batch.filter(pa.compute.equal(batch.column(0), value))
                for out in prints(iter([mine.select([1])])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, value, np.int32)), *out.columns], names=["block", *out.schema.names])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _hits(index: Index, words: Words) -> dict[int, tuple[list[dict[str, int]], set]]:
    """{text: (merged spans within it, ids of items)} of the texts that are hit."""
    hit = index.hits(words)
    marked, owners = np.zeros(len(words.starts), bool), defaultdict(set)
    texts = np.searchsorted(words.first, [a for a, _, _ in hit], "right") - 1 if hit else ()
    for (a, b, item), d in zip(hit, texts):
        marked[a:b] = True
        owners[int(d)].add(index.ids[item])
    return {d: (_spans(marked[words.first[d] : words.first[d + 1]]), names) for d, names in owners.items()}


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching spans of a row become one."""
    for batch in batches:
        out = []
        for spans in batch.column(1).to_pylist():
            merged: list[dict[str, int]] = []
            for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                if merged and s["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(dict(s))
            out.append(merged)
        yield pa.RecordBatch.from_pydict({"__row": batch.column(0), "spans": pa.array(out, _SPANS)})


def _filter(index, text_col: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Index = index.value
        for batch in batches:
            for at, texts in pieces(batch.column(batch.schema.names.index(text_col))):
                words = Words.of(texts, ALNUM_LOWER)
                clean = np.ones(len(texts), bool)
                if hit := found.hits(words):
                    clean[np.searchsorted(words.first, [a for a, _, _ in hit], "right") - 1] = False
                yield batch.slice(at, len(texts)).filter(pa.array(clean))

    return keep


def _marker(index):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Index = index.value
        for batch in batches:
            for at, texts in pieces(batch.column(1)):
                words = Words.of(texts, ALNUM_LOWER)
                hit = _hits(found, words)
                each = [hit.get(d, ([], set())) for d in range(len(texts))]
                yield pa.RecordBatch.from_pydict(
                    {
                        batch.schema.names[0]: batch.column(0).slice(at, len(texts)),
                        "n_words": pa.array(np.diff(words.first).astype(np.int64)),
                        "spans": pa.array([spans for spans, _ in each], _SPANS),
                        "items": pa.array([sorted(names - {None}) for _, names in each], pa.list_(pa.string())),
                    }
                )

    return mark
