"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, indexed in blocks: each block of hashes
holds, for sampled runs of words (anchors), where they occur first.  Every
document is parsed greedily against all blocks: consecutive anchors that point
along one diagonal of the same earlier text make a factor.  Windows of words
that no factor holds but that cross a factor's boundary (or hold an anchor
alone) are looked up by their own hash, and those along one diagonal are joined
to factors as well.  Every factor is then compared with the blocks of words of
the text that it points to, word by word, and extended as far as they agree; a
factor of at least ``window`` words is a duplicate span.  So hashes only propose
what words decide: nothing is removed that was not compared.

Anchors are the minima of ``WINNOW`` consecutive hashes of ``K`` words with
``K + WINNOW - 1 = window``: every window holds an anchor, the same in every
copy (its least), so a window whose least anchor occurs once is new.  As ``K >= WINNOW``,
neighbouring anchors on one diagonal leave no word between them unchecked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import discard, materialize
from millrace.llm.winnowing import minima, winnow
from millrace.llm.words import SPACED, Words, grams, pieces

WINDOW, K = 20, 11
#: Words of a reference block.
BLOCK = 64


def _arrays(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).astype(kind) if values else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _first_marked(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions; those whose hash occurred before in the same text as -1 - position."""
    _, first = np.unique(hashes, return_index=True)
    out = -1 - at
    out[first] = at[first]
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, text) with a unique long key in the order of the documents, and (id, text hash, key) if it isn't the id.

    Ids that are whole numbers, unique and never null are the keys.  Otherwise
    documents are ordered by id (null first), then by a hash of their text, and
    rows that repeat both are one document.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    if isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        ids = docs.select(F.col(id_col).cast("long").alias("key"))
        odd = ids.groupBy("key").count().where("key IS NULL OR count > 1")
        if odd.isEmpty():
            return docs.select(F.col(id_col).cast("long").alias("key"), text), None
    rows = docs.select(F.col(id_col).alias("id"), text, F.sha2(text, 256).alias("sha"))
    names = rows.select("id", "sha").distinct()
    ordered = names.repartitionByRange(F.col("id").asc_nulls_first(), "sha").sortWithinPartitions(F.col("id").asc_nulls_first(), "sha")
    # written before it is used, so that the keys stay what they were
    keys = materialize(ordered.withColumn("key", F.monotonically_increasing_id()), "rlz-keys")
    same = F.col("r.sha") == F.col("k.sha")
    found = rows.alias("r").join(keys.alias("k"), same & F.col("r.id").eqNullSafe(F.col("k.id")))
    return materialize(found.groupBy("k.key").agg(F.first("r.text").alias("text")), "rlz-texts"), keys


def _scan(window: int, k: int):
    """key, text -> key, n_words, sha256 of all words, anchors (hash, marked position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1)):
                words = Words.of(texts, SPACED)
                where, prints = winnow(words.hashes(), words.last(), k, window - k + 1)
                cuts = np.searchsorted(where, words.first)
                spans = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column(0).slice(at, len(texts)),
                        "n_words": pa.array(np.diff(words.first).astype(np.int64)),
                        "sha": pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]),
                        "h": _arrays([prints[s].view(np.int64) for s in spans], np.int64),
                        "at": _arrays([_first_marked(where[s] - lo, prints[s]) for s, lo in zip(spans, words.first)], np.int32),
                    }
                )

    return run


def _index(rows: DataFrame) -> DataFrame:
    """(h, key0, at0): the first occurrence of every hash that occurs more than once in rows (key, h, at).

    Only whole numbers are aggregated, so the counting is combined before the
    shuffle and a hash that a third of all documents share is one row per task.
    """
    first = F.when(F.col("at") >= 0, F.col("key"))
    return (
        rows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key0"), F.min_by("at", first).alias("at0"))
        .where("n > 1")
        .select("h", "key0", "at0")
    )


def _exploded(table: DataFrame) -> DataFrame:
    return table.select("key", F.explode(F.arrays_zip("h", "at")).alias("a")).select("key", "a.h", "a.at")


def factors(key: int, at: np.ndarray, key0: np.ndarray, at0: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(start, end, text, shift) of the greedy parse: runs of anchors on one diagonal of one earlier place.

    Word i of a factor is word i - shift of the text.  ``at`` are the places of
    the document's repeated anchors in order, with their first occurrence; an
    anchor that is its own first occurrence ends a factor and begins none.
    """
    out: list[tuple[int, int, int, int]] = []
    for p, r, q in zip(at.tolist(), key0.tolist(), at0.tolist()):
        if r == key and q == p:
            line = None
        else:
            line = (r, p - q)
        if out and line == out[-1][2:] and p <= out[-1][1]:
            out[-1] = (out[-1][0], p + k, *line)
        elif line:
            out.append((p, p + k, *line))
        else:
            out.append((p, p, key, 0))  # nothing, but no factor goes on across it
    return [f for f in out if f[1] > f[0]]


def _parse(window: int, k: int):
    """key, text, pointers -> key, text, factors of a window or more, windows to be checked (hash, marked position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            # as flat numbers: a document may have as many pointers as a tenth of its words
            cuts = batch.column(2).offsets.to_numpy()
            fields = [batch.column(2).values.field(i).to_numpy().astype(np.int64) for i in range(3)]
            for first, texts in pieces(batch.column(1)):
                words = Words.of(texts, SPACED)
                hashes = words.hashes()
                g, low = minima(hashes, k, window - k + 1)
                whole = grams(hashes, window)
                long, places, prints = [], [], []
                for d in range(len(texts)):
                    lo, n = int(words.first[d]), int(words.first[d + 1] - words.first[d])
                    found = np.stack([f[cuts[first + d] : cuts[first + d + 1]] for f in fields], axis=1)
                    found[:, 0] = np.where(found[:, 0] < 0, -1 - found[:, 0], found[:, 0])
                    found = found[np.argsort(found[:, 0], kind="stable")]
                    spans = [s for s in factors(keys[first + d], *found.T, k) if s[1] - s[0] >= window]
                    # windows whose least anchor, the one that every copy has, is repeated ...
                    m = max(0, n - window + 1)
                    open_ = np.isin(low[lo : lo + m], g[lo + found[:, 0]])
                    # ... and that no factor holds
                    for a, b, _, _ in spans:
                        open_[a : b - window + 1] = False
                    at = np.flatnonzero(open_)
                    h = whole[lo + at]
                    long.append(np.array(spans, np.int64).reshape(-1, 4))
                    places.append(_first_marked(at, h))
                    prints.append(h.view(np.int64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column(0).slice(first, len(texts)),
                        "text": batch.column(1).slice(first, len(texts)),
                        **{name: _arrays([f[:, i] for f in long], np.int64) for i, name in enumerate(("starts", "ends", "refs", "shifts"))},
                        "h": _arrays(prints, np.int64),
                        "at": _arrays(places, np.int32),
                    }
                )

    return run


def covering(found: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Of proposed factors (start, end, text, shift) as few as cover the same words: greedily the one that reaches farthest.

    Those along one diagonal that overlap are joined to one first.
    """
    if not len(found):
        return []
    start, end, ref, shift = found[np.lexsort((found[:, 0], found[:, 3], found[:, 2]))].T
    line = np.cumsum(np.concatenate([[0], (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1])]))
    # the farthest end so far on the same diagonal
    far = np.maximum.accumulate(end + line * (1 << 40)) - line * (1 << 40)
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (start[1:] > far[:-1])]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    joined = sorted(zip(start[first].tolist(), far[last].tolist(), ref[first].tolist(), shift[first].tolist()))
    out: list[tuple[int, int, int, int]] = []
    best, upto = joined[0], -1
    for factor in joined:
        # ``best`` reaches farthest of those that begin within what is covered
        if factor[0] > upto and best[1] > upto:
            out.append(best)
            upto = best[1]
        if factor[0] > upto or factor[1] > best[1]:
            best = factor
    if best[1] > upto:
        out.append(best)
    return out


def _requests(window: int):
    """key, factors, repeated windows -> (key, start, end, ref, shift, block): the blocks of words that each factor is to be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, int, int]] = []
            flat = [batch.column(i).values.to_numpy().astype(np.int64) for i in range(1, 5)]
            cuts = batch.column(1).offsets.to_numpy()
            windows, held = batch.column(5), batch.column(5).offsets.to_numpy()
            at, ref, place = (windows.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            given = windows.is_valid().to_numpy(zero_copy_only=False)
            for d, key in enumerate(batch.column(0).to_pylist()):
                long = np.stack([f[cuts[d] : cuts[d + 1]] for f in flat], axis=1)
                one = slice(held[d], held[d + 1]) if given[d] else slice(0, 0)
                short = np.stack([at[one], at[one] + window, ref[one], at[one] - place[one]], axis=1)
                for a, b, r, shift in covering(np.concatenate([long, short])):
                    out += [(key, a, b, r, shift, n) for n in range((a - shift) // BLOCK, (b - shift - 1) // BLOCK + 1)]
            columns = zip(*out) if out else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["key", "start", "end", "ref", "shift", "block"])

    return run


def _reference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, wanted blocks -> (ref, block, words): the words of each block, joined by spaces."""
    for batch in batches:
        wanted = batch.column(2)
        for at, texts in pieces(batch.column(1)):
            refs, blocks, found = [], [], []
            for i, text in enumerate(texts):
                words = text.split()
                numbers = wanted[at + i].as_py()
                refs += [batch.column(0)[at + i].as_py()] * len(numbers)
                blocks += numbers
                found += [b" ".join(words[BLOCK * n : BLOCK * (n + 1)]) for n in numbers]
            yield pa.RecordBatch.from_pydict({"ref": pa.array(refs, pa.int64()), "block": pa.array(blocks, pa.int32()), "words": pa.array(found, pa.binary())})


def agreeing(words: list[bytes], start: int, end: int, shift: int, blocks: dict[int, list[bytes]], window: int) -> list[tuple[int, int]]:
    """Spans of at least ``window`` words in which a factor agrees with its reference, grown to both sides as far as the blocks go."""
    lo, hi = min(blocks) * BLOCK, (max(blocks) + 1) * BLOCK
    reference = [w for n in range(min(blocks), max(blocks) + 1) for w in blocks[n]]
    hi = min(hi, lo + len(reference))
    first, last = max(0, lo + shift), min(len(words), hi + shift)
    if words[start:end] == reference[start - shift - lo : end - shift - lo]:
        while start > first and words[start - 1] == reference[start - 1 - shift - lo]:
            start -= 1
        while end < last and words[end] == reference[end - shift - lo]:
            end += 1
        return [(start, end)] if end - start >= window else []
    out, at = [], first
    for i in range(first, last + 1):
        if i == last or words[i] != reference[i - shift - lo]:
            if i - at >= window:
                out.append((at, i))
            at = i + 1
    return out


def _cut(window: int):
    """key, text, factors with blocks of reference words -> key, n_removed, sha256 of the kept words, spans removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, begins, finishes = [], [], [], []
            for at, texts in pieces(batch.column(1)):
                for text, rows in zip(texts, batch.column(2).slice(at, len(texts))):
                    words = text.split()
                    proposed: dict[tuple[int, int, int, int], dict[int, list[bytes]]] = {}
                    for r in rows.as_py():
                        proposed.setdefault((r["start"], r["end"], r["ref"], r["shift"]), {})[r["block"]] = r["words"].split()
                    change = np.zeros(len(words) + 1, np.int64)
                    for (start, end, _, shift), blocks in proposed.items():
                        for a, b in agreeing(words, start, end, shift, blocks, window):
                            change[a] += 1
                            change[b] -= 1
                    gone = np.cumsum(change)[: len(words)] > 0
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest())
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    begins.append(edges[0::2])
                    finishes.append(edges[1::2])
            yield pa.RecordBatch.from_pydict(
                {
                    "key": batch.column(0),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_sha256": pa.array(shas, pa.string()),
                    "starts": _arrays(begins, np.int32),
                    "ends": _arrays(finishes, np.int32),
                }
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, spans.

    ``spans`` are the word ranges [start, end) to remove: the words covered by a
    window of ``window`` words that also starts earlier (in a document of
    smaller id, or earlier in the same one), judged on the input.  Null texts
    have no words; texts shorter than a window lose none.  Rows that repeat id
    and text are one document and have the same result; a repeated id with
    different texts is ordered by a hash of the text, null ids come first.

    Places are proposed by 64-bit hashes of k or ``window`` words and decided by
    the words themselves; two runs of words with one hash could only hide a
    repeat, never remove what is none.  Texts that hold a repeated anchor are
    shuffled by key, of references only the blocks that factors point to; all
    else that is shuffled is narrow, counts are combined first, and both sides
    of the joins by hash or block are plain exchanges, so that a passage that a
    third of the documents share is split over tasks.  Other columns of
    ``docs`` are not read.  Jobs run when this is called.
    """
    if not k >= window - k + 1 >= 1:
        raise ValueError("anchors of k words leave no gap only if k >= window - k + 1 >= 1")
    texts, names = keyed(docs, id_col, text_col)
    scanned = materialize(
        texts.mapInArrow(_scan(window, k), "key bigint, n_words bigint, sha string, h array<bigint>, at array<int>"), "rlz-anchors"
    )
    index = materialize(_index(_exploded(scanned)), "rlz-index")
    pointers = _exploded(scanned).join(index, "h").groupBy("key").agg(F.collect_list(F.struct("at", "key0", "at0")).alias("pointers"))
    pointers = materialize(pointers, "rlz-pointers")
    counts = materialize(scanned.select("key", "n_words", "sha"), "rlz-counts")
    discard(scanned, index)
    parsed = materialize(
        texts.join(pointers.hint("shuffle_merge"), "key")
        .select("key", "text", "pointers")
        .mapInArrow(_parse(window, k), "key bigint, text string, starts array<bigint>, ends array<bigint>, refs array<bigint>, shifts array<bigint>, h array<bigint>, at array<int>"),
        "rlz-parsed",
    )
    discard(pointers)
    windows = _exploded(parsed)
    firsts = materialize(_index(windows), "rlz-windows")
    place = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))
    again = windows.join(firsts, "h").select("key", place.alias("at"), "key0", "at0").where("key <> key0 OR at <> at0")
    again = materialize(again.groupBy("key").agg(F.collect_list(F.struct("at", "key0", "at0")).alias("windows")), "rlz-repeats")
    proposed = parsed.select("key", "starts", "ends", "refs", "shifts").join(again, "key", "left").where("size(starts) > 0 OR windows IS NOT NULL")
    requests = materialize(proposed.mapInArrow(_requests(window), "key bigint, start int, end int, ref bigint, shift bigint, block int"), "rlz-requests")
    discard(firsts, again)
    # texts that are pointed to hold repeated anchors, so they were parsed too
    wanted = requests.select("ref", "block").distinct().groupBy(F.col("ref").alias("key")).agg(F.collect_list("block").alias("blocks"))
    blocks = parsed.select("key", "text").join(wanted, "key").select("key", "text", "blocks")
    blocks = materialize(blocks.mapInArrow(_reference, "ref bigint, block int, words binary"), "rlz-blocks")
    found = requests.join(blocks, ["ref", "block"]).groupBy("key").agg(F.collect_list(F.struct("start", "end", "ref", "shift", "block", "words")).alias("factors"))
    found = materialize(found, "rlz-factors")
    discard(requests, blocks)
    changed = parsed.select("key", "text").join(found, "key").select("key", "text", "factors")
    changed = changed.mapInArrow(_cut(window), "key bigint, n_removed bigint, kept_sha256 string, starts array<int>, ends array<int>")
    changed = materialize(changed, "rlz-changed")
    discard(parsed, found)
    no_spans = F.array().cast("array<struct<start:int,end:int>>")
    out = counts.join(changed, "key", "left").select(
        "key",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")), no_spans).alias("spans"),
    )
    if names is None:
        id_type = docs.schema[id_col].dataType
        return out.select(F.col("key").cast(id_type).alias(id_col), "n_words", "n_removed", "kept_sha256", "spans")
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha"))
    out = out.join(names.select("key", F.col("id").alias("of"), F.col("sha").alias("text_sha")), "key")
    return rows.join(out, (rows["text_sha"] == out["text_sha"]) & rows["id"].eqNullSafe(out["of"])).select(
        rows["id"].alias(id_col), "n_words", "n_removed", "kept_sha256", "spans"
    )
