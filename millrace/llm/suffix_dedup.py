"""Substring dedup by distributed prefix doubling, two doublings a round, over sampled suffixes.

Every string of ``length`` bytes that occurs twice holds the same sampled
positions in both places: the minima of ``length - k + 1`` consecutive hashes of
``k`` bytes, with the first and the last position of a text besides.  Spark
sorts these positions by the digest of their first k bytes, which gives their
first ranks, then by the ranks of four parts at growing offsets (1, 4, 16, ...
sampled positions on, with the distances in bytes), and ranks them anew, until a position
is unique or its string is past what the strings between it and the next sampled
position need.  Neighbouring samples are at most k bytes apart, so equal ranks
say that all bytes are equal, and every string of ``length`` bytes in there is a
repeat.

What is left is near the ends of repeats: positions that hold a repeated sample
and lie in no such string.  For these, and for one member of each class that
shares a sample with them, the strings of ``length`` bytes at every position are
ranked themselves by their digests.
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
from millrace.llm.ranking import ranked
from millrace.llm.rlz import _arrays
from millrace.llm.words import mix, pieces

LENGTH, K = 400, 273
#: Samples needed by one that has no string of ``length`` bytes: more than there are.
_NEVER = 32767
#: Bytes of text whose hashes are held at once, and of short texts that are hashed together.
_SLICE, _TOGETHER = 1 << 20, 1 << 16
#: Odd, so that each has an inverse modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Rolling:
    """Digests of 64 bits of all strings of one length in a slice of bytes: a polynomial modulo 2**64, mixed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Of the terms of the polynomial before each position, from which :meth:`of` takes digests."""
        if len(self.up) < len(data):
            powers = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(data) - 1, b, np.uint64), dtype=np.uint64)])
            self.up, self.down = powers(self.base), powers(self.inverse)
        sums = np.zeros(len(data) + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self.up[: len(data)]
        np.cumsum(terms, out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
        if at is None:
            found = sums[length:] - sums[:-length]
            found *= self.down[: len(found)]
        else:
            found = (sums[at + length] - sums[at]) * self.down[at]
        return mix(found)

    def __call__(self, data: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
        return self.of(self.sums(data), length, at)


_ROLLING = [_Rolling(b) for b in _BASES]


def _slid(values: np.ndarray, width: int, least) -> np.ndarray:
    """The least (np.minimum) or greatest of each ``width`` consecutive values, by doubling."""
    n, span = len(values) - width + 1, 1
    while 2 * span <= width:
        values = least(values[:-span], values[span:])
        span *= 2
    return least(values[:n], values[width - span : width - span + n]) if width > span else values


def minima_of(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(digest of the k bytes at each position, the least of them within each string of ``length`` bytes)."""
    h = _ROLLING[0](data, k)
    return h, _slid(h, length - k + 1, np.minimum)


def samples(text: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, two digests of their k bytes) of a text of at least ``length`` bytes, slice by slice."""
    w, n = length - k + 1, len(text)
    places, firsts, seconds = [], [], []
    for a in range(0, n - length + 1, _SLICE):
        # strings that begin in [a, b), and all whose samples may lie there
        b = min(a + _SLICE, n - length + 1)
        lo = max(0, a - w)
        data = text[lo : min(n, b + length + w)]
        h, low = minima_of(data, length, k)
        # a position is sampled if it is the least of some string around it: the greatest of their minima is its own
        padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
        at = np.flatnonzero(_slid(padded, w, np.maximum) == h) + lo
        last = b if b < n - length + 1 else n - k + 1
        at = at[(at >= a) & (at < last)]
        ends = [p for p in (0, n - k) if a <= p < last]
        at = np.unique(np.concatenate([at, np.array(ends, np.int64)]))
        places.append(at)
        firsts.append(h[at - lo])
        seconds.append(_ROLLING[1](data, k, at - lo))
    return np.concatenate(places), np.concatenate(firsts), np.concatenate(seconds)


def samples_together(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(where each text begins, positions, where each one's text ends, two digests): :func:`samples` of texts of at least ``length`` bytes, as of one that holds them all."""
    w = length - k + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = np.concatenate([[0], ends[:-1]])
    h, low = minima_of(data, length, k)
    # no string reaches into the next text, nor do the k bytes of a position
    low[(ends[:-1, None] - np.arange(1, length)).ravel()] = 0
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    sampled = _slid(padded, w, np.maximum) == h
    sampled[(ends[:-1, None] - np.arange(1, k)).ravel()] = False
    sampled[begins] = sampled[ends - k] = True
    at = np.flatnonzero(sampled)
    return begins, at, ends[np.searchsorted(begins, at, side="right") - 1], h[at], _ROLLING[1](data, k, at)


def needed(places: np.ndarray, n: int | np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sample (how many bytes to the next one, of how many samples the string must be that holds all strings that begin before the next).

    Where no string begins at a sample or after it, the first is by how much the last one begins before it, as a negative number.
    ``n`` is where the text ends; for samples of several texts, one after another, where that of each sample does.
    """
    gaps = np.minimum(np.append(places[1:], np.iinfo(np.int64).max), n - k + 1) - places
    ends = np.minimum(places + gaps + length - 1, n)
    many = np.searchsorted(places, ends - k) - np.arange(len(places)) + 1
    none = places > n - length
    return np.where(none, n - length - places, gaps), np.where(none, _NEVER, many)


def _bundles(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``_TOGETHER`` bytes; a longer one is alone."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > _TOGETHER:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _scan(length: int, k: int):
    """key, text -> key, n_bytes, sha256, samples (position, bytes to the next, samples needed, digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1), most=256):
                sizes = np.array([len(t) for t in texts])
                counts = np.zeros(len(texts) + 1, np.int32)
                found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
                some = np.flatnonzero(sizes >= length)
                own = [texts[i] for i in some]
                for a, b in _bundles(own):
                    if b - a > 1:
                        begins, places, ends, h1, h2 = samples_together(own[a:b], length, k)
                    else:
                        begins, ends = np.zeros(1, np.int64), len(own[a])
                        places, h1, h2 = samples(np.frombuffer(own[a], np.uint8), length, k)
                    gaps, many = needed(places, ends, length, k)
                    cuts = np.append(np.searchsorted(places, begins), len(places))
                    counts[some[a:b] + 1] = np.diff(cuts)
                    for f, v in zip(found, (places - np.repeat(begins, np.diff(cuts)), gaps, many, h1.view(np.int64), h2.view(np.int64))):
                        f.append(v)
                offsets = pa.array(np.cumsum(counts, dtype=np.int32))
                kinds = (np.int32, np.int16, np.int16, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.concatenate(f).astype(kind)) for f, kind in zip(found, kinds)], ["s", "gap", "need", "h1", "h2"])),
                    ],
                    names=["key", "n_bytes", "sha", "samples"],
                )

    return run


def _lists(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, values as flat arrays) of columns of arrays that have the same lengths."""
    columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
    return columns[names[0]].offsets.to_numpy(), {n: c.values.to_numpy(zero_copy_only=False) for n, c in columns.items()}


def _by_key(rows: DataFrame, order: str, make, schema: str) -> DataFrame:
    """``make`` of the rows of whole texts at a time, as arrays by column, in the order of key and ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def arrays(table: pa.Table) -> dict[str, np.ndarray]:
            columns = {n: table.column(n).to_numpy() for n in table.column_names}
            at = np.lexsort((columns[order], columns["key"]))
            return {n: v[at] for n, v in columns.items()}

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            keys = table.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # what follows may go on in the next batch
            if whole:
                yield make(arrays(table.slice(0, whole)))
            held = table.slice(whole)
        if held is not None:
            yield make(arrays(held))

    # dealt out by a hash that no join below has used: an exchange that looks like one of a join is left out, and
    # the partitions of a union of joins are then coalesced apart from each other, which tears texts asunder.
    # Spark sorts by one number, which it does without comparing rows; within a text they are put in order above
    return rows.repartition(F.xxhash64("key")).sortWithinPartitions("key").mapInArrow(run, schema)


def _texts(key: np.ndarray) -> np.ndarray:
    """Where each text's rows begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def _apart(key: np.ndarray) -> np.ndarray:
    """For each row a number by which its text lies beyond the one before: further than any place in a text."""
    return np.repeat(np.arange(len(_texts(key)) - 1, dtype=np.int64) << 33, np.diff(_texts(key)))


def _parts(span: int):
    """Samples (key, no, s, gap, need, rank, done) of texts with any that isn't done -> those that are (``held``, with their rank as ``a``), and the ranks of four parts for the others: of ``span`` samples and the following ones."""

    def make(f: dict[str, np.ndarray]) -> pa.RecordBatch:
        cuts = _texts(f["key"])
        name = _apart(f["key"]) + f["no"]
        done = f["done"].astype(bool)
        # samples near a text's end serve the others only
        live = np.add.reduceat(~done & (f["need"] < _NEVER), cuts[:-1]) > 0
        # all parts have ranks of ``span`` samples; they overlap where that is just enough
        last = f["need"] <= 4 * span
        live = np.repeat(live, np.diff(cuts))
        i, old = np.flatnonzero(~done & live), np.flatnonzero(done & live)
        most = np.where(last[i], np.maximum(f["need"][i] - span, 0), 3 * span)
        others = []
        for part in (1, 2, 3):
            other = name[i] + np.minimum(part * span, most)
            j = np.minimum(np.searchsorted(name, other), len(name) - 1)
            others.append(np.where(name[j] == other, j, -1))
        whole = np.all([j >= 0 for j in others], axis=0)
        i, others = i[whole], [j[whole] for j in others]
        # how many samples the string has, so that a rank is of one length, and how far on its parts begin, all below 2**15
        shape = np.where(last[i], f["need"][i], 4 * span).astype(np.int64)
        for part, j in enumerate(others, 1):
            shape |= (f["s"][j] - f["s"][i]).astype(np.int64) << (16 * part)
        both, none = np.concatenate([i, old]), np.zeros(len(old), np.int64)
        columns = {n: f[n][both] for n in ("key", "no", "s", "gap", "need")} | {"a": f["rank"][both]}
        columns |= {n: np.concatenate([f["rank"][j], none]) for n, j in zip("bcd", others)}
        columns |= {"shape": np.concatenate([shape, none]), "done": np.concatenate([last[i], none == 0]), "held": np.arange(len(both)) >= len(i)}
        return pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in columns.items()})

    return make


_KEYS = ["a", "b", "c", "d", "shape"]
_PART = "key bigint, no int, s int, gap smallint, need smallint, a bigint, b bigint, c bigint, d bigint, shape bigint, done boolean, held boolean"


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans [start, end) that cover the same, in order, apart from each other."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > far[:-1]]))
    return starts[first], far[np.concatenate([first[1:], [len(starts)]]) - 1]


def _outside(starts: np.ndarray, ends: np.ndarray, cover_starts: np.ndarray, cover_ends: np.ndarray) -> np.ndarray:
    """Which spans are not within one of the covering ones (in order, apart)."""
    if not len(cover_starts):
        return np.ones(len(starts), bool)
    i = np.searchsorted(cover_starts, starts, side="right") - 1
    return (i < 0) | (cover_ends[np.maximum(i, 0)] < ends)


def _asked(length: int, k: int):
    """Samples (key, s, gap, rank) and strings (key, s, gap, own) -> (key, open, rank, at, s, gap): samples around strings of no class, and around the member that stands for a class, with its strings."""
    w = length - k + 1

    def make(f: dict[str, np.ndarray]) -> pa.RecordBatch:
        cuts, out = _texts(f["key"]), []
        for a, b in zip(cuts[:-1], cuts[1:]):
            one = {n: v[a:b] for n, v in f.items()}
            key, sample, own = one["key"][0], one["sample"].astype(bool), one["own"].astype(bool)
            s, rank, back = one["s"][sample].astype(np.int64), one["rank"][sample], np.minimum(one["gap"][sample], 0)
            at, gap = one["s"][~sample].astype(np.int64), one["gap"][~sample].astype(np.int64)
            open_ = _outside(np.maximum(s - w + 1, 0), s + back + 1, *_merged(at, at + gap))
            n = int(open_.sum())
            out.append((np.full(n, key), np.ones(n, bool), rank[open_], s[open_], np.zeros(n, np.int64), np.zeros(n, np.int64)))
            at, gap = at[own[~sample]], gap[own[~sample]]
            lo = np.searchsorted(s, at)
            many = np.searchsorted(s, at + gap + w - 1) - lo
            n = int(many.sum())
            around = np.arange(n) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            out.append((np.full(n, key), np.zeros(n, bool), rank[around], s[around], np.repeat(at, many), np.repeat(gap, many)))
        kinds = (np.int64, bool, np.int64, np.int32, np.int32, np.int16)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(kind)) for c, kind in zip(zip(*out), kinds)], names=["key", "open", "rank", "at", "s", "gap"])

    return make


def _listed(names: list[str], kinds: list):
    """Rows of a text -> one row with an array for each column."""

    def make(f: dict[str, np.ndarray]) -> pa.RecordBatch:
        cuts = _texts(f["key"])
        lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(f[n].astype(kind))) for n, kind in zip(names, kinds)]
        return pa.RecordBatch.from_arrays([pa.array(f["key"][cuts[:-1]]), *lists], names=["key", *names])

    return make


def _united(f: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Spans (key, s, e) by key and s -> (key, s, e): arrays of spans that cover the same, apart from each other."""
    cuts, apart = _texts(f["key"]), _apart(f["key"])
    starts, ends = _merged(f["s"] + apart, f["e"] + apart)
    offsets = np.searchsorted(starts, np.append(apart[cuts[:-1]], np.int64(len(cuts) - 1) << 33))
    lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((v & ((1 << 33) - 1)).astype(np.int32))) for v in (starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(f["key"][cuts[:-1]]), *lists], names=["key", "s", "e"])


def _marked(spans: tuple[np.ndarray, np.ndarray], a: int, b: int) -> np.ndarray:
    """Which positions of [a, b) the spans (in order, apart) hold."""
    steps = np.zeros(b - a + 1, np.int8)
    starts, ends = (np.clip(v - a, 0, b - a) for v in spans)
    some = ends > starts
    np.add.at(steps, starts[some], 1)
    np.add.at(steps, ends[some], -1)
    return np.cumsum(steps[:-1]) > 0


def _held(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which values are among ``by``."""
    if not len(by):
        return np.zeros(len(values), bool)
    by = np.sort(by)
    return by[np.minimum(np.searchsorted(by, values), len(by) - 1)] == values


def _strings(length: int, k: int):
    """key, text, arrays s, gap, kind -> (key, at, two digests) of the strings of ``length`` bytes that are to be ranked themselves.

    Kind 0 is a repeated sample, 1 a position all of whose strings up to the
    next sample are repeats, 2 one whose strings are asked for if they hold a
    sample of kind 3.
    """
    w = length - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, f = _lists(batch, ["s", "gap", "kind"])
            keys = batch.column(0).to_numpy()
            for at, all_texts in pieces(batch.column(1), most=256):
                for lo, hi in _bundles(all_texts):
                    # short texts as one that holds them all; no string begins where it would reach into the next
                    ends = np.cumsum([len(t) for t in all_texts[lo:hi]])
                    begins = np.concatenate([[0], ends[:-1]])
                    first, last = cuts[at + lo], cuts[at + hi]
                    of = np.repeat(np.arange(hi - lo), np.diff(cuts[at + lo : at + hi + 1]))
                    s, gap, kind = f["s"][first:last] + begins[of], f["gap"][first:last].astype(np.int64), f["kind"][first:last]
                    stop = ends[of] - length + 1
                    near = _merged(*(v[kind == 0] for v in (np.maximum(s - w + 1, begins[of]), np.minimum(s + 1, stop))))
                    known = _merged(s[kind == 1], s[kind == 1] + gap[kind == 1])
                    asked = _merged(*(v[kind == 2] for v in (s, np.minimum(s + gap, stop))))
                    text = np.frombuffer(b"".join(all_texts[lo:hi]) if hi - lo > 1 else all_texts[lo], np.uint8)
                    samples = [np.unique(s[kind == n]) for n in (0, 3)]
                    n = len(text)
                    for a in range(0, n - length + 1, _SLICE):
                        b = min(a + _SLICE, n - length + 1)
                        marks = [_marked(spans, a, b) for spans in (near, known, asked)]
                        wanted = marks[0] & ~marks[1], marks[2]
                        if not (wanted[0] | wanted[1]).any():
                            continue
                        data = text[a : b + length - 1]
                        sums = _ROLLING[0].sums(data)
                        h = _ROLLING[0].of(sums, k)
                        low = _slid(h, w, np.minimum)
                        # only strings whose least sample, the one that every copy has, is repeated, or shared with a string of no class
                        chosen = []
                        for which, v in zip(wanted, samples):
                            p = np.flatnonzero(which)
                            chosen.append(p[_held(low[p], h[v[(v >= a) & (v < a + len(h))] - a])])
                        p = np.union1d(*chosen)
                        second = _ROLLING[1].sums(data)
                        for c in range(0, len(p), 1 << 16):
                            q = p[c : c + (1 << 16)]
                            own = np.searchsorted(begins, q + a, side="right") - 1
                            digests = (r.of(x, length, q).view(np.int64) for r, x in zip(_ROLLING, (sums, second)))
                            yield pa.RecordBatch.from_arrays([pa.array(keys[at + lo + own]), pa.array((q + a - begins[own]).astype(np.int32)), *map(pa.array, digests)], names=["key", "at", "h1", "h2"])

    return run


def _cut(length: int):
    """key, text, arrays s and e of spans to remove -> key, n_removed, kept_sha256, starts and ends of the maximal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, f = _lists(batch, ["s", "e"])
            removed, shas, begins, finishes = [], [], [], []
            for at, texts in pieces(batch.column(1)):
                for d, t in enumerate(texts, at):
                    starts, ends = _merged(*(np.minimum(f[n][cuts[d] : cuts[d + 1]].astype(np.int64), len(t)) for n in ("s", "e")))
                    kept = hashlib.sha256()
                    for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(t)]):
                        kept.update(t[a:b])
                    removed.append(int((ends - starts).sum()))
                    shas.append(kept.hexdigest())
                    begins.append(starts)
                    finishes.append(ends)
            yield pa.RecordBatch.from_pydict(
                {"key": batch.column(0), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string()), "starts": _arrays(begins, np.int32), "ends": _arrays(finishes, np.int32)}
            )

    return run


def ranks(scanned: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(samples that occur more than once (key, s, gap, rank), strings past the threshold that do (key, s, gap, own), the tables under both).

    ``own`` marks one member of each class of strings.
    """
    rows = scanned.select("key", F.posexplode("samples").alias("no", "x")).select("key", "no", "x.*")
    told, table = ranked(rows, ["h1", "h2"], ["key", "no"], "suffix-samples", drop_alone=True, forget=True)
    own = (F.col("first") == F.col("place")).alias("own")
    state = told.select("key", "no", "s", "gap", "need", F.col("first").alias("rank"), (F.col("need") <= 1).alias("done"), own)
    tables, found, span, base, held = [table], [state.where("done")], 1, 0, None
    live = f"NOT done AND need < {_NEVER}"
    while not state.where(live).isEmpty():
        # strings past the threshold keep their last rank, which is of a longer string than is asked for
        before = state.drop("own") if held is None else state.drop("own").unionByName(held.where("held").withColumnRenamed("a", "rank").select("key", "no", "s", "gap", "need", "rank", "done"))
        parts = materialize(_by_key(before, "no", _parts(span), _PART), "suffix-parts", _KEYS)
        if held is not None:
            discard(held)
        held = parts
        again, table = ranked(parts.where("NOT held").drop("held"), _KEYS, ["key", "no"], "suffix-ranks", drop_alone=True, forget=True)
        tables.append(table)
        # ranks of a round are beyond all of the rounds before, so that none means two strings
        base, span = base + (1 << 48), 4 * span
        state = again.select("key", "no", "s", "gap", "need", (F.col("first") + F.lit(base)).alias("rank"), "done", own)
        found.append(state.where("done"))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    # one table, so that the plans to come stay small
    whole = materialize(whole.select("key", "s", "gap", "own"), "suffix-whole")
    first = told.select("key", "s", "gap", F.col("first").alias("rank"))
    discard(*tables[1:], *([held] if held is not None else []))
    return first, whole, [tables[0], whole]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, text) with a unique long key, and (id, key) if it isn't the id: whole numbers that are unique and never null are the keys."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    if isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        ids = docs.select(F.col(id_col).cast("long").alias("key"))
        if ids.groupBy("key").count().where("key IS NULL OR count > 1").isEmpty():
            return docs.select(F.col(id_col).cast("long").alias("key"), text), None
    rows = materialize(docs.select(F.col(id_col).alias("id"), text, F.monotonically_increasing_id().alias("key")), "suffix-texts")
    return rows.select("key", "text"), rows.select("id", "key")


def _of(texts: DataFrame, wanted: DataFrame, broadcast_keys: int = 1_000_000) -> DataFrame:
    """Texts with the columns of ``wanted`` (key, ...), a written table with a row for some of them.

    Up to ``broadcast_keys`` keys (8 bytes each, counted first) go to every
    executor, so that the other texts aren't shuffled.
    """
    if wanted.count() <= broadcast_keys:
        texts = texts.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    return texts.join(wanted.hint("shuffle_merge"), "key")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, kept_sha256, spans.

    ``spans`` are the maximal byte ranges [start, end) of the text's UTF-8 that
    are covered by strings of ``length`` bytes which also start anywhere else,
    in another document or at another place of the same one; overlapping ones
    count, and strings are judged on the input.  All occurrences go, the first
    as well.  Matches never cross documents.  Null texts are empty; texts
    shorter than ``length`` lose nothing.  Rows that repeat a null or any other
    id are documents of their own.  Other columns are not read.

    Strings are told apart by two digests of 64 bits, ranks by their order.
    Samples are sorted by ranges of digest or pair and position together, so a
    string that a third of all documents hold is dealt over tasks; a task holds
    one text and its samples, and the hashes of about a megabyte of it.  Jobs
    run when this is called.
    """
    w = length - k + 1
    if not 1 <= w <= k or length >= 1 << 14:
        raise ValueError("samples leave no gap only if length - k + 1 is 1 to k; lengths are below 16384")
    texts, ids = _numbered(docs, id_col, text_col)
    scanned = materialize(
        texts.mapInArrow(_scan(length, k), "key bigint, n_bytes bigint, sha string, samples array<struct<s:int,gap:smallint,need:smallint,h1:bigint,h2:bigint>>"), "suffix-scanned"
    )
    counts = materialize(scanned.select("key", "n_bytes", "sha"), "suffix-counts")
    first, whole, tables = ranks(scanned)
    discard(scanned)
    # samples around strings that are in no class, and the members of classes that share one with them
    nothing = F.lit(0).cast("bigint").alias("rank"), F.lit(False).alias("own")
    around = first.select("key", "s", "gap", "rank", nothing[1], F.lit(True).alias("sample")).unionByName(whole.select("key", "s", "gap", nothing[0], "own", F.lit(False).alias("sample")))
    asked = materialize(_by_key(around, "s", _asked(length, k), "key bigint, open boolean, rank bigint, at int, s int, gap smallint"), "suffix-asked")
    open_ = materialize(asked.where("open").groupBy("rank").agg(F.count(F.lit(1)).alias("n")), "suffix-open")
    members = materialize(asked.where("NOT open").join(open_, "rank").select("key", "at", "s", "gap"), "suffix-members")
    kind = lambda rows, n: rows.select("key", "s", "gap", F.lit(n).cast("smallint").alias("kind"))
    shared = members.select("key", F.col("at").alias("s"), F.lit(0).cast("smallint").alias("gap"))
    spans = kind(first, 0).unionByName(kind(whole, 1)).unionByName(kind(members, 2)).unionByName(kind(shared, 3))
    some = asked.where("open").select("key").unionByName(members.select("key")).distinct()
    spans = _by_key(spans.join(some, "key", "left_semi"), "s", _listed(["s", "gap", "kind"], [np.int32, np.int16, np.int16]), "key bigint, s array<int>, gap array<smallint>, kind array<smallint>")
    spans = materialize(spans, "suffix-spans")
    strings = _of(texts, spans).select("key", "text", "s", "gap", "kind")
    strings = materialize(strings.mapInArrow(_strings(length, k), "key bigint, at int, h1 bigint, h2 bigint"), "suffix-strings", ["h1", "h2"])
    discard(asked, open_, members, spans)
    again, sorted_ = ranked(strings, ["h1", "h2"], ["key", "at"], "suffix-repeats", drop_alone=True, forget=True)
    discard(strings)
    # a string past the threshold holds all strings that begin before the next sample
    spans = whole.select("key", "s", (F.col("s") + F.col("gap") + F.lit(length - 1)).alias("e")).unionByName(again.select("key", F.col("at").alias("s"), (F.col("at") + F.lit(length)).alias("e")))
    spans = materialize(_by_key(spans, "s", _united, "key bigint, s array<int>, e array<int>"), "suffix-spans")
    discard(sorted_, *tables)
    changed = _of(texts, spans).select("key", "text", "s", "e")
    changed = materialize(changed.mapInArrow(_cut(length), "key bigint, n_removed bigint, kept_sha256 string, starts array<int>, ends array<int>"), "suffix-changed")
    discard(spans)
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = counts.join(changed, "key", "left").select(
        "key",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")), none).alias("spans"),
    )
    named = out.withColumn("id", F.col("key").cast(docs.schema[id_col].dataType)) if ids is None else out.join(ids, "key")
    return named.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "kept_sha256", "spans")
