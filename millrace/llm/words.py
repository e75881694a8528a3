"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64


def byte_classes(is_word: Iterable[int], lower: bool) -> np.ndarray:
    """256 entries: 0 for a byte between words, else the byte (A-Z lowered if asked).

    A zero byte that belongs to words becomes 255, which UTF-8 never holds.
    """
    table = np.zeros(256, np.uint8)
    for b in is_word:
        table[b] = b + 32 if lower and 65 <= b <= 90 else b or 255
    return table


#: words ``[^\x20\x09-\x0D]+``, unchanged
SPACED = byte_classes((b for b in range(256) if b not in (32, 9, 10, 11, 12, 13)), lower=False)
#: words of letters, digits and everything beyond ASCII, A-Z lowered
ALNUM_LOWER = byte_classes((b for b in range(256) if b >= 128 or chr(b).isalnum()), lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """multiplier**i and its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
            ones = np.ones(n, np.uint64)
            self.up = np.concatenate([ones[:1], np.cumprod(ones[1:] * _MULTIPLIER, dtype=np.uint64)])
            self.down = np.concatenate([ones[:1], np.cumprod(ones[1:] * inverse, dtype=np.uint64)])
        return self.up, self.down


_POWERS = _Powers()


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each span, modulo 2**64."""
    up, down = _POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Words:
    """Words of a few texts: ``data[starts[i]:ends[i]]``; text d has words ``first[d]:first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], classes: np.ndarray) -> Words:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        data = classes[raw]
        inside = np.concatenate([[False], data != 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        return cls(data, starts, ends, np.searchsorted(starts, offsets))

    def hashes(self, size: int = 1 << 20) -> np.ndarray:
        """Hash of each word, taken over about ``size`` bytes at a time: a hash doesn't depend on where its word lies."""
        out, at, n = np.zeros(len(self.starts), np.uint64), 0, len(self.starts)
        while at < n:
            begin = int(self.starts[at])
            stop = max(at + 1, int(np.searchsorted(self.ends, begin + size, "right")))
            if self.ends[at] - begin > size:
                out[at] = self._long(begin, int(self.ends[at]), size)
            else:
                out[at:stop] = span_sums(self.data[begin : self.ends[stop - 1]], self.starts[at:stop] - begin, self.ends[at:stop] - begin)
            at = stop
        return mix(out + (self.ends - self.starts).astype(np.uint64) * _MULTIPLIER)

    def _long(self, begin: int, end: int, size: int) -> int:
        """The polynomial hash of one word longer than ``size`` from those of its parts."""
        total = 0
        for at in range(begin, end, size):
            part = self.data[at : min(end, at + size)]
            total += int(span_sums(part, np.array([0]), np.array([len(part)]))[0]) * pow(int(_MULTIPLIER), at - begin, 2**64)
        return total % 2**64

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def last(self) -> np.ndarray:
        """For each word the end of its text's words."""
        return np.repeat(self.first[1:], np.diff(self.first))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; the array is k - 1 shorter."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MULTIPLIER + hashes[j : j + n]
    return mix(out)


def pieces(column: pa.Array, size: int = 1 << 20, most: int = 1 << 30) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about ``size`` bytes and at most ``most`` texts, with the first one's index.

    A null text is empty.  A text is never cut: a run ends with the one that
    reaches ``size``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        # up to the text that reaches the size, converted run by run to hold little at once
        stop = min(len(column), at + most, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1)
        yield at, [t or b"" for t in column.slice(at, stop - at).to_pylist()]
        at = stop


def valid(raw: bytes) -> tuple[str, bytes]:
    """A text and its UTF-8; bytes that are not UTF-8 become U+FFFD."""
    try:
        return raw.decode(), raw
    except UnicodeDecodeError:
        text = raw.decode("utf-8", "replace")
        return text, text.encode()
