"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a binary classifier over
hashed byte n-grams tells the languages whose bit is 1 from the others.  A text
gets the language whose codeword has the least loss, bits weighted by how
reliable their classifier was in training.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import pieces

DIMENSIONS = 1 << 12
ORDERS = (1, 2, 3, 4)
UNDETERMINED = "und"
_CHUNK = 1 << 20
#: Texts whose features are held at once (16 KB each).
_ROWS = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """n codewords of -1/+1 bits, one row per class.

    Up to 6 classes get the exhaustive code (every split of the classes into
    two non-empty sides, 2**(n-1) - 1 bits); more get the random code of
    12 * log2(n) bits with the largest least distance of 200 drawn.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        sides = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(sides, float).T
    rng, best, most = np.random.default_rng(seed), None, -1.0
    bits = int(np.ceil(12 * np.log2(n)))
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, apart.min()
    return best


def features(texts: list[bytes], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row per text: log counts of hashed byte n-grams of the whole text, of length 1.

    Digits and ASCII punctuation count as spaces, A-Z as a-z.  Long texts are
    counted in overlapping chunks, so memory doesn't grow with a text.
    """
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts):
        for at in range(0, max(1, len(text)), _CHUNK):
            data = _LETTERS[np.frombuffer(text[at : at + _CHUNK + max(ORDERS) - 1], np.uint8)].astype(np.uint64)
            code = np.zeros(len(data), np.uint64)
            for order in ORDERS:
                # grams that start in this chunk; the overlap belongs to the next
                n = min(_CHUNK, len(data) - order + 1)
                if n <= 0:
                    break
                code = code[: len(data) - order + 1] * np.uint64(256) + data[order - 1 :]
                slot = ((code[:n] + np.uint64(order << 40)) * _ODD >> np.uint64(64 - int(dimensions).bit_length() + 1)).astype(np.int64)
                row += np.bincount(slot, minlength=dimensions).astype(np.float32)
    np.log1p(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalpha():
            table[b] = b + 32 if 65 <= b <= 90 else b
    return table


_LETTERS = _letters()


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # dimension x bit
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str], steps: int = 60, rate: float = 8.0, decay: float = 1e-5) -> Model:
        languages = sorted(set(labels))
        code = codewords(len(languages))
        bits = code.shape[1]
        y = code[[languages.index(v) for v in labels]] if labels else np.zeros((0, bits))
        weights, bias = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
        speed = np.zeros_like(weights)
        # the rarer side of a bit weighs as much as the other
        share = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(0), 1), 0.5 / np.maximum((y < 0).sum(0), 1)).astype(np.float32)
        for _ in range(steps if bits else 0):
            pull = -y / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30))) * share
            speed = 0.9 * speed - rate * (x.T @ pull + decay * weights)
            weights = (weights + speed).astype(np.float32)
            bias -= (rate * 0.1 * pull.sum(0)).astype(np.float32)
        right = (np.sign(x @ weights + bias) == y).mean(0) if len(y) else np.ones(bits)
        trust = np.log((right + 1e-3) / (1 - right + 1e-3))
        trust = np.maximum(trust, 0) / max(np.maximum(trust, 0).sum(), 1e-9) if bits else trust
        return cls(languages, code, weights, bias, trust)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score 0 to 1, margin to the next) by weighted logistic loss."""
        n = len(x)
        if len(self.languages) < 2:
            return np.zeros(n, int), np.ones(n), np.ones(n)
        margins = np.clip(x @ self.weights + self.bias, -30, 30)
        loss = np.stack([np.log1p(np.exp(-row * margins)) @ self.trust for row in self.code], axis=1)
        likely = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        likely /= likely.sum(1, keepdims=True)
        ranked = np.sort(likely, axis=1)
        return loss.argmin(1), ranked[:, -1], ranked[:, -1] - ranked[:, -2]


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 2000) -> Model:
    """Fit on a bounded sample: about ``sample_rows`` rows in all, evenly by language, whole texts.

    Which rows is decided by a hash of the id, so the sample is the same at
    every run and taken where the rows are.

    Rows with a null text or language are no examples.  Texts are turned into
    feature vectors on the executors; the driver gets those (16 KB a row).
    """
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().collect()}
    scale = 1 << 30
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, int(scale * min(1.0, sample_rows / len(counts) / n))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(scale)) < share)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for at, texts in pieces(batch.column(1), 4 << 20, _ROWS):
                x = features(texts).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"lang": langs.slice(at, len(texts)), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    found = sample.select(F.col(lang_col), F.col(text_col)).mapInArrow(extract, "lang string, x binary").collect()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32) if found else np.zeros((0, DIMENSIONS), np.float32)
    return Model.fit(x, [r["lang"] for r in found])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (0 to 1), margin, ambiguous.

    The whole text decides.  ``und`` with score 0 where the text is null, has
    no letter, or no language was learned; with one learned language every
    other text is of that one.  ``ambiguous`` marks a margin between the first
    and the second language below ``ambiguous_below``.  Ties go to the
    language first in alphabetical order.  Rows that repeat are judged alike,
    an empty table gives no rows, other columns of ``docs`` are not read, and
    bytes that are not UTF-8 are no letters.  Nothing is shuffled.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = shipped.value
        for batch in batches:
            ids = batch.column(0)
            for at, texts in pieces(batch.column(1), most=_ROWS):
                best, score, margin = known.decode(features(texts)) if known.languages else (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)))
                none = np.array([not known.languages or not _has_letter(t) for t in texts], bool)
                yield pa.RecordBatch.from_pydict(
                    {
                        id_col: ids.slice(at, len(texts)),
                        "lang_pred": pa.array([UNDETERMINED if n else known.languages[b] for n, b in zip(none, best)], pa.string()),
                        "score": pa.array(np.where(none, 0.0, score), pa.float64()),
                        "margin": pa.array(np.where(none, 0.0, margin), pa.float64()),
                        "ambiguous": pa.array(none | (margin < ambiguous_below)),
                    }
                )

    schema = f"`{id_col}` {id_type}, lang_pred string, score double, margin double, ambiguous boolean"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(predict, schema)


def _has_letter(text: bytes) -> bool:
    # most texts have one among the first characters; the rest is read only if not
    return any(map(str.isalpha, text[:64].decode("utf-8", "ignore"))) or any(map(str.isalpha, text.decode("utf-8", "ignore")))
