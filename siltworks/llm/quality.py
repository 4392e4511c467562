"""Quality by compression: zstandard dictionaries built from good and from bad labelled texts.

A text that the good dictionary packs tighter than the bad one is likely good. Each text is compressed whole, in two
views: its bytes, and its shape (letter case, digits, marks and repeated words, one mark per word). The difference of
the two compressed sizes over their sum is the evidence of a view; a logistic curve fitted on other labelled rows
than the dictionaries turns the two differences into a calibrated score.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.frames import map_rows, octets, text_of
from siltworks.llm.labelled import Bound, training_rows

DICTIONARY_BYTES, LEVEL = 64 * 1024, 3
REMEMBERED = 300_000
_CLASS = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def _word_shape(word: bytes) -> bytes:
    """``Word,`` as ``Aa,``, ``WORD!!`` as ``AA!``: runs of a class are one mark, but capitals in a row are two."""
    return _RUN.sub(lambda m: b"AA" if m[1] == b"A" else m[1], word.translate(_CLASS)) + b" "


class _Shapes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = _word_shape(word)
        return value


def shape(text: bytes, known: dict[bytes, bytes]) -> bytes:
    """The shapes of the words; a word equal to the one before is ``=``."""
    found = text.split()
    same = map(operator.eq, found[1:], found)
    return b"".join([known[found[0]], *[b"= " if e else known[w] for w, e in zip(found[1:], same)]]) if found else b""


@dataclass
class QualityModel:
    """Dictionary contents of (bytes, shape) x (good, bad), and the weights of the two differences and of one."""

    dictionaries: list[tuple[bytes, bytes]]
    weights: np.ndarray


class Differences:
    """Normalised compressed-size differences of a text, one for each view: above 0 the good dictionary wins."""

    def __init__(self, dictionaries: list[tuple[bytes, bytes]]) -> None:
        self.pairs = [[self._compressor(d) for d in pair] for pair in dictionaries]
        self.known = _Shapes()

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)

    def of(self, text: bytes) -> tuple[float, ...]:
        out = []
        for view, (good, bad) in zip((text, shape(text, self.known)), self.pairs):
            g, b = len(good.compress(view)), len(bad.compress(view))
            out.append((b - g) / (b + g))
        return tuple(out)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b" "


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge * np.eye(len(beta)), x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(texts: list[bytes], labels: list[int], weights: list[float]) -> QualityModel:
    """Every second row of a class builds the dictionaries, the others fit the curve. Without both classes: one half."""
    y = np.array(labels, int)
    built = np.zeros(len(y), bool)
    for c in (0, 1):
        built[np.flatnonzero(y == c)[::2]] = True
    if min(np.bincount(y[~built], minlength=2)[:2], default=0) == 0:
        return QualityModel([(b" ", b" ")] * 2, np.zeros(3))
    known = _Shapes()
    views = [texts, [shape(t, known) for t in texts]]
    books = [tuple(_dictionary([v[i] for i in np.flatnonzero(built & (y == c))]) for c in (1, 0)) for v in views]
    measure = Differences(books)
    rest = np.flatnonzero(~built)
    x = np.array([[*measure.of(texts[i]), 1.0] for i in rest])
    return QualityModel(books, _logistic(x, y[rest].astype(float), np.array(weights)[rest]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: Bound = Bound(), id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on a sample of at most ``bound`` labelled rows outside the held-out fold."""
    return fit(*training_rows(docs, labels, label, bound, id_col, text_col))


def score(df: DataFrame, model: QualityModel, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` of each row with score, 0 to 1, higher for good.

    Whole texts are compressed; null and empty texts have no difference and score what the curve gives at 0. No other
    column is an input; repeated rows score alike. ``keys`` must not be called score.
    """
    rows = df.select(*[F.col(f"`{k}`") for k in keys], text_of(text_col).alias("_t"))
    shared, width = df.sparkSession.sparkContext.broadcast(model), len(keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        measure, beta = Differences(shared.value.dictionaries), shared.value.weights.tolist()
        for batch in batches:
            carried = zip(*[batch.column(i).to_pylist() for i in range(width)]) if width else iter([()] * batch.num_rows)
            for key, text in zip(carried, octets(batch.column(width))):
                z = beta[-1] + sum(b * d for b, d in zip(beta, measure.of(text)))
                yield *key, 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

    return map_rows(rows, run, (kinds + ", " if kinds else "") + "score double")


def keep_good(df: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``df`` without rows that score below ``threshold``; columns, nulls and repeated rows stay as they are.

    A model that had nothing to learn from judges no row: all stay.
    """
    if not model.weights.any():
        return df
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
    scored = score(df.toDF(*inner.values()), model, list(inner.values()), inner[text_col])
    return scored.where(F.col("score") >= threshold).select(*[F.col(i).alias(c) for c, i in inner.items()])
