"""Toxicity by multiple-instance learning: sentence probabilities combined by noisy-or, trained from document labels.

A sentence's logit is the sum of its words' weights; a word's weight is the sum of hashed features (the word itself and
its leading characters), so unseen forms of a known word count too. Only documents are labelled: the gradient of the
noisy-or passes the blame to the sentences that deserve it, and scoring names them.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.frames import give_back, map_rows, octets, text_of
from siltworks.llm.labelled import Bound, training_rows

SLOTS = 1 << 18
LEADS = (4, 5, 6, 7, 8, 9)
REMEMBERED = 400_000
# Rows whose texts and keys are Python objects at the same time.
TOGETHER = 256
OFFENDING = 0.5
# Score of every text where no model could be learnt: a share of toxic texts that a corpus may well have.
UNKNOWN = 0.1
_SENTENCE = re.compile(rb"[^.!?\n]+(?:[.!?]+|\n|$)|[.!?\n]+")
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the sentences, covering the whole text."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def features(word: bytes) -> list[int]:
    """Hashed slots of a word: itself and its leading bytes."""
    forms = [b"=" + word] + [b"^" + word[:n] for n in LEADS if len(word) >= n]
    return [zlib.crc32(f) % SLOTS for f in forms]


@dataclass
class SentenceModel:
    """Weights by slot, and the logit of a sentence without known words."""

    weights: np.ndarray
    bias: float

    @property
    def learnt(self) -> bool:
        """Whether there were both classes to learn from."""
        return self.bias == self.bias

    def word_weight(self, word: bytes) -> float:
        return float(self.weights[features(word)].sum())


class _Weights(dict):
    def __init__(self, model: SentenceModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.model.word_weight(word)
        return value


def fit(texts: list[bytes], labels: list[int], weights: list[float], rounds: int = 150, rate: float = 0.08, decay: float = 5e-5, least_share: float = 0.003) -> SentenceModel:
    """Noisy-or likelihood of the document labels, by Adam. Without both classes nothing is learnt."""
    if len(set(labels)) < 2:
        return SentenceModel(np.zeros(SLOTS, np.float32), float("nan"))
    number: dict[bytes, int] = {}
    tokens, sentence_of, doc_of, seen = array("i"), array("i"), array("i"), Counter()
    for d, text in enumerate(texts):
        own = set()
        for a, b in sentences(text):
            found = [number.setdefault(w, len(number)) for w in text[a:b].translate(_WORD_BYTES).split()]
            tokens.extend(found)
            sentence_of.extend([len(doc_of)] * len(found))
            doc_of.append(d)
            own.update(found)
        seen.update(own)
    tokens, sentence_of, doc_of = (np.frombuffer(a, np.int32) if len(a) else np.zeros(0, np.int32) for a in (tokens, sentence_of, doc_of))
    word_of, slot_of = array("i"), array("i")
    for i, word in enumerate(number):
        own = features(word)
        slot_of.extend(own)
        word_of.extend([i] * len(own))
    word_of, slot_of = (np.frombuffer(a, np.int32) if len(a) else np.zeros(0, np.int32) for a in (word_of, slot_of))
    # A slot counts only if enough documents have it, so that names of a single document are not learnt by heart.
    times = np.bincount(slot_of, np.array([seen[i] for i in range(len(number))], float)[word_of], SLOTS)
    used = times[slot_of] >= max(4, least_share * len(texts))
    word_of, slot_of = word_of[used], slot_of[used]
    y, w = np.array(labels, float), np.array(weights, float) / len(labels)
    v, bias = np.zeros(SLOTS), -6.0
    m, s, mb, sb = np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0
    n_sent = len(doc_of)
    for t in range(1, rounds + 1):
        u = np.bincount(word_of, v[slot_of], len(number))
        z = np.bincount(sentence_of, u[tokens], n_sent) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        blame = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0) * w
        g = blame[doc_of] * p
        gu = np.bincount(tokens, g[sentence_of], len(number))
        gv = np.bincount(slot_of, gu[word_of], SLOTS) + decay * v
        gb = g.sum()
        m, s = 0.9 * m + 0.1 * gv, 0.999 * s + 0.001 * gv * gv
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        up, down = 1 - 0.9**t, 1 - 0.999**t
        v -= rate * (m / up) / (np.sqrt(s / down) + 1e-8)
        bias -= rate * (mb / up) / (math.sqrt(sb / down) + 1e-8)
    return SentenceModel(v.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: Bound = Bound(), id_col: str = "doc_id", text_col: str = "text") -> SentenceModel:
    """Fit on a sample of at most ``bound`` labelled rows outside the held-out fold."""
    return fit(*training_rows(docs, labels, label, bound, id_col, text_col))


def score(df: DataFrame, model: SentenceModel, keys: list[str], text_col: str = "text", offending: float = OFFENDING) -> DataFrame:
    """``keys`` of each row with score (0 to 1) and worst: byte spans and probabilities of offending sentences.

    Null and empty texts have no sentence and score 0. If there was nothing to learn from, every text scores ``UNKNOWN``, below any
    usual threshold: without evidence nothing is called toxic. Whole texts are
    scored, repeated rows alike; no other column is an input. ``keys`` must not be called score or worst.
    """
    rows = df.select(*[F.col(f"`{k}`") for k in keys], text_of(text_col).alias("_t"))
    shared, width = df.sparkSession.sparkContext.broadcast(model), len(keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        judge = _judge(shared.value, offending)
        for part in _parts(batches):
            carried = zip(*[part.column(i).to_pylist() for i in range(width)]) if width else iter([()] * part.num_rows)
            for key, text in zip(carried, octets(part.column(width))):
                yield *key, *judge(text)

    return map_rows(rows, run, (kinds + ", " if kinds else "") + "score double, worst array<struct<start:int,end:int,p:double>>")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``TOGETHER`` rows: of so many texts are there Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def _judge(model: SentenceModel, offending: float) -> Callable[[bytes], tuple[float, list[dict]]]:
    """Score and offending sentences of a text."""
    bias, weight = model.bias, _Weights(model).__getitem__

    def judge(text: bytes) -> tuple[float, list[dict]]:
        if bias != bias:
            return UNKNOWN, []
        clean, worst = 0.0, []
        for a, b in sentences(text):
            z = bias + sum(map(weight, text[a:b].translate(_WORD_BYTES).split()))
            z = min(30.0, max(-30.0, z))
            clean -= math.log1p(math.exp(z))
            if z >= 0 or offending < 0.5:
                p = 1 / (1 + math.exp(-z))
                if p >= offending:
                    worst.append({"start": a, "end": b, "p": p})
        return 1 - math.exp(clean), worst

    return judge


def drop_toxic(df: DataFrame, model: SentenceModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose score reaches ``threshold``; columns, nulls and repeated rows stay as they are.

    A model that had nothing to learn from judges no row: all stay.
    """
    if not model.learnt:
        return df
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at, width = df.columns.index(text_col), len(df.columns)
    # A text is taken from its own column; what is no text travels as text beside it.
    judged = rows if isinstance(rows.schema[at].dataType, T.StringType) else rows.withColumn("_t", text_of(f"c{at}"))
    place, shared = (at if judged is rows else width), df.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(shared.value, OFFENDING)
        for part in _parts(batches):
            stays = [judge(text)[0] < threshold for text in octets(part.column(place))]
            yield part.select(range(width)).filter(pa.array(stays, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kept(batches)
        give_back()

    return judged.mapInArrow(run, rows.schema).toDF(*df.columns)
