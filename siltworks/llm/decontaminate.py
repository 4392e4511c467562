"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, training windows scanned and verified.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A document word that is no
benchmark word breaks every window, so only runs of benchmark words are looked up; each lookup compares the whole window.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.frames import fresh, map_rows, numbered, octets, text_of, written

WINDOW = 10
# Benchmark text that one broadcast holds; a larger benchmark is scanned for in several passes, a block each.
BLOCK_BYTES = 16 * 1024 * 1024
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class NgramSet:
    """The windows of a block of benchmark items, as byte strings of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)], np.uint32)
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                self.windows.setdefault(n, {}).setdefault(ids[i : i + n].tobytes(), set()).add(item)

    def spans(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside any window that occurs, and the items these windows come from."""
        number = self.numbers.get
        ids = np.fromiter((number(w, 0) for w in found), np.uint32, len(found))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        hits, items = [], set()
        for n, windows in self.windows.items():
            if len(ids) >= n:
                for i in np.flatnonzero(known[n:] - known[:-n] == n):
                    owners = windows.get(ids[i : i + n].tobytes())
                    if owners:
                        hits.append((int(i), int(i) + n))
                        items |= owners
        return merge(hits), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "spans array<struct<a:long,b:long>>, items array<string>"


def _items(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """Items as (item, text), and the number of blocks they are cut into."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), text_of(text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    return items, max(1, math.ceil(total / block_bytes))


def _known(items: DataFrame, blocks: int, block: int, window: int) -> Broadcast:
    """The windows of one block of items on every executor."""
    rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
    return items.sparkSession.sparkContext.broadcast(NgramSet([(r["item"], r["text"].encode()) for r in rows], window))


def _carried(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    return zip(*[batch.column(i).to_pylist() for i in range(width)]) if width else iter([()] * batch.num_rows)


def _pairs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"a": a, "b": b} for a, b in spans]


def _in_blocks(rows: DataFrame, items: DataFrame, blocks: int, width: int, window: int, result: str) -> DataFrame:
    """A pass over all rows per block, each holding that block only and writing its hits; then the hits of a row are merged."""
    uid, text = fresh(rows, "uid"), rows.columns[width]
    held = numbered(rows, "decontaminate-rows", uid)
    written_hits = []
    for block in range(blocks):
        known = _known(items, blocks, block, window)

        def scan(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[tuple]:
            index = known.value
            for batch in batches:
                for row, whole in zip(batch.column(0).to_pylist(), octets(batch.column(1))):
                    spans, owners = index.spans(words(whole))
                    if spans:
                        yield row, _pairs(spans), sorted(owners)

        written_hits.append(written(map_rows(held.select(uid, text), scan, f"`{uid}` long, {_FOUND}"), "decontaminate-hits"))
        known.destroy()
    found = reduce(DataFrame.unionAll, written_hits).toDF(uid, "spans", "items")
    merged = found.groupBy(uid).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    names = [f"k{i}" for i in range(width)]
    joined = held.toDF(*names, "text", "uid").join(merged.toDF("uid", "spans", "items"), "uid", "left").select(*names, "text", "spans", "items")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            texts, before, owners = octets(batch.column(width)), batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()
            for key, whole, spans, names in zip(_carried(batch, width), texts, before, owners):
                yield *key, len(words(whole)), _pairs(merge([(s["a"], s["b"]) for s in spans or ()])), sorted(names or ())

    return map_rows(joined, finish, result)


def hits(df: DataFrame, benchmark: DataFrame, keys: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keys`` of each row of ``df`` with n_words, spans (of words, half-open, merged) and items (ids as sorted text).

    A window is ``window`` consecutive item words; an item with fewer, but not none, is one window. Null and empty texts
    have no words and no hits; items without words match nothing; a null item id reads ``null``; repeated items count
    once, repeated rows are all kept. Whole texts are scanned. A benchmark above ``block_bytes`` is scanned for in several
    passes, so a task never holds more than one block. ``keys`` must not be called n_words, spans or items.
    """
    own = df.select(*[F.col(f"`{k}`") for k in keys])
    rows = df.select(*own.columns, text_of(text_col).alias(fresh(own, "_t")))
    width = len(keys)
    kinds = T.StructType(rows.schema.fields[:width]).toDDL() if width else ""
    result = ", ".join(filter(None, (kinds, "n_words long", _FOUND)))
    items, blocks = _items(benchmark, item_col, item_text, block_bytes)
    if blocks > 1:
        return _in_blocks(rows, items, blocks, width, window, result)
    known = _known(items, 1, 0, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        index = known.value
        for batch in batches:
            for key, whole in zip(_carried(batch, width), octets(batch.column(width))):
                found = words(whole)
                spans, owners = index.spans(found)
                yield *key, len(found), _pairs(spans), sorted(owners)

    return map_rows(rows, scan, result)


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join(out) + text[end:]


def decontaminate(df: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """``df`` without contaminated rows, or (``remove="spans"``) with the contaminated passages cut out of their texts.

    Columns, null texts and repeated rows stay as they are. See ``hits`` for what counts.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
    plain = df.toDF(*inner.values())
    found = hits(plain, benchmark, list(inner.values()), text_col=inner[text_col], **options)
    if remove == "documents":
        return found.where(F.size("spans") == 0).select(*[F.col(i).alias(c) for c, i in inner.items()])
    at = list(inner.values()).index(inner[text_col])
    kind = T.StructType([f for f in found.schema.fields if f.name not in ("n_words", "spans", "items")])
    width = len(kind.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(width)], batch.column(width + 1).to_pylist()):
                row, spans = list(row[:-1]), row[-1]
                if spans:
                    row[at] = cut_spans(row[at].encode(), [(s["a"], s["b"]) for s in spans]).decode()
                yield tuple(row)

    return map_rows(found, cut, kind.toDDL()).select(*[F.col(i).alias(c) for c, i in inner.items()])


def contaminated(found: DataFrame) -> Column:
    return F.size(found["spans"]) > 0


__all__ = ["NgramSet", "contaminated", "cut_spans", "decontaminate", "fresh", "hits", "merge", "words"]
