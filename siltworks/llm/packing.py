"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

A document is placed where the squared counts of open sequences per residual gap become smallest. Documents are dealt
into groups of a bounded number of pieces by hash, each group being packed by one task; the smallest pieces of a group
are kept to the end and close the gaps the rule leaves, tightest first. A document longer than a sequence is cut into
full sequences, which need no placing, and its shorter first piece, which is placed like a document.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.frames import map_rows, octets, text_of, written

CAPACITY = 2048
# Pieces that one task packs at a time; the waste of a group is about one sequence.
GROUP_PIECES = 24_000
# Shares of the pieces, smallest ones, that are kept to the end; the one that needs fewest sequences is taken.
LAST_SHARES = (0.3, 0.5, 0.7)
# Distinct words whose ids a task remembers.
REMEMBERED = 300_000
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


# Fixed values of the byte-level vocabulary: how it splits texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD_SPACE = re.compile(r"^\s|\s$| \s|\s |[^\S \n]")


def _byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: printable Latin-1 as itself, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class _Known(dict):
    """Ids of the words met so far, each behind a space."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = array("I", self.encode(" " + word)).tobytes()
        return ids


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes.

    A byte-level vocabulary joins one space to the word behind it, so a single space between two other characters always
    begins a new word. Such words are tokenised once and remembered; a text with other spacing, or with the text of a
    special token, is tokenised whole. Words go through the same vocabulary as ranks, which is quick on short texts.
    """

    def __init__(self, tokenizer, remembered: int = REMEMBERED) -> None:
        self.tokenizer, self.limit = tokenizer, remembered
        letter = {c: b for b, c in enumerate(_byte_letters())}
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letter[c] for c in t): i for t, i in tokenizer.get_vocab().items() if t not in special}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.words.encode_ordinary)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> list[str] | None:
        """The words between the single spaces of a text without other white space than these and line breaks inside it, and without a special token."""
        if not text or text[0].isspace() or text[-1].isspace() or any(s in text for s in self.special):
            return None
        if any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return None if _ODD_SPACE.search(text) else text.split(" ")
        # Separators stand alone here, so any other white space would make more words than they do.
        return text.split(" ") if len(text.split()) == text.count(" ") + text.count("\n") + 1 else None

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        split = [self._plain(t) for t in texts]
        whole = iter(self._encode([t for t, w in zip(texts, split) if w is None]))
        behind, first = self.known.__getitem__, self.words.encode_ordinary
        # The first word of a text has no space before it.
        return [next(whole) if w is None else b"".join([array("I", first(w[0])).tobytes(), *map(behind, w[1:])]) for w in split]


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: one, or a shorter first piece and full ones."""
    first = total if total <= capacity else total % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, total, capacity)]


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """The pieces of each row of ``df``: doc_id, copy, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its token ids and ``end_id``; null and empty texts are ``end_id`` alone, so every row has a piece.
    ``copy`` tells repeated rows (and rows without identifier) apart. Whole texts are tokenised.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("copy", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from tokenizers import Tokenizer

        ids_of = WordIds(Tokenizer.from_file(tokenizer_path))
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.decode("utf-8", "replace") for t in octets(part.column(1))]
                for doc, copy, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), ids_of.encode(texts)):
                    ids += end
                    for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        row = (doc, copy, k, start, length, zlib.crc32(own))
                        yield (*row, np.frombuffer(own, "<u4").astype(np.int32)) if keep_ids else row

    return map_rows(rows, cut, PIECES + (", ids array<int>" if keep_ids else ""))


def place(sizes: np.ndarray, capacity: int, last_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each size, taken in the order given but for the smallest ones, which come last."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; full ones are not open
    open_at: dict[int, list[int]] = {}
    begun = 0

    def put(i: int, gap: int, s: int) -> None:
        nonlocal begun
        if gap == capacity:
            at, begun = begun, begun + 1
        else:
            at = open_at[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > s:
            open_at.setdefault(gap - s, []).append(at)
            count[gap - s] += 1

    last = np.zeros(len(sizes), bool)
    last[np.argsort(sizes, kind="stable")[: int(len(sizes) * last_share)]] = True
    for i in np.flatnonzero(~last):
        s = int(sizes[i])
        here = count[s:capacity]
        gap = capacity
        if len(here):
            change = np.where(here > 0, 2 * (count[: capacity - s] - here) + 2, np.iinfo(np.int64).max)
            change[0] -= here[0] > 0
            best = int(change.argmin())
            if here[best] > 0 and change[best] <= 2 * count[capacity - s] + 1:
                gap = best + s
        put(int(i), gap, s)
    gaps = [g for g in range(1, capacity + 1) for _ in range(count[g])]
    rest = np.flatnonzero(last)
    for i in rest[np.argsort(-sizes[rest], kind="stable")]:
        s = int(sizes[i])
        k = bisect.bisect_left(gaps, s)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        put(int(i), gap, s)
        if gap > s:
            bisect.insort(gaps, gap - s)
    return sequence, offset


def fewest(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of a few runs of ``place``: in the order given and largest first, with each of the shares."""
    down = np.argsort(-sizes, kind="stable")
    best = None
    for share in LAST_SHARES:
        for order in (np.arange(len(sizes)), down):
            sequence, offset = place(sizes[order], capacity, share)
            if best is None or sequence.max(initial=-1) < best[0].max(initial=-1):
                back = np.empty(len(sizes), np.int64)
                back[order] = np.arange(len(sizes))
                best = sequence[back], offset[back]
    return best


def pack(found: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset: no sequence is longer than ``capacity``, offsets leave no hole from 0.

    ``found`` should be a written table. Its columns are kept, ids too. Full pieces take a sequence each, unshuffled.
    The same pieces give the same packing. An empty table gives no rows.
    """
    partial = F.col("length") < capacity
    groups = max(1, math.ceil(found.where(partial).count() / group_pieces))
    narrow = found.where(partial).select("doc_id", "copy", "piece", "length", F.pmod(F.xxhash64("copy", "piece"), F.lit(groups)).alias("grp"))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["copy", "piece"]).sample(frac=1, random_state=7).reset_index(drop=True)
        sequence, offset = fewest(frame["length"].to_numpy(np.int64), capacity)
        # Groups have even numbers of their own; full pieces have odd ones.
        return pd.DataFrame({"copy": frame["copy"], "piece": frame["piece"], "sequence_id": (frame["grp"].to_numpy(np.int64) * 2**24 + sequence) * 2, "offset": offset})

    placed = narrow.groupBy("grp").applyInPandas(packed, "copy long, piece int, sequence_id long, offset long")
    part = found.where(partial).join(placed, ["copy", "piece"])
    full = found.where(~partial).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return part.select(*found.columns, "sequence_id", "offset").unionByName(full)


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack in one go; the pieces are written once in between."""
    return pack(written(pieces(df, tokenizer_path, id_col, text_col, capacity, keep_ids=keep_ids), "pieces"), capacity, group_pieces)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the training sequences themselves, from ``pack_documents(..., keep_ids=True)``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
