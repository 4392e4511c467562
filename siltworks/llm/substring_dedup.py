"""Near-duplicate passages by compact windows over min-hashes.

A text is a row of word-shingle hashes. Under a hash function, all stretches around a position whose minimum it is share
that signature: a compact window, one node of the Cartesian tree over the hashes. Nodes at least a passage wide are kept;
they are the positions that are the minimum of some stretch of passage length. A passage holds half its length on one side of its
minimum, so each window is looked up under two keys: signature with the minimum of the half passage to its left, and
to its right. Windows travel once, sorted by key: a key of one text goes no further, and the windows of others are tied to the
first text under it, near copies and chance alike. A passage that is repeated exactly must
not depend on whose window came first: around windows with a shared key of the first function, each stretch of passage
length has the hash of all its shingles, and texts are tied to the first with that stretch. A pair of texts with such a
stretch, or on whose alignment enough windows agree, is verified on the texts themselves, interval by interval. Windows
that no verified passage covers are then laid beside the other texts before theirs under the key, the nearest first, until
one covers them or none is left. Texts come in the order of their
identifiers, so which copy is the first does not depend on the layout of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.llm.frames import map_rows, numbered, octets, text_mark, text_of, written
from siltworks.llm.jaccard_join import _A, _Hashes, _mix

FUNCTIONS = 3
ENOUGH = 2
# Positions of one passage may shift by so many words against each other.
DRIFT = 8
SLICE_MEMBERS = 256
# Each round looks at so many times as many texts under a key as the one before.
REACH = 16
# Texts are hashed together up to so many bytes; a longer one by itself.
TOGETHER = 1 << 20
# 24 bytes a row: what is broadcast stays below 48 MB.
BROADCAST_NUMBERS = 2_000_000
# Texts of a key that one block holds at most; pairs that are compared at a time, and slots that tell most of them apart.
BLOCK, PAIRS, SLOTS = 4096, 512, 4096
_SEEDS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SIDE_SEED = np.uint64(0xD6E8FEB86659FD93)
# What ASCII white space is, and the primes of xxh64.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


@dataclass(frozen=True)
class Passages:
    """Shingle length and least passage length in words, and least similarity as ``percent`` / 100."""

    shingle: int = 5
    words: int = 50
    percent: int = 80

    @property
    def width(self) -> int:
        return self.words - self.shingle + 1


def _turned(z: np.ndarray, bits: int) -> np.ndarray:
    return (z << np.uint64(bits)) | (z >> np.uint64(64 - bits))


def word_hashes(texts: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """xxh64 of the words of all texts, one behind the other, and how many words each text has.

    Words below 32 bytes are hashed in the steps of xxh64 for all of them at once; longer ones are looked up in ``known``.
    """
    whole = b" ".join([b"", *texts, b""]).lower()
    blank = _BLANK[np.frombuffer(whole, np.uint8)]
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, size = turns[::2], turns[1::2] - turns[::2]
    # Eight bytes from each place on; those behind the word are not looked at.
    octets_ = np.frombuffer(whole + bytes(8), np.uint8)
    eight = np.ndarray(len(whole) + 1, "<u8", octets_, strides=(1,))
    z = _P5 + size.astype(np.uint64)
    for i in range(3):
        use = np.flatnonzero(size >= 8 * i + 8)
        z[use] = _turned(z[use] ^ (_turned(eight[start[use] + 8 * i] * _P2, 31) * _P1), 27) * _P1 + _P4
    use = np.flatnonzero(size & 4)
    z[use] = _turned(z[use] ^ ((eight[start[use] + (size[use] & ~7)] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    for i in range(3):
        use = np.flatnonzero((size & 3) > i)
        z[use] = _turned(z[use] ^ (octets_[start[use] + (size[use] & ~3) + i].astype(np.uint64) * _P5), 11) * _P1
    z = (z ^ (z >> np.uint64(33))) * _P2
    z = (z ^ (z >> np.uint64(29))) * _P3
    z ^= z >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        z[i] = known[whole[start[i] : start[i] + size[i]]]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return z, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_row(text: bytes, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Hashes of the word shingles in order; none if there are fewer words."""
    h = word_hashes([text], known)[0]
    count = len(h) - size + 1
    if count < 1:
        return h[:0]
    z = _mix(h[:count] + np.uint64(size))
    for i in range(1, size):
        z = _mix(z * _A + h[i : count + i])
    return z


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width``, from running minima of blocks."""
    n = len(h)
    if n < width:
        return h[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


@dataclass(frozen=True)
class Rows:
    """Shingle hashes of several texts, one text behind the other; for each shingle, where its text begins and ends, and the text."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def whole(self, begin: np.ndarray, width: int) -> np.ndarray:
        """Whether the stretch of ``width`` at each place of ``begin`` lies in one text."""
        return begin + width <= self.end[begin]


def shingle_rows(texts: list[bytes], size: int, known: dict[bytes, int]) -> Rows:
    """``shingle_row`` of each text, in few steps for all of them."""
    h, words = word_hashes(texts, known)
    count = max(0, len(h) - size + 1)
    z = _mix(h[:count] + np.uint64(size))
    for i in range(1, size):
        z = _mix(z * _A + h[i : count + i])
    inside = np.arange(count) + size <= np.repeat(np.cumsum(words), words)[:count]
    counts = np.maximum(0, words - size + 1)
    ends = np.cumsum(counts)
    return Rows(z[inside], np.repeat(ends - counts, counts), np.repeat(ends, counts), np.repeat(np.arange(len(texts)), counts))


def _row_of_each(texts: list[bytes], size: int, known: dict[bytes, int]) -> Iterator[np.ndarray]:
    """``shingle_row`` of each text, worked out together up to ``TOGETHER`` bytes of text at a time."""
    ends, begin = np.cumsum([len(t) for t in texts]), 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - len(texts[begin]) + TOGETHER, "right")))
        rows = shingle_rows(texts[begin:end], size, known)
        bounds = np.searchsorted(rows.text, np.arange(end - begin + 1)).tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield rows.h[a:b]
        begin = end


def _least_places(h: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the minimum of each stretch of ``width``."""
    low = (np.uint64(1) << np.uint64(max(1, int(len(h)).bit_length()))) - np.uint64(1)
    return (sliding_minimum((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low).astype(np.int64)


def window_positions(h: np.ndarray, width: int, rows: Rows | None = None) -> np.ndarray:
    """Positions whose compact window (the widest stretch they are the leftmost minimum of) is at least ``width`` wide.

    With ``rows``, ``h`` are hashes of their shingles, and windows stay within a text.
    """
    least = _least_places(h, width)
    if rows is not None:
        least = least[rows.whole(np.arange(len(least)), width)]
    # The place of the minimum never moves back.
    return least[np.flatnonzero(np.diff(least, prepend=-1))]


def stretches(rows: Rows, width: int, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the stretches of ``width`` whose minimum under the first function is at one of the positions."""
    least = _least_places(_mix(rows.h * _SEEDS[0]), width)
    wanted = np.zeros(len(rows.h), bool)
    wanted[around] = True
    at = np.flatnonzero(wanted[least] & rows.whole(np.arange(len(least)), width))
    # Sums of shingles times rising powers, brought back to the power 0 by the inverse.
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(rows.h), _A)]))
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(rows.h), np.uint64(pow(int(_A), -1, 1 << 64)))]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(rows.h) * up[:-1])])
    return _mix((sums[at + width] - sums[at]) * down[at]).view(np.int64), at


def window_keys(rows: Rows, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, positions) of the compact windows of the texts, for each function and side; the last two bits name the function."""
    half = width // 2
    side = sliding_minimum(_mix(rows.h * _SIDE_SEED), half)
    for f, seed in enumerate(_SEEDS[:FUNCTIONS]):
        h = _mix(rows.h * seed)
        at = window_positions(h, width, rows)
        for s, shift in enumerate((half - 1, 0)):
            use = at[(at - shift >= rows.start[at]) & (at - shift + half <= rows.end[at])]
            keys = _mix(_mix(h[use] * _A + side[use - shift]) + np.uint64(2 * f + s + 1))
            yield ((keys & ~np.uint64(3)) | np.uint64(f)).view(np.int64), use


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes], list]]:
    """(uids, texts, what the third column holds, if there is one) of batches (uid, text, ...), up to ``TOGETHER`` bytes of text at a time."""
    uids, texts, more, size = [], [], [], 0
    for batch in batches:
        others = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for uid, text, other in zip(batch.column(0).to_pylist(), octets(batch.column(1)), others):
            if texts and size + len(text) > TOGETHER:
                yield uids, texts, more
                uids, texts, more, size = [], [], [], 0
            uids.append(uid)
            texts.append(text)
            more.append(other)
            size += len(text)
    if texts:
        yield uids, texts, more


def _slices(*columns: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
    for i in range(0, whole.num_rows, 65_536):
        yield whole.slice(i, 65_536)


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, uid, at), sorted so, of the keys that several texts have, each beside the first text and the one before its own.

    Of a key that goes on in the next batch are held: all rows while they are one text's, else the first, the last text's
    and the one's before it, which are not handed out again.
    """
    names = ["key", "uid", "at", "y", "shift", "prev", "prev_shift"]
    key, uid, at = (np.zeros(0, np.int64) for _ in range(3))
    new = np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, uid, at = (np.concatenate([held, batch.column(i).to_numpy()]) for i, held in enumerate((key, uid, at)))
        new = np.concatenate([new, np.ones(batch.num_rows, bool)])
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        turns = heads | np.concatenate([[True], uid[1:] != uid[:-1]])
        head, turn = np.flatnonzero(heads), np.flatnonzero(turns)
        group, run = np.cumsum(heads) - 1, np.cumsum(turns) - 1
        first = head[group]
        several = uid[np.concatenate([head[1:], [len(key)]]) - 1] != uid[head]
        use = np.flatnonzero(several[group] & new)
        y, before = first[use], turn[np.maximum(run[use] - 1, 0)]
        before = np.where(before < y, y, before)
        yield from _slices(key[use], uid[use], at[use], uid[y], at[use] - at[y], uid[before], at[use] - at[before], names=names)
        if several[-1]:
            kept, old = np.array([head[-1], turn[-2], turn[-1]]), np.zeros(3, bool)
        else:
            kept = np.arange(head[-1], len(key))
            old = new[kept]
        key, uid, at, new = key[kept], uid[kept], at[kept], old


def _tied(found: DataFrame) -> DataFrame:
    """``_ties`` of rows (key, uid, at) in any order: one shuffle, and each task reads its keys as a stream."""
    names = ["key", "uid", "at", "y", "shift"]
    dealt = found.repartition("key").sortWithinPartitions("key", "uid", "at")
    return dealt.mapInArrow(lambda batches: (b.select(names) for b in _ties(batches)), "key long, uid long, at long, y long, shift long")


@dataclass(frozen=True)
class Sorted:
    """A row of hashes, sorted once for all it is compared with: ``codes`` rise with the hash, then with the place."""

    row: np.ndarray
    known: np.ndarray
    codes: np.ndarray
    # The place before with the same hash, or -1; and how many places up to here have one.
    before: np.ndarray
    again: np.ndarray

    @classmethod
    def of(cls, row: np.ndarray) -> "Sorted":
        order = np.argsort(row, kind="stable")
        known, before = row[order], np.full(len(row), -1, np.int64)
        same = known[1:] == known[:-1]
        before[order[1:][same]] = order[:-1][same]
        ranks = np.concatenate([[0], np.cumsum(~same)])[: len(row)]
        return cls(row, known, np.append(ranks * (len(row) + 1) + order, np.iinfo(np.int64).max), before, np.append(0, np.cumsum(before >= 0)))

    def least_distinct(self, start: int, end: int) -> int:
        return int(end - start - self.again[end] + self.again[start])

    def distinct(self, start: int, end: int) -> int:
        return int(np.count_nonzero(self.before[start:end] < start))


class Compared:
    """Two rows of hashes side by side: which places of one occur in the other, and where."""

    def __init__(self, x: Sorted, y: Sorted):
        self.x, self.y, self.size = x, y, len(y.row) + 1
        first = y.known.searchsorted(x.row)
        self.at = np.flatnonzero(y.known[np.minimum(first, len(y.known) - 1)] == x.row) if len(y.row) else np.zeros(0, np.int64)
        self.first = first[self.at]
        self.last = y.known.searchsorted(x.row[self.at], "right")
        self.before = x.before[self.at]
        self.base = y.codes[self.first] // self.size * self.size
        known = np.zeros(len(x.row) + 1, np.int64)
        known[self.at + 1] = 1
        self.hits = np.cumsum(known)

    def matches(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of x that have a match in y within the band of diagonals, and the match nearest to its middle."""
        wanted = self.at - (low + high) // 2
        behind = self.y.codes.searchsorted(self.base + wanted.clip(0, self.size - 1))
        one = self.y.codes[(behind - 1).clip(self.first, self.last - 1)] - self.base
        two = self.y.codes[behind.clip(self.first, self.last - 1)] - self.base
        match = np.where(np.abs(two - wanted) < np.abs(one - wanted), two, one)
        near = (self.at - match >= low) & (self.at - match <= high)
        return self.at[near], match[near]

    def may_reach(self, one: tuple[int, int], two: tuple[int, int], percent: int) -> bool:
        """False only if the similarity of the stretches is below ``percent`` whatever the places of their matches."""
        common = int(self.hits[one[1]] - self.hits[one[0]])
        return 100 * common >= percent * (self.x.least_distinct(*one) + self.y.least_distinct(*two) - common)

    def similarity(self, one: tuple[int, int], two: tuple[int, int]) -> tuple[int, int]:
        """Common hashes and all hashes of two stretches."""
        own = slice(*self.at.searchsorted(one))
        base = self.base[own][self.before[own] < one[0]]
        common = int(np.count_nonzero(self.y.codes[self.y.codes.searchsorted(base + two[0])] < base + two[1]))
        return common, self.x.distinct(*one) + self.y.distinct(*two) - common


def _widened(a: int, b: int, n: int, width: int) -> tuple[int, int] | None:
    """The stretch, drawn out to ``width`` where it is shorter, to the right as far as the row of ``n`` goes."""
    more = max(0, width - (b - a))
    right = min(more, n - b)
    return (a - more + right, b + right) if more - right <= a else None


def passages(x: np.ndarray, y: np.ndarray | Sorted, seeds: list[tuple[int, int]], rule: Passages) -> list[tuple[int, int, int, int, float]]:
    """Verified (start, end, start, end, similarity) in shingles of two rows of hashes, from positions thought to match.

    Along each band of diagonals the matching shingles are runs. Every widest row of runs on which matches outweigh the
    rest as the rule wants it is tested on its sets; one that is shorter than a passage is drawn out to the least width.
    A run at an end that is shorter than the gap behind it is left out if what remains is a passage without it.
    """
    out = []
    both = Compared(Sorted.of(x), y if isinstance(y, Sorted) else Sorted.of(y))
    y = both.y.row
    seeds = sorted(set(seeds), key=lambda s: (s[0] - s[1], s))
    groups: list[list[tuple[int, int]]] = []
    for s in seeds:
        if groups and (s[0] - s[1]) - (groups[-1][-1][0] - groups[-1][-1][1]) <= DRIFT:
            groups[-1].append(s)
        else:
            groups.append([s])
    # Matches without which two stretches of least width are not similar enough.
    least = -(-2 * rule.width * rule.percent // (100 + rule.percent))
    for group in groups:
        low, high = group[0][0] - group[0][1] - DRIFT, group[-1][0] - group[-1][1] + DRIFT
        at, match = both.matches(low, high)
        if len(at) < least:
            continue
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(match) != 1))
        heads, tails = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(at) - 1]])
        x_from, x_to, y_from, y_to = at[heads], at[tails] + 1, match[heads], match[tails] + 1
        sizes = x_to - x_from
        x_gaps = x_from[1:] - x_to[:-1]
        gaps = x_gaps + np.maximum(0, y_from[1:] - y_to[:-1])
        # Matches in all runs before each.
        sums = np.concatenate([[0], np.cumsum(sizes)]).tolist()

        def tested(p: int, q: int) -> tuple[int, int, int, int, float] | None:
            one = _widened(int(x_from[p]), int(x_to[q]), len(x), rule.width)
            bottom, top = (y_from[p], y_to[p]) if p == q else (y_from[p : q + 1].min(), y_to[p : q + 1].max())
            two = _widened(int(bottom), int(top), len(y), rule.width)
            if one is None or two is None or not both.may_reach(one, two, rule.percent):
                return None
            common, union = both.similarity(one, two)
            return (*one, *two, common / union) if 100 * common >= rule.percent * union else None

        open_, seen = [(0, len(sizes))], set()
        while open_:
            lo, hi = open_.pop()
            if (lo, hi) in seen or sums[hi] - sums[lo] < least:
                continue
            seen.add((lo, hi))
            # The balance up to the end of each run, and the last run up to which it has not sunk below that before run p.
            gains = (100 - rule.percent) * sizes[lo:hi]
            ends = np.cumsum(gains) - rule.percent * np.concatenate([[0], np.cumsum(gaps[lo : hi - 1])])
            behind = np.maximum.accumulate(ends[::-1])
            furthest = hi - 1 - np.searchsorted(behind, ends - gains)
            done = -1
            for p, q in zip(range(lo, hi), furthest.tolist()):
                if q <= done:
                    continue
                done, whole = q, (p, q)
                found = tested(p, q)
                while found is None and p < q and sums[q + 1] - sums[p] >= least:
                    p, q = (p + 1, q) if sizes[p] - gaps[p] <= sizes[q] - gaps[q - 1] else (p, q - 1)
                    found = tested(p, q)
                if found is None:
                    continue
                while p < q:
                    less = [(a, b) for a, b, short in ((p + 1, q, sizes[p] < x_gaps[p]), (p, q - 1, sizes[q] < x_gaps[q - 1])) if short]
                    shorter = next(((a, b, t) for a, b in less if x_to[b] - x_from[a] >= rule.width and (t := tested(a, b))), None)
                    if shorter is None:
                        break
                    p, q, found = shorter
                out.append(found)
                if (p, q) != whole:
                    open_ += [(whole[0], p), (q + 1, whole[1] + 1)]
    return sorted(set(out))


def _narrow(df: DataFrame) -> DataFrame:
    """A written frame of numbers, broadcast where it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_NUMBERS else df


def _in_order(df: DataFrame, name: str, id_name: str, text_name: str, column: str = "uid", mark: str = "mark") -> DataFrame:
    """``df`` written once, with mark and size of the text in ``mark``, numbered by rising identifier (null last), then by the mark."""
    text = text_of(text_name)
    keys = [F.col(id_name).cast("long").asc_nulls_last(), F.col(f"{mark}.a").asc(), F.col(f"{mark}.b").asc()]
    rows = df.withColumn(mark, text_mark(text).withField("size", F.octet_length(text))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return numbered(rows, name, column)


def repeats(df: DataFrame, rule: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of a row that another row has too: uid, doc_id, start, end, match_id, match_start, match_end, similarity.

    Passages are at least ``rule.words`` words (what ASCII white space separates, A-Z lower-cased) on both sides, given
    as half-open ranges of words; similarity is that of their shingle sets. Every exact occurrence is tied to the first
    text with a stretch of it, not to all others; near copies are tied where enough of their windows lead to one text.
    Copies of a whole text are tied to the first of them, and repeated rows are such copies. First is the smallest
    identifier, null last, then the mark of the text. Null, empty and short texts have no passage; null identifiers
    come out as null; an empty table has no passages. ``df`` is written once and its rows are numbered as written.
    """
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_of(text_col).alias("text"))
    return _repeats(_in_order(own, "rows", "doc", "text"), rule)


def _repeats(rows: DataFrame, rule: Passages) -> DataFrame:
    """``repeats`` of written rows (uid, doc, text, mark)."""
    # A passage has at least a character and a blank for each word.
    marked = rows.select("uid", "mark").where(F.col("mark.size") >= 2 * rule.words - 1)
    several = marked.groupBy("mark").agg(F.min("uid").alias("first"), F.max("uid").alias("last")).where("first <> last").select("mark", "first")
    copies = written(marked.join(several, "mark").where("uid <> first").select("uid", "first"), "copies")
    texts = rows.select("uid", "text").join(_narrow(copies.select("uid")), "uid", "left_anti")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for uids, held, _ in _together(batches):
            own = shingle_rows(held, rule.shingle, known)
            for keys, at in window_keys(own, rule.width):
                yield from _slices(keys, np.array(uids, np.int64)[own.text[at]], at - own.start[at], names=["key", "uid", "at"])

    kept = written(_tied(texts.mapInArrow(windows, "key long, uid long, at long")), "windows")
    seeds = kept.where("uid <> y").select(F.col("uid").alias("x"), "y", "shift")
    # Verification needs the diagonals of the seeds only; a stretch that is the same counts as enough of them.
    seeds = seeds.groupBy("x", "y", "shift").agg(F.count(F.lit(1)).alias("n"))
    seeds = seeds.unionByName(_exact_seeds(texts, kept, rule).withColumn("n", F.lit(ENOUGH).cast("long")))
    pairs = written(_enough(seeds), "passage-pairs")
    verified = written(_verify(rows.select("uid", "text"), pairs, rule), "passages")
    verified = _rest(rows.select("uid", "text"), kept, pairs, verified, rule)
    names = rows.select("uid", "doc")
    partial = verified.join(names.toDF("x", "doc_id"), "x").join(names.toDF("y", "match_id"), "y")
    partial = partial.select(F.col("x").alias("uid"), "doc_id", "start", "end", "match_id", "match_start", "match_end", "similarity")
    sized = map_rows(rows.join(_narrow(copies), "uid").select("uid", "doc", "first", "text"), _counted, "uid long, doc long, first long, n long").where(F.col("n") >= rule.words)
    whole = sized.join(names.toDF("first", "match_id"), "first").select(
        "uid", F.col("doc").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), "match_id",
        F.lit(0).cast("long").alias("match_start"), F.col("n").alias("match_end"), F.lit(1.0).alias("similarity"),
    )
    return partial.unionByName(whole)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows with the words of the text in the last column instead of the text."""
    for batch in batches:
        for *row, text in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns - 1)], octets(batch.column(batch.num_columns - 1))):
            yield *row, len(text.split())


def _enough(seeds: DataFrame) -> DataFrame:
    """(x, y, shifts) of the pairs with enough windows on one alignment or another."""
    pairs = seeds.groupBy("x", "y").agg(F.collect_set("shift").alias("shifts"), F.sum("n").alias("n"))
    return pairs.where(F.col("n") >= ENOUGH).drop("n")


def _rest(rows: DataFrame, kept: DataFrame, pairs: DataFrame, verified: DataFrame, rule: Passages) -> DataFrame:
    """``verified`` with what the windows add that no verified passage covers: each is laid beside the texts before its own under the key.

    The nearest texts come first, then ``REACH`` times as many in each round, until every window is covered or has met all
    texts before its own; from the second round on, passages are kept that add to those known. Windows are gathered over all rounds: a pair may agree near by under one key and far off under another.
    """
    open_ = written(_open(kept.where("uid <> y").select("key", "uid", "at"), verified, rule), "open-windows")
    members = kept.join(_narrow(written(open_.select("key").distinct(), "open-keys")), "key", "left_semi")
    members = members.groupBy("key", F.col("uid").alias("y")).agg(F.min("at").alias("y_at"))
    members = written(members.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("y"))), "open-members")
    open_ = open_.join(members.select("key", F.col("y").alias("uid"), "place"), ["key", "uid"])
    near = written(_surroundings(rows, open_.select("uid", "at").unionByName(members.select(F.col("y").alias("uid"), F.col("y_at").alias("at"))), rule), "surroundings")
    open_ = open_.join(near, ["uid", "at"])
    members = members.join(near.toDF("y", "y_at", "y_near"), ["y", "y_at"])
    tried = pairs
    seeds, low = None, 1
    while True:
        members = members.join(_narrow(written(open_.select("key").distinct(), "open-keys")), "key", "left_semi")
        found = written(_open_seeds(open_, members, low, low * REACH, rule), "open-seeds")
        seeds = found if seeds is None else seeds.unionByName(found)
        others = written(_untried(_enough(seeds), tried), "other-pairs")
        more = written(_verify(rows, others, rule), "other-passages")
        more = more if seeds is found else written(_outside(more, verified), "new-passages")
        verified, low = verified.unionByName(more), low * REACH
        tried = tried.unionByName(others)
        open_ = _open(open_, more, rule).where(F.col("place") > low)
        if open_.isEmpty():
            return verified
        open_ = written(open_, "open-windows")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """``pairs`` (x, y, shifts) with the alignments that ``tried`` has in none of its rows for the pair, where there are any."""
    known = tried.join(pairs.select("x", "y"), ["x", "y"], "left_semi").groupBy("x", "y").agg(F.flatten(F.collect_list("shifts")).alias("known"))
    left = F.array_except("shifts", F.coalesce("known", F.array().cast("array<bigint>")))
    return pairs.join(known, ["x", "y"], "left").select("x", "y", left.alias("shifts")).where(F.size("shifts") > 0)


def _outside(found: DataFrame, verified: DataFrame) -> DataFrame:
    """``found`` but for passages that lie in a verified one of their text or in a longer one found with them; of equal ones that of the first text stays."""
    both = verified.join(_narrow(found.select("x").distinct()), "x", "left_semi").withColumn("known", F.lit(0)).unionByName(found.withColumn("known", F.lit(1)))
    before = W.partitionBy("x").orderBy("start", F.desc("end"), "known", "y", "match_start", "match_end").rowsBetween(W.unboundedPreceding, -1)
    reached = both.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    return reached.where("known = 1 and reached < end").drop("known", "reached")


def _open(windows: DataFrame, verified: DataFrame, rule: Passages) -> DataFrame:
    """The windows (uid, at, ...) in no verified passage of their text."""
    spans = verified.groupBy(F.col("x").alias("uid")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = F.broadcast(spans) if verified.count() <= BROADCAST_NUMBERS else spans
    left = windows.join(spans, "uid", "left")
    covered = F.exists("spans", lambda s: (s["start"] <= F.col("at")) & (F.col("at") + rule.shingle <= s["end"]))
    return left.where(~F.coalesce(covered, F.lit(False))).drop("spans")


def _surroundings(rows: DataFrame, places: DataFrame, rule: Passages) -> DataFrame:
    """(uid, at, near): the lowest 16 bits of the shingles up to a passage before and behind each place, and their drift; missing ones at the edges are counted first."""
    wanted = places.groupBy("uid").agg(F.collect_set("at").alias("places"))
    reach = rule.width - 1 + DRIFT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = _Hashes()
        for batch in batches:
            texts = _row_of_each(octets(batch.column(1)), rule.shingle, known)
            for uid, row, places in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                own = row.astype("<u2")
                for at in places:
                    yield uid, at, bytes([max(0, reach - at)]) + own[max(0, at - reach) : at + reach + 1].tobytes()

    return map_rows(rows.join(wanted, "uid").select("uid", "text", "places"), run, "uid long, at long, near binary")


def near_rows(near: list[bytes], rule: Passages) -> tuple[np.ndarray, np.ndarray]:
    """What ``_surroundings`` gives as a row each, the place itself in the middle, and which numbers there are."""
    width = 2 * (rule.width - 1 + DRIFT) + 1
    size = np.fromiter(map(len, near), np.int64, len(near))[:, None] // 2
    whole = np.frombuffer(b"".join([b.ljust(2 * width + 1, b"\0") for b in near]), np.uint8).reshape(len(near), 2 * width + 1)
    at = np.arange(width) - whole[:, :1].astype(np.int64)
    there = (at >= 0) & (at < size)
    values = np.take_along_axis(whole[:, 1:].copy().view("<u2"), np.clip(at, 0, width - 1), axis=1)
    return np.where(there, values, 0).astype(np.int64), there


def may_hold(near: list[bytes], others: list[bytes], rule: Passages) -> np.ndarray:
    """Whether some stretch of least width around each first place has as many shingles near the second place as a passage needs."""
    return _holds(*near_rows(near, rule), *near_rows(others, rule), rule)


def _least(rule: Passages) -> int:
    """Shingles that two stretches of least width have in common at least."""
    return -(-2 * rule.width * rule.percent // (100 + rule.percent))


def _reached(hit: np.ndarray, rule: Passages) -> np.ndarray:
    """Whether a stretch of least width has enough hits, by row."""
    sums = np.zeros((len(hit), hit.shape[1] + 1), np.int32)
    np.cumsum(hit, axis=1, out=sums[:, 1:])
    return (sums[:, rule.width :] - sums[:, : -rule.width]).max(axis=1) >= _least(rule)


def _holds(x: np.ndarray, x_there: np.ndarray, y: np.ndarray, y_there: np.ndarray, rule: Passages) -> np.ndarray:
    row = np.arange(len(x))[:, None] << 17
    known = np.sort((row + y + np.where(y_there, 0, 1 << 16)).ravel())
    wanted = (row + x)[:, DRIFT:-DRIFT]
    return _reached((known[np.minimum(np.searchsorted(known, wanted.ravel()), len(known) - 1)].reshape(wanted.shape) == wanted) & x_there[:, DRIFT:-DRIFT], rule)


class Places:
    """Surroundings of many places, to lay some beside others.

    Numbers with the same rest are first taken for the same, which leaves out no pair that holds; the pairs left are compared by ``_holds``.
    """

    def __init__(self, near: list[bytes], rule: Passages) -> None:
        self.rule = rule
        self.values, self.there = near_rows(near, rule)
        self.slots = np.where(self.there, self.values % SLOTS, SLOTS)
        # A missing number of the first side is never found.
        self.wanted = np.where(self.there, self.slots, SLOTS + 1)[:, DRIFT:-DRIFT]
        # Which slots the second side of each pair has; all False between calls.
        self.known = np.zeros(0, bool)

    def may_hold(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``may_hold`` of the places of two rows of positions."""
        row = (np.arange(len(first)) * (SLOTS + 2))[:, None]
        if len(self.known) < len(first) * (SLOTS + 2):
            self.known = np.zeros(len(first) * (SLOTS + 2), bool)
        held = row + self.slots[second]
        self.known[held] = True
        out = _reached(self.known[row + self.wanted[first]], self.rule)
        self.known[held] = False
        left = np.flatnonzero(out)
        if len(left):
            i, j = first[left], second[left]
            out[left] = _holds(self.values[i], self.there[i], self.values[j], self.there[j], self.rule)
        return out


def _beside(batches: Iterator[pa.RecordBatch], low: int, high: int, rule: Passages) -> Iterator[pa.RecordBatch]:
    """(x, y, shift, n) of rows (key, block, asks, place, uid, at, near), sorted so: in each block the texts of a key, then the windows laid beside them.

    Of a block that goes on in the next batch the texts are held.
    """
    numbers, near = np.zeros((6, 0), np.int64), []
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = np.concatenate([numbers, np.stack([batch.column(i).to_numpy() for i in range(6)])], axis=1)
        near += batch.column(6).to_pylist()
        key, block, asks, place, uid, at = numbers
        group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])) - 1
        texts, asked = np.flatnonzero(asks == 0), np.flatnonzero(asks)
        # Places are below 2^42; the last group of each batch is the first of the next.
        codes, wanted = (group[texts] << 42) + place[texts], (group[asked] << 42) + np.maximum(place[asked] - np.array([[high - 1], [low]]), 0)
        start, end = np.searchsorted(codes, wanted[0], "left"), np.searchsorted(codes, wanted[1], "right")
        ends = np.cumsum(end - start)
        places = Places(near, rule)
        for i in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            pair = np.arange(i, min(i + PAIRS, int(ends[-1])))
            of = np.searchsorted(ends, pair, "right")
            one, two = asked[of], texts[pair - ends[of] + end[of]]
            before = (place[one] - place[two] == 1) & (place[two] > 1)
            n = np.where(places.may_hold(one, two), ENOUGH, before.astype(np.int64))
            use = np.flatnonzero(n)
            if len(use):
                one, two = one[use], two[use]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (uid[one], uid[two], at[one] - at[two], n[use])], names=["x", "y", "shift", "n"])
        kept = texts[group[texts] == group[-1]]
        numbers, near = numbers[:, kept], [near[k] for k in kept.tolist()]


def _open_seeds(open_: DataFrame, members: DataFrame, low: int, high: int, rule: Passages) -> DataFrame:
    """(x, y, shift, n): open windows beside each text that comes ``low`` to ``high`` - 1 texts before theirs under the key.

    One with a stretch that a passage may be is enough; without one, only the text just before counts, as a window like others.
    The texts of a key are dealt in blocks, so that a hot key is many small ones; a block's surroundings travel once, not with each pair.
    """
    width = min(high - low, BLOCK)
    nearest, furthest = F.col("place") - low, F.greatest(F.col("place") - (high - 1), F.lit(1))
    blocks = F.sequence(F.floor(furthest / width), F.floor(nearest / width))
    asked = open_.where(nearest >= 1).select("key", F.explode(blocks).alias("block"), F.lit(1).cast("long").alias("asks"), "place", "uid", "at", "near")
    before = members.select("key", F.floor(F.col("place") / width).alias("block"), F.lit(0).cast("long").alias("asks"), F.col("place"), F.col("y").alias("uid"), F.col("y_at").alias("at"), F.col("y_near").alias("near"))
    both = before.unionByName(asked).withColumn("place", F.col("place").cast("long")).repartition("key", "block")
    both = both.sortWithinPartitions("key", "block", "asks", "place")
    likely = both.mapInArrow(lambda batches: _beside(batches, low, high, rule), "x long, y long, shift long, n long")
    return likely.groupBy("x", "y", "shift").agg(F.sum("n").alias("n"))


def _exact_seeds(texts: DataFrame, kept: DataFrame, rule: Passages) -> DataFrame:
    """(x, y, shift): each text beside the first text that has one of its stretches exactly, and the diagonals of these.

    Equal stretches have their minimum at the same place and agree in a half passage beside it, so both have a window
    under one key there, whichever text that key is tied to.
    """
    places = kept.where(F.col("key").bitwiseAND(F.lit(3)) == 0).select("uid", "at")
    around = places.groupBy("uid").agg(F.collect_set("at").alias("around"))
    wanted = texts.join(around, "uid").select("uid", "text", "around")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for uids, held, own_places in _together(batches):
            own = shingle_rows(held, rule.shingle, known)
            starts = np.searchsorted(own.text, np.arange(len(held)))
            marks, at = stretches(own, rule.width, np.concatenate([np.array(p, np.int64) + s for p, s in zip(own_places, starts)]))
            yield from _slices(marks, np.array(uids, np.int64)[own.text[at]], at - own.start[at], names=["key", "uid", "at"])

    found = _tied(wanted.mapInArrow(run, "key long, uid long, at long"))
    return found.where("uid <> y").select(F.col("uid").alias("x"), "y", "shift").distinct()


def _verify(rows: DataFrame, pairs: DataFrame, rule: Passages) -> DataFrame:
    """Passages of the pairs (x, y), in words. The members of a text y are dealt out in slices, each beside a copy of y."""
    wanted = written(pairs.select(F.explode(F.array("x", "y")).alias("uid")).distinct(), "wanted")
    texts = rows.join(_narrow(wanted), "uid")
    slices = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / SLICE_MEMBERS).alias("slices"))
    dealt = pairs.join(slices, "y").select("x", "y", "shifts", F.pmod(F.xxhash64("x"), "slices").alias("slice"))
    need = dealt.select(F.col("x").alias("uid"), "y", "slice", F.lit(1).alias("member"), "shifts")
    anchors = dealt.select(F.col("y").alias("uid"), "y", "slice").distinct().withColumn("member", F.lit(0)).withColumn("shifts", F.lit(None).cast(need.schema["shifts"].dataType))
    streams = need.unionByName(anchors).join(texts, "uid").repartition("y", "slice").sortWithinPartitions("y", "slice", "member")
    streams = streams.select("y", "member", "uid", "shifts", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known, anchor = _Hashes(), None
        for batch in batches:
            y, member, uid, shifts = (batch.column(i).to_pylist() for i in range(4))
            for i, own in enumerate(_row_of_each(octets(batch.column(4)), rule.shingle, known)):
                if not member[i]:
                    anchor = Sorted.of(own)
                    continue
                for a, b, c, d, similarity in passages(own, anchor, [(shift, 0) for shift in shifts[i]], rule):
                    more = rule.shingle - 1
                    yield uid[i], y[i], a, b + more, c, d + more, similarity

    return map_rows(streams, compare, "x long, y long, start long, end long, match_start long, match_end long, similarity double")


def cut_repeats(df: DataFrame, rule: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every repeated passage cut out but its first occurrence, as ``repeats`` orders them; other rows, columns and nulls stay.

    A copy of a whole text, a repeated row too, loses all its words but stays as a row; an empty table stays empty.
    """
    import re

    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = _in_order(df.toDF(*inner.values()), "rows", inner[id_col], inner[text_col], "_uid", "_mark")
    own = rows.select(F.col("_uid").alias("uid"), F.col(inner[id_col]).cast("long").alias("doc"), text_of(inner[text_col]).alias("text"), F.col("_mark").alias("mark"))
    spans = _repeats(own, rule).groupBy(F.col("uid").alias("_uid")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    rows = rows.join(spans, "_uid", "left").drop("_uid", "_mark")
    at, width, word = list(inner.values()).index(inner[text_col]), len(inner), re.compile(rb"[^\x09-\x0d\x20]+")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(width + 1)]):
                row, cuts = list(row[:-1]), row[-1]
                if cuts:
                    text = row[at].encode()
                    places = [m.span() for m in word.finditer(text)]
                    out, end = [], 0
                    for a, b in sorted((s["start"], s["end"]) for s in cuts):
                        start = max(end, places[a][0])
                        out.append(text[end:start])
                        end = max(end, places[b - 1][1])
                    row[at] = (b"".join(out) + text[end:]).decode()
                yield tuple(row)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:width])
    return map_rows(rows, cut, kinds).select(*[F.col(i).alias(c) for c, i in inner.items()])
