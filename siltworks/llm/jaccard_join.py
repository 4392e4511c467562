"""Exact Jaccard self-join of word shingle sets by prefix tokens, opened group by group.

Documents with the same set are one class. Similar classes are first put into groups: classes that share a minimum hash
are compared with one leader, the class whose tokens are the commonest on average, as the middle of a group of copies
has fewest words of its own; verified links make the groups. Then classes of different groups are joined on the tokens
of their prefixes: two sets at the threshold share one, and an entry counts only where sizes and positions leave room
for enough overlap. This is a join of classes, not of groups: there is no union of a group and no bound for a pair of
groups, and all classes of different groups under a token are looked at. Pairs of groups are opened by their best pair
of classes first and in full only if that does not link them.

Prefixes follow one order of tokens for all sets: tokens seen often come last, so that common passages make no
candidates. Any order gives the same links; which tokens are frequent only decides how many candidates are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.llm.components import components
from siltworks.llm.frames import BATCH_ROWS, map_rows, numbered, octets, text_of, written
from siltworks.session import pin_small

REMEMBERED = 400_000
MIN_HASHES = 4
# Tokens counted together in a task; those seen twice there go to the end of the order, the commonest last.
COUNT_TOKENS = 2_000_000
# As many frequent tokens as are broadcast, 9 bytes each; the others keep their place in the order.
FREQUENT = 1 << 18
# Stretches of equally many possible tokens, two to the power of this.
STRETCH_BITS = 12
SLICE_MEMBERS = 256
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Rule:
    """Shingle length in words, and the threshold as ``percent`` / 100."""

    shingle: int = 5
    percent: int = 80

    def links(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def prefix(self, n: int) -> int:
        """Tokens of which any set that links shares at least one: n - ceil(t n) + 1."""
        return n - -(-self.percent * n // 100) + 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _B
    return z ^ (z >> np.uint64(31))


def shingle_set(text: bytes, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``size`` are one shingle, none are none."""
    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = min(size, len(h))
    if not n:
        return h
    count = len(h) - n + 1
    z = _mix(h[:count] + np.uint64(n))
    for i in range(1, n):
        z = _mix(z * _A + h[i : count + i])
    return np.unique(z)


def sketch(s: np.ndarray) -> bytes:
    """One bit per token hash, in a power of two of bits that is at least four times the tokens (and at least 64)."""
    width = max(64, 1 << (4 * len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(s >> np.uint64(20)).astype(np.int64) & (width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """A lower bound of the tokens that only one of two sets has: bits that only one of their sketches has."""
    if len(a) < len(b):
        a, b = b, a
    one, two = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(one) > len(two):
        half = len(one) // 2
        one = one[:half] | one[half:]
    return int(np.bitwise_count(one ^ two).sum())


def _sets(rows: DataFrame, rule: Rule, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """uid, doc, n, class (128 bits of the set), sketch, mean level and prefix of its tokens, and minimum hashes of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known, (last, levels) = _Hashes(), shared.value
        for batch in batches:
            uids, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for uid, doc, text in zip(uids, ids, octets(batch.column(2))):
                s = shingle_set(text, rule.shingle, known)
                if not len(s):
                    yield uid, doc, 0, b"", b"", 0.0, [], *[None] * MIN_HASHES
                    continue
                level = np.zeros(len(s), np.int8)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    level = np.where(last[at] == s, levels[at], 0)
                prefix = s[np.argsort(level, kind="stable")][: rule.prefix(len(s))]
                mins = [int(_mix(s * seed).min().view(np.int64)) for seed in _SEEDS]
                yield uid, doc, len(s), xxhash.xxh128_digest(s.tobytes()), sketch(s), float(level.mean()), prefix.view(np.int64), *mins

    kind = "uid long, doc long, n long, class binary, sketch binary, common double, prefix array<long>, "
    return map_rows(rows.select("uid", "doc", "text"), run, kind + ", ".join(f"m{i} long" for i in range(MIN_HASHES)))


def _seen_twice(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(token, n) of the tokens that are held more than once; what is held is let go. Only these few take memory beside one sorted array."""
    if not held:
        return
    tokens = np.concatenate(held)
    held.clear()
    tokens.sort()
    same = np.zeros(len(tokens) + 1, bool)
    np.equal(tokens[1:], tokens[:-1], out=same[1:-1])
    starts, ends = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
    found = tokens[starts].view(np.int64)
    del tokens, same
    for i in range(0, len(found), BATCH_ROWS):
        part = slice(i, i + BATCH_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(found[part]), pa.array(ends[part] - starts[part] + 1)], names=["token", "n"])


def _frequent(rows: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Tokens to put last, sorted, and the power of two of their counts: counted over all texts, those seen twice in a stretch of ``COUNT_TOKENS`` being summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _Hashes(), [], 0
        for batch in batches:
            for text in octets(batch.column(0)):
                held.append(shingle_set(text, rule.shingle, known))
                size += len(held[-1])
                if size >= COUNT_TOKENS:
                    yield from _seen_twice(held)
                    size = 0
        yield from _seen_twice(held)

    counts = rows.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return _commonest(written(counts, "token-counts"), FREQUENT)


def _commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, sorted, and levels of at most ``most`` rows (token, n), the commonest first; of equally common ones those of the lowest stretches of tokens that fit.

    The driver gets counts of counts and of stretches, and one row of bytes from each task: no row for a token.
    """
    room, cut, stretch = most, 0, None
    for n, rows in sorted(map(tuple, counts.groupBy("n").agg(F.count(F.lit(1))).collect()), reverse=True):
        if rows > room:
            cut = n
            break
        room -= rows
    if cut:
        part = F.shiftright("token", 64 - STRETCH_BITS)
        for number, rows in sorted(map(tuple, counts.where(F.col("n") == cut).groupBy(part).agg(F.count(F.lit(1))).collect())):
            if rows > room:
                break
            room, stretch = room - rows, number
        tied = F.lit(False) if stretch is None else (F.col("n") == cut) & (part <= stretch)
        counts = counts.where((F.col("n") > cut) | tied)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = [(b.column(0).to_numpy().tobytes(), b.column(1).to_numpy().tobytes()) for b in batches if b.num_rows]
        if held:
            yield b"".join(t for t, _ in held), b"".join(v for _, v in held)

    found = map_rows(counts.select("token", F.floor(F.log2("n")).cast("byte").alias("level")), packed, "tokens binary, levels binary").collect()
    tokens = np.frombuffer(b"".join(r["tokens"] for r in found), np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.frombuffer(b"".join(r["levels"] for r in found), np.int8)[order]


def _verify(rows: DataFrame, classes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (x, y) of class numbers whose whole sets link.

    Pairs whose sketches differ in more places than linked sets can are left out first. The sets are made anew, where
    they are compared, from the text of the leading row of each class.

    The members compared with an anchor y are dealt out in slices, each beside a copy of the anchor's text; a task reads
    its slices as a sorted stream and holds one anchor at a time.
    """
    pairs = written(_possible(classes, pairs.select("x", "y").distinct(), rule), "pairs")
    slices = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / SLICE_MEMBERS).alias("slices"))
    dealt = pairs.join(slices, "y").select("x", "y", F.pmod(F.xxhash64("x"), "slices").alias("slice"))
    need = dealt.select(F.col("x").alias("cid"), "y", "slice", F.lit(1).alias("member"))
    need = need.unionByName(dealt.select(F.col("y").alias("cid"), "y", "slice", F.lit(0).alias("member")).distinct())
    need = written(need.join(classes.select("cid", F.col("lead.uid").alias("uid")), "cid"), "wanted")
    texts = rows.select("uid", "text").join(pin_small(need), "uid").select("y", "slice", "member", "cid", "text")
    streams = texts.repartition("y", "slice").sortWithinPartitions("y", "slice", "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known, anchor = _Hashes(), np.zeros(0, np.uint64)
        for batch in batches:
            ys, members, cids = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for y, member, cid, text in zip(ys, members, cids, octets(batch.column(4))):
                own = shingle_set(text, rule.shingle, known)
                if not member:
                    anchor = own
                elif len(anchor) and len(own):
                    at = np.minimum(np.searchsorted(anchor, own), len(anchor) - 1)
                    if rule.links(int((anchor[at] == own).sum()), len(anchor), len(own)):
                        yield cid, y

    return written(map_rows(streams, compare, "x long, y long"), "verified")


def _possible(classes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sketches leave a link possible: linked sets differ in at most (1 - t) / (1 + t) of their tokens."""
    own = classes.select("cid", "n", "sketch")
    both = pairs.join(own.toDF("x", "n_x", "s_x"), "x").join(own.toDF("y", "n_y", "s_y"), "y").select("x", "y", "n_x", "n_y", "s_x", "s_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for x, y, n, m, a, b in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if (100 + rule.percent) * differ(a, b) <= (100 - rule.percent) * (n + m):
                    yield x, y

    return map_rows(both, run, "x long, y long")


def _star_pairs(classes: DataFrame, rule: Rule) -> DataFrame:
    """Each class beside the commonest class with the same minimum hash, where sizes allow a link."""
    mins = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"m{i}").alias("m")) for i in range(MIN_HASHES)])).alias("k")
    dealt = classes.select("cid", "n", "common", mins).select("k.i", "k.m", "cid", "n", "common")
    leaders = dealt.groupBy("i", "m").agg(F.max(F.struct("common", "cid", "n")).alias("l"), F.count(F.lit(1)).alias("members")).where("members > 1")
    found = dealt.select("i", "m", "cid", "n").join(leaders, ["i", "m"]).where("cid <> l.cid")
    found = found.where(100 * F.least("n", "l.n") >= rule.percent * F.greatest("n", "l.n"))
    return found.select(F.col("cid").alias("x"), F.col("l.cid").alias("y"))


def _labelled(classes: DataFrame, roots: DataFrame) -> DataFrame:
    joined = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    return joined.withColumn("grp", F.coalesce("root", "cid")).drop("root")


def _matrix(labelled: DataFrame) -> DataFrame:
    """Prefix entries, one per class and token, of tokens that stand in more than one group."""
    entries = labelled.select("cid", "n", "grp", F.posexplode("prefix").alias("pos", "token"))
    over = W.partitionBy("token")
    entries = entries.withColumn("lo", F.min("grp").over(over)).withColumn("hi", F.max("grp").over(over))
    return written(entries.where("lo <> hi").select("token", "grp", "cid", "n", "pos"), "matrix")


def _qualifying(matrix: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of classes of different groups that a shared token leaves room for, with the tokens they share.

    The smaller set of a pair needs its shared token among the first n - ceil(2t / (1 + t) n) + 1 of its order, and what
    follows the two positions must be able to hold the overlap that a link needs.
    """
    t = rule.percent
    short = F.col("n") - F.ceil(2 * t * F.col("n") / F.lit(100 + t) - 1e-9) + 1
    a = matrix.where(F.col("pos") < short).select("token", *[F.col(c).alias(f"{c}_a") for c in ("grp", "cid", "n", "pos")])
    b = matrix.select("token", *[F.col(c).alias(f"{c}_b") for c in ("grp", "cid", "n", "pos")])
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) * (100 + t) >= t * (F.col("n_a") + F.col("n_b"))
    fits = (F.col("n_b") >= F.col("n_a")) & (100 * F.col("n_a") >= t * F.col("n_b")) & (F.col("grp_a") != F.col("grp_b"))
    found = a.join(b, (a["token"] == b["token"]) & fits & room)
    return found.groupBy(F.greatest("cid_a", "cid_b").alias("x"), F.least("cid_a", "cid_b").alias("y")).agg(F.count(F.lit(1)).alias("shared"))


def similar_groups(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: uid, doc_id, n_shingles, component_id, first.

    Words are what ASCII white space separates, A-Z lower-cased. Two rows link when the Jaccard similarity of their sets
    of word shingles is at least the threshold, decided on whole sets; component_id is the smallest identifier that links
    lead to. Null and empty texts have no shingles, link with nothing and are their own component. Null identifiers are
    the smallest of nothing; ``first`` marks one row of each component, the one with the smallest identifier, nulls last.
    ``df`` is read once and its rows are numbered as written. Other columns are not read; an empty table gives no rows.
    """
    return _groups(numbered(df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_of(text_col).alias("text")), "rows"), rule)


def _groups(rows: DataFrame, rule: Rule) -> DataFrame:
    """``similar_groups`` of written rows (uid, doc, text)."""
    sets = written(_sets(rows, rule, _frequent(rows, rule)), "sets")
    mins = [f"m{i}" for i in range(MIN_HASHES)]
    lead = F.struct(F.col("doc").isNull().alias("none"), "doc", "uid")
    # What follows from the set is the same in all rows of a class.
    same = [F.first(c).alias(c) for c in ("sketch", "common", "prefix", *mins)]
    whole = sets.where("n > 0").groupBy("class", "n").agg(F.min(lead).alias("lead"), *same)
    whole = written(whole.withColumn("cid", F.monotonically_increasing_id()), "classes")
    classes = whole.drop("prefix")
    links = _verify(rows, classes, _star_pairs(classes, rule), rule)
    roots = components(links)
    grouped = written(_labelled(classes.drop("sketch"), roots), "groups")
    candidates = written(_qualifying(_matrix(_labelled(whole, roots)), rule), "candidates")
    of = grouped.select("cid", "grp")
    named = candidates.join(of.toDF("x", "gx"), "x").join(of.toDF("y", "gy"), "y")
    best = named.groupBy(F.least("gx", "gy").alias("g"), F.greatest("gx", "gy").alias("h")).agg(F.max(F.struct("shared", "x", "y")).alias("p"))
    links = links.unionByName(_verify(rows, classes, best.select("p.x", "p.y"), rule))
    of = written(_labelled(classes.select("cid"), components(links)), "groups")
    rest = candidates.join(of.toDF("x", "gx"), "x").join(of.toDF("y", "gy"), "y").where("gx <> gy").join(best.select("p.x", "p.y"), ["x", "y"], "left_anti")
    links = links.unionByName(_verify(rows, classes, rest, rule))
    final = _labelled(classes.select("cid", "class", "lead"), components(links))
    roots = final.groupBy("grp").agg(F.min("lead").alias("best"))
    named = final.join(roots, "grp").select("class", "best")
    joined = sets.select("uid", "doc", "n", "class").join(named, "class", "left")
    return joined.select(
        "uid", F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("best.doc")).otherwise(F.col("doc")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("best.uid") == F.col("uid")).otherwise(F.lit(True)).alias("first"),
    )


def drop_similar(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component, the first; columns and row order within tasks stay as they are."""
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = numbered(df.toDF(*inner.values()), "rows", "_uid")
    own = rows.select(F.col("_uid").alias("uid"), F.col(inner[id_col]).cast("long").alias("doc"), text_of(inner[text_col]).alias("text"))
    gone = _groups(own, rule).where(~F.col("first")).select(F.col("uid").alias("_uid"))
    return rows.join(pin_small(written(gone, "gone")), "_uid", "left_anti").select(*[F.col(i).alias(c) for c, i in inner.items()])
