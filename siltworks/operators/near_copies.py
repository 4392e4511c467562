"""Near copies of texts, verified: candidates share a bucket of a min-hash sketch, links are measured on the texts' own shingles.

In every bucket the smallest key leads. Whoever is similar enough joins the leader's cluster, the rest stay in the bucket
and get the next leader, cluster by cluster, until no bucket has two members left. Equal sets are one member, beside their
smallest key. After the first leader a bucket finds its leaders in blocks that grow from round to round; members meet a
block through the rarest of their shingles, so a bucket of unlike texts is settled without comparing all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.strings import normalised_text
from siltworks.operators.inference import quoted
from siltworks.operators.violations import SHINGLE_WORDS, near_duplicate_bands
from siltworks.session import cut_lineage, pin_small

SIMILARITY = 0.8
# A product that is whole but for its rounding is not missed.
EDGE = 1e-9
# How much more leaders a bucket may find in a round than in the round before.
GROWTH = 16


def shingle_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, shingles)``: the different word triples of a text as sorted 64-bit numbers; texts below three words have none.

    Built by array functions inside the row, so no triple is a row of its own.
    """
    words = F.split(normalised_text(quoted(text)), " ")
    starts = F.sequence(F.lit(1), F.size("w") - (SHINGLE_WORDS - 1))
    triples = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, SHINGLE_WORDS), " ")))
    shaped = df.select(quoted(key).alias(key), words.alias("w")).where(F.size("w") >= SHINGLE_WORDS)
    return shaped.select(key, F.array_sort(F.array_distinct(triples)).alias("shingles"))


def _measured(pairs: DataFrame, sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """``pairs`` (key, anchor) with their shared and united shingles, those at or above the threshold.

    Sizes rule out most unlike pairs before the sets travel. A leader of very many members is a skewed key of the second
    join, which the adaptive join splits: nothing above it needs the members of a leader together.
    """
    sized = sets.select(key, "size").distinct()
    anchors = sets.select(F.col(key).alias("anchor"), F.col("size").alias("anchor_size"), F.col("shingles").alias("anchor_shingles"))
    bounded = (
        pairs.join(sized, key)
        .join(sized.select(F.col(key).alias("anchor"), F.col("size").alias("anchor_size")), "anchor")
        .where(F.least("size", "anchor_size") >= F.greatest("size", "anchor_size") * threshold - EDGE)
    )
    both = bounded.join(sets.select(key, "size", "shingles"), [key, "size"]).join(anchors, ["anchor", "anchor_size"])
    shared = F.size(F.array_intersect("shingles", "anchor_shingles"))
    measured = both.select(key, "anchor", shared.alias("shared"), (F.col("size") + F.col("anchor_size") - shared).alias("united"))
    return measured.where(F.col("shared") + EDGE >= F.col("united") * threshold)


def _crowded(slots: DataFrame) -> DataFrame:
    """The rows of slots with two members or more."""
    return slots.join(slots.groupBy("slot").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("slot"), "slot", "left_semi")


def _first_copies(sets: DataFrame, key: str) -> DataFrame:
    """``(key, first, size)``: each key beside the smallest key with the same set of shingles, and the size of that set.

    Equal sets share all slots and are similar to the same leaders, so one of them stands for all. A key that has several
    texts with different sets stands for itself.
    """
    marked = sets.select(key, F.struct("size", "mark", "mark2").alias("set"))
    single = marked.groupBy(key).agg(F.min("set").alias("set"), F.max("set").alias("last")).withColumn("alone", F.col("set") == F.col("last"))
    single = cut_lineage(single.select(key, "set.*", "alone"))
    firsts = single.where("alone").groupBy("size", "mark", "mark2").agg(F.min(key).alias("first")).withColumn("alone", F.lit(True))
    found = single.join(firsts, ["size", "mark", "mark2", "alone"], "left")
    return found.select(key, F.coalesce("first", key).alias("first"), "size")


def _prefixes(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """``(key, size, unique, tokens)``: the rarest shingles of each set, as many as two similar sets cannot both do without.

    A set has to share all but a part of its shingles with a similar one; of any larger part, in one order of all shingles,
    the two have one in common. ``unique`` shingles that no other set has come first and are left out, and with them the
    sets in which they fill the part: nothing is similar to these.
    """
    tokens = sets.select("row", key, "size", F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rarest = F.array_sort(F.collect_list(F.struct("n", "token")))
    ordered = tokens.join(common, "token").groupBy("row", key, "size").agg(rarest.alias("t"))
    part = F.col("size") - F.ceil(F.col("size") * threshold - EDGE).cast("int") + 1
    placed = ordered.withColumn("unique", F.col("size") - F.size("t")).withColumn("part", part - F.col("unique")).where("part > 0")
    return placed.select(key, "size", "unique", F.slice("t.token", F.lit(1), F.col("part")).alias("tokens"))


def _meeting(open_slots: DataFrame, block: DataFrame, prefixes: DataFrame, key: str, threshold: float) -> DataFrame:
    """``(key, anchor)``: members and earlier members of their slot's block that may be similar.

    The first shingle two sets have in common leaves each with what comes behind it: too little of that is ruled out.
    """
    placed = prefixes.select(key, "size", "unique", F.posexplode("tokens").alias("p", "token"))
    placed = placed.select(key, "token", "size", (F.col("size") - F.col("unique") - F.col("p")).alias("rest"))
    names = {key: "anchor", "size": "anchor_size", "rest": "anchor_rest"}
    both = open_slots.join(placed, key).join(block.join(placed.withColumnsRenamed(names), "anchor"), ["slot", "token"])
    enough = F.least("rest", "anchor_rest") * (1 + threshold) + EDGE >= (F.col("size") + F.col("anchor_size")) * threshold - EDGE
    return both.where((F.col("anchor") < F.col(key)) & enough).select(key, "anchor").distinct()


def _followers(edges: DataFrame, key: str) -> DataFrame:
    """``(slot, key)`` of the members of a block that are similar to an earlier leader of it.

    ``edges`` (slot, key, anchor) are all similar pairs inside the blocks. They pass through sorted, slot by slot; only the
    followers of one slot are held.
    """
    ordered = edges.select("slot", key, "anchor").repartition("slot").sortWithinPartitions("slot", key)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, following = None, set()
        for batch in batches:
            rows = []
            for s, k, anchor in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != slot:
                    slot, following = s, set()
                if anchor not in following and k not in following:
                    following.add(k)
                    rows.append((s, k))
            columns = [pa.array([r[i] for r in rows], batch.schema.field(i).type) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, ["slot", key])

    return ordered.mapInArrow(decide, T.StructType([ordered.schema["slot"], ordered.schema[key]]))


def verified_near_copies(df: DataFrame, key: str, text: str, threshold: float = SIMILARITY, rounds: int | None = None, partitions: int | None = None) -> DataFrame:
    """``(key, anchor, shared, united, similarity)``: each near copy beside the smallest leader it was found similar to.

    No link lies below the threshold. ``rounds`` ends the search after that many leaders of each bucket; by default it goes
    on until every bucket is settled. Null keys, null texts, and those below three words, have no copies.
    """
    bands = near_duplicate_bands(df, key, text, partitions).where(quoted(key).isNotNull())
    slots = cut_lineage(_crowded(cut_lineage(bands.select(key, F.xxhash64("band", "bucket").alias("slot")))))
    # Only texts that share a slot are ever compared: sets of the others are neither written nor moved.
    members = pin_small(slots.select(key).distinct())
    sets = shingle_sets(df.join(members, key, "left_semi"), key, text)
    marks = [F.xxhash64("shingles").alias("mark"), F.xxhash64(F.lit(1), "shingles").alias("mark2")]
    sets = cut_lineage(sets.select(key, "shingles", F.size("shingles").alias("size"), *marks, F.monotonically_increasing_id().alias("row")))
    copies = _first_copies(sets, key)
    # Where the search ends early, a copy counts as found only with its own leader.
    copies = cut_lineage(copies if rounds is None and threshold <= 1 else copies.withColumn("first", F.col(key)))
    firsts = copies.where(F.col(key) == F.col("first")).select(key)
    open_slots = cut_lineage(_crowded(slots.join(firsts, key, "left_semi")))
    sets = sets.join(pin_small(open_slots.select(key).distinct()), key, "left_semi")
    linked, prefixes, width, done = None, None, 1, 0
    while rounds is None or done < rounds:
        if width == 1:
            # A member meets its leader through the slot; equal pairs of several slots are one.
            block = open_slots.groupBy("slot").agg(F.min(key).alias("anchor"))
            asked = open_slots.join(block, "slot").where(F.col(key) != F.col("anchor")).select(key, "anchor").distinct()
        else:
            ranked = open_slots.withColumn("rank", F.row_number().over(W.partitionBy("slot").orderBy(key)))
            block = cut_lineage(ranked.where(F.col("rank") <= width).select("slot", F.col(key).alias("anchor")))
            if prefixes is None:
                members = pin_small(open_slots.select(key).distinct())
                prefixes = cut_lineage(_prefixes(sets.join(members, key, "left_semi"), key, threshold))
            asked = _meeting(open_slots, block, prefixes, key, threshold)
        found = cut_lineage(_measured(asked, sets, key, threshold))
        edges = open_slots.join(found, key).join(block, ["slot", "anchor"])
        own = block.withColumnRenamed("anchor", key)
        if width > 1:
            edges = cut_lineage(edges)
            followers = _followers(edges.join(own, ["slot", key], "left_semi"), key)
            edges = edges.join(followers.withColumnRenamed(key, "anchor"), ["slot", "anchor"], "left_anti")
        links = cut_lineage(edges)
        linked = links if linked is None else linked.unionByName(links)
        left = open_slots.join(own.unionByName(links.select("slot", key)), ["slot", key], "left_anti")
        open_slots = cut_lineage(_crowded(left))
        done += 1
        if open_slots.isEmpty():
            break
        width = width * GROWTH if rounds is None else 1
    # Of a key with several texts the pair that shares most.
    best = linked.groupBy(F.col(key).alias("first")).agg(F.min(F.struct("anchor", (-F.col("shared")).alias("less"), "united")).alias("b"))
    of_all = copies.join(best, "first", "left").where(F.col("b").isNotNull() | (F.col(key) != F.col("first")))
    shared, united = F.coalesce(-F.col("b.less"), "size").alias("shared"), F.coalesce("b.united", "size").alias("united")
    return of_all.select(key, F.coalesce("b.anchor", "first").alias("anchor"), shared, united).withColumn("similarity", F.col("shared") / F.col("united"))
