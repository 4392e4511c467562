"""Deterministic hashes that do not change between runs, processes or partitionings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# JSON text of times keeps microseconds; the default would cut them to milliseconds.
WHOLE_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def seeded_md5(key: Column, seed: int | str) -> Column:
    """Hex digest of the key's text followed by the seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def hex_bits(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hex characters of a digest as an integer, from the 1-based position ``start``."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def hash_bucket(c: Column, buckets: int) -> Column:
    """Bucket number of a text, equal in every process; null stays null."""
    return F.pmod(hex_bits(F.md5(c), 1, 8), F.lit(buckets))


def row_digest(columns: list[str]) -> Column:
    """128-bit digest of whole rows: equal rows, nulls included, have equal digests."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), WHOLE_TIMES)))
