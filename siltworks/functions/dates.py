"""Mixed-format date coercion: an ordered list of guarded formats, month first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (shape of the text, Spark pattern). A format is only tried on text of its shape, so a wrong text costs
# one regular expression and no parser exception. Where the month is not possible the day-first twin decides.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^[A-Z][a-z]{2} \d{1,2},? \d{4}$", "MMM d[,] yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
)
# One cheap look at the start of a text rules out nearly everything that is no date.
DATE_START_RE = r"^\s*(\d{1,4}[-/ ]|\d{8}\s*$|[A-Z][a-z]{2} )"
ISO_RE = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?$"


def format_hits(c: Column) -> list[tuple[str, Column]]:
    """Each known format with the timestamp it yields for the text, null where it does not fit."""
    text = F.trim(c)
    hits = [("iso", F.when(text.rlike(ISO_RE), text.try_cast("timestamp")))]
    hits += [(fmt, F.when(text.rlike(shape), _read(text, fmt))) for shape, fmt in DATE_FORMATS]
    return hits


def _read(text: Column, fmt: str) -> Column:
    """A text of the right shape to a timestamp. Plain dates are put in year, month, day order and cast, which raises no exceptions inside."""
    if set(fmt) - set("yMd-/"):
        return F.try_to_timestamp(text, F.lit(fmt))
    mark = "/" if "/" in fmt else "-"
    if mark in fmt:
        parts = {p[0]: F.split_part(text, F.lit(mark), F.lit(i + 1)) for i, p in enumerate(fmt.split(mark))}
    else:
        parts = {k: F.substring(text, fmt.index(k) + 1, fmt.count(k)) for k in "yMd"}
    day = F.concat_ws("-", parts["y"], parts["M"], parts["d"]).try_cast("date")
    return F.when(parts["y"] != "0000", day.cast("timestamp"))


def text_to_timestamp(c: Column) -> Column:
    """Text in any known format to a timestamp; anything else is null."""
    return F.when(c.rlike(DATE_START_RE), F.coalesce(*[hit for _, hit in format_hits(c)]))


def matched_format(c: Column) -> Column:
    """The name of the first format that parses the text."""
    return F.when(c.rlike(DATE_START_RE), F.coalesce(*[F.when(hit.isNotNull(), F.lit(name)) for name, hit in format_hits(c)]))


def timestamp_of(name: str, dtype: T.DataType) -> Column:
    """The timestamp behind a column of any type; null where there is none."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return text_to_timestamp(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    return F.lit(None).cast("timestamp")


def iso(c: Column) -> Column:
    """ISO text of a timestamp, with the fraction of a second where there is one."""
    return F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
