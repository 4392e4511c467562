"""Violation detection: declarative checks, counted by aggregates over scans of the table, a hundred checks each."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.dates import format_hits, matched_format, text_to_timestamp, timestamp_of
from siltworks.functions.hashing import row_digest
from siltworks.functions.numbers import NATIVE_NUMERIC, UNIT_NUMBER_RE, infinity_flag, number_of, unit_number
from siltworks.functions.strings import NULL_TOKENS, normalised_text, signature
from siltworks.operators.anomaly import fences
from siltworks.operators.frequency import top_per_column, value_key
from siltworks.operators.inference import CATEGORICAL, DATETIME, NUMERIC, inferred_map, quoted, repeated_texts, times_where, value_times
from siltworks.operators.profiling import SENTINEL_SHARE, SENTINELS
from siltworks.operators.skew import skew_safe_lookup
from siltworks.session import cut_lineage

CRITICAL, INFO = "CRITICAL", "INFO"
# Personal-data patterns and column-name words.
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_RE = r"(^|[^0-9])(\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-]?[0-9]{4}([^0-9]|$)"
SSN_RE = r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)"
PII_PATTERNS = {"email": EMAIL_RE, "phone": PHONE_RE, "ssn": SSN_RE}
PII_NAMES = ("email", "phone", "ssn", "address", "first_name", "last_name", "full_name")
# Shares and sizes that decide a finding.
PII_SHARE, FORMAT_SHARE, ID_FACTOR, SMALL_ROWS, UNIT_SHARE, MEASURED_SHARE = 0.5, 0.9, 0.9, 500, 0.01, 0.6
SECOND_SHARE = 0.05
TARGETS_LISTED = 5
# Checks that one aggregate counts; a wide table has thousands, too many for one.
CHECK_CHUNK = 100
# Categories whose checks, where they name one column, read nothing else.
VALUE_CHECKS = ("MISSING_DATA", "SENTINEL_VALUE", "TYPE_ERROR", "OUTLIER", "PII_DETECTED", "FORMAT_INCONSISTENCY")

VIOLATION_SCHEMA = (
    "violation_id long, severity string, category string, subtype string, affected_columns array<string>, "
    "description string, evidence string, suggested_action string, n_rows long"
)


@dataclass
class Rules:
    """What is known about a table: limits, orders and row rules a user declares."""

    target: str | None = None
    as_of: dt.date | None = None
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    ordered_dates: list[tuple[str, str]] = field(default_factory=list)
    row_rules: dict[str, str] = field(default_factory=dict)
    custom: dict[str, tuple[str, str]] = field(default_factory=dict)
    leaky: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    sentinels: dict[str, list[float]] = field(default_factory=dict)
    # Asked for: statistical outliers of every number column, and texts that come in several shapes.
    outliers: bool = False
    shapes: bool = False


@dataclass
class Check:
    """One thing to count, and what it means when the count reaches its share of the base.

    With a ``gate``, a condition and a share, it means so only where the condition reaches that share too; with ``below``, only where it does not.
    """

    category: str
    severity: str
    columns: list[str]
    hit: Column
    description: str
    action: str
    subtype: str | None = None
    base: Column | None = None
    share: float = 0.0
    gate: tuple[Column, float] | None = None
    below: bool = False


def run_checks(df: DataFrame, checks: list[Check], repeated: list[str] | None = None) -> DataFrame:
    """Violations of all checks that fire, numbered in the order of the checks.

    One scan per ``CHECK_CHUNK`` checks, which reads only the columns of these; one row per task and scan is shuffled.
    Checks of a single ``repeated`` column look at its different values, each counted as often as it comes.
    """
    if not checks:
        return df.sparkSession.createDataFrame([], VIOLATION_SCHEMA)
    placed = list(enumerate(checks))
    alone = {c: [(i, k) for i, k in placed if k.columns == [c] and k.category in VALUE_CHECKS] for c in repeated or ()}
    taken = {i for own in alone.values() for i, _ in own}
    rest = [p for p in placed if p[0] not in taken]
    parts = [_fired(df, rest[i : i + CHECK_CHUNK]) for i in range(0, len(rest), CHECK_CHUNK)]
    for c, own in alone.items():
        if own:
            values, times = value_times(df, c)
            parts += [_fired(values, own[i : i + CHECK_CHUNK], times) for i in range(0, len(own), CHECK_CHUNK)]
    found = reduce(DataFrame.unionAll, parts)
    return found.coalesce(1).sortWithinPartitions("violation_id") if taken else found


def _fired(df: DataFrame, placed: list[tuple[int, Check]], times: Column | None = None) -> DataFrame:
    """The checks of one scan that fire, each with its position; with ``times``, a row of ``df`` stands for so many."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    structs = []
    for i, c in placed:
        aggs += [times_where(F.coalesce(c.hit, F.lit(False)), times).alias(f"h{i}"), times_where(c.base if c.base is not None else F.lit(True), times).alias(f"b{i}")]
        hits, base = F.col(f"h{i}"), F.col(f"b{i}")
        fires = (hits > 0) & (hits >= F.lit(c.share) * base)
        if c.gate is not None:
            condition, least = c.gate
            aggs.append(times_where(F.coalesce(condition, F.lit(False)), times).alias(f"g{i}"))
            reached = F.col(f"g{i}") >= F.lit(least) * base
            fires = fires & (~reached if c.below else reached)
        structs.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c.severity).alias("severity"),
                F.lit(c.category).alias("category"),
                F.lit(c.subtype).cast("string").alias("subtype"),
                F.array(*[F.lit(x) for x in c.columns]).alias("affected_columns"),
                F.lit((f"[{c.subtype}] " if c.subtype else "") + c.description).alias("description"),
                F.concat(hits.cast("string"), F.lit(" of "), base.cast("string"), F.lit(" rows")).alias("evidence"),
                F.lit(c.action).alias("suggested_action"),
                hits.alias("n_rows"),
                fires.alias("fires"),
            )
        )
    found = df.agg(*aggs).select(F.explode(F.filter(F.array(*structs), lambda s: s["fires"])).alias("s")).select("s.*")
    return found.select((F.col("position") + 1).cast("long").alias("violation_id"), *[c for c in found.columns if c not in ("position", "fires")])


def sentinel_checks(df: DataFrame, rules: Rules, types: dict[str, str]) -> list[Check]:
    """Numeric sentinels by share, infinities, texts that stand for a missing value."""
    out = []
    for f in df.schema.fields:
        c, kind = f.name, types[f.name]
        severity = CRITICAL if c == rules.target else INFO
        if kind == NUMERIC:
            x = number_of(c, f.dataType)
            for s in rules.sentinels.get(c, SENTINELS):
                out.append(Check("SENTINEL_VALUE", severity, [c], x == float(s), f"{c} holds the value {s:g}, likely a sentinel", f"set {s:g} in {c} to null", base=x.isNotNull(), share=SENTINEL_SHARE))
            if not isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
                out.append(Check("SENTINEL_VALUE", CRITICAL, [c], infinity_flag(c, f.dataType), f"{c} holds infinite values", f"set infinite values in {c} to null"))
        if isinstance(f.dataType, T.StringType):
            token = F.upper(F.trim(quoted(c))).isin(*NULL_TOKENS)
            out.append(Check("SENTINEL_VALUE", severity, [c], token, f"{c} holds texts that stand for a missing value", f"set null-like texts in {c} to null"))
    return out


def temporal_checks(df: DataFrame, rules: Rules) -> list[Check]:
    """Declared date pairs out of order."""
    out = []
    for a, b in rules.ordered_dates:
        early, late = timestamp_of(a, df.schema[a].dataType), timestamp_of(b, df.schema[b].dataType)
        out.append(Check("TEMPORAL_VIOLATION", CRITICAL, [a, b], early > late, f"{a} lies after {b}", f"set the wrong date of {a}, {b} to null", base=early.isNotNull() & late.isNotNull()))
    return out


def row_rule_checks(rules: Rules) -> list[Check]:
    """Declared predicates that must hold; a predicate that is null does not count as broken."""
    out = []
    for predicate, columns in ((p, sorted(set(re.findall(r"[A-Za-z_]\w*", c)))) for p, c in rules.row_rules.items()):
        out.append(Check("CROSS_COLUMN_LOGIC", CRITICAL, columns, ~F.expr(predicate), f"rule does not hold: {predicate}", "review the rows", base=F.expr(predicate).isNotNull()))
    return out


def custom_checks(rules: Rules) -> list[Check]:
    """User rules with their own severity."""
    return [Check("OTHER", severity, [], F.expr(predicate), name, "review the rows") for name, (predicate, severity) in rules.custom.items()]


def type_checks(df: DataFrame, types: dict[str, str]) -> list[Check]:
    """Numbers or dates stored as text; numbers that carry a unit.

    Units are to be taken out only where most values are numbers, with a unit or without; a column of codes, some of
    which look like ``12B``, is only told of.
    """
    out = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.StringType):
            continue
        c, kind = quoted(f.name), types[f.name]
        if kind != CATEGORICAL:
            out.append(Check("TYPE_ERROR", CRITICAL, [f.name], c.isNotNull(), f"{f.name} is {kind} but stored as text", f"cast {f.name}", subtype="STORED_AS_TEXT", base=c.isNotNull()))
        measured = (unit_number(c).isNotNull(), MEASURED_SHARE)
        united = {"subtype": "UNIT_SUFFIX", "base": c.isNotNull(), "share": UNIT_SHARE, "gate": measured}
        out.append(Check("TYPE_ERROR", CRITICAL, [f.name], c.rlike(UNIT_NUMBER_RE), f"{f.name} holds numbers with a unit", f"extract the number in {f.name}", **united))
        if kind == CATEGORICAL:
            out.append(Check("TYPE_ERROR", INFO, [f.name], c.rlike(UNIT_NUMBER_RE), f"{f.name} holds a few texts that look like numbers with a unit", "none", below=True, **united))
    return out


def missing_checks(df: DataFrame, rules: Rules) -> list[Check]:
    """Missing or infinite values of the target only; missing features are not a violation."""
    if rules.target is None or rules.target not in df.columns:
        return []
    dtype = df.schema[rules.target].dataType
    bad = number_of(rules.target, dtype).isNull() if isinstance(dtype, NATIVE_NUMERIC) else quoted(rules.target).isNull()
    return [Check("MISSING_DATA", CRITICAL, [rules.target], bad, f"target {rules.target} is missing or infinite", f"drop rows without {rules.target} as the last step")]


def outlier_checks(df: DataFrame, rules: Rules, types: dict[str, str], bounds: dict | None = None) -> list[Check]:
    """Declared impossible ranges, future dates, statistical outliers."""
    out = []
    for c, (low, high) in rules.ranges.items():
        x = number_of(c, df.schema[c].dataType)
        hit = F.lit(False)
        hit = hit | (x < low) if low is not None else hit
        hit = hit | (x > high) if high is not None else hit
        out.append(Check("OUTLIER", CRITICAL, [c], hit, f"{c} lies outside [{low}, {high}]", f"set impossible values of {c} to null", subtype="IMPOSSIBLE", base=x.isNotNull()))
    if rules.as_of is not None:
        for c, kind in types.items():
            if kind == DATETIME:
                d = timestamp_of(c, df.schema[c].dataType)
                out.append(Check("OUTLIER", CRITICAL, [c], d > F.lit(rules.as_of).cast("timestamp"), f"{c} lies in the future", f"set future dates of {c} to null, keep the row", subtype="TEMPORAL", base=d.isNotNull()))
    for c, fence in (bounds or {}).items():
        out.append(Check("OUTLIER", INFO, [c], fence.flag(number_of(c, df.schema[c].dataType)), f"{c} holds extreme values", "none", subtype="STATISTICAL"))
    return out


def pii_checks(df: DataFrame) -> list[Check]:
    """Share of values that look like personal data, or a telling column name."""
    out = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.StringType):
            continue
        c = quoted(f.name)
        for kind, pattern in PII_PATTERNS.items():
            out.append(Check("PII_DETECTED", INFO, [f.name], c.rlike(pattern), f"{f.name} looks like {kind}", f"drop {f.name}", subtype=kind, base=c.isNotNull(), share=PII_SHARE))
        if any(word in f.name.lower() for word in PII_NAMES):
            out.append(Check("PII_DETECTED", INFO, [f.name], c.isNotNull(), f"{f.name} is named like personal data", f"drop {f.name}", subtype="name", base=c.isNotNull()))
    return out


def format_checks(df: DataFrame, types: dict[str, str]) -> list[Check]:
    """Dates of one column written in several formats: values outside its first known format, while others are inside."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and types[f.name] == DATETIME:
            hits = [h for _, h in format_hits(quoted(f.name))]
            parsed = text_to_timestamp(quoted(f.name)).isNotNull()
            first = F.coalesce(hits[0], hits[1]).isNotNull()
            out.append(Check("FORMAT_INCONSISTENCY", INFO, [f.name], parsed & ~first, f"{f.name} mixes date formats", f"parse {f.name} with all formats", base=parsed))
    return out


def date_formats(df: DataFrame, column: str) -> DataFrame:
    """``(format, n)``: how many values of a text column each known date format reads; null for those none reads."""
    named = df.where(quoted(column).isNotNull()).select(matched_format(quoted(column)).alias("format"))
    return named.groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def detect(df: DataFrame, rules: Rules | None = None, types: dict[str, str] | None = None, bounds: dict | None = None, repeated: list[str] | None = None) -> DataFrame:
    """All violations that row-wise checks can find, then duplicates, in one numbered table."""
    rules = rules or Rules()
    repeated = repeated_texts(df) if repeated is None else repeated
    types = types or inferred_map(df, repeated=repeated)
    bounds = fences(df) if bounds is None and rules.outliers else bounds
    checks = [
        *missing_checks(df, rules),
        *sentinel_checks(df, rules, types),
        *temporal_checks(df, rules),
        *row_rule_checks(rules),
        *type_checks(df, types),
        *outlier_checks(df, rules, types, bounds),
        *pii_checks(df),
        *format_checks(df, types),
        *custom_checks(rules),
    ]
    found = run_checks(df, checks, repeated)
    out = found.unionByName(duplicate_violation(df, rules.keys or df.columns, len(checks) + 1))
    texts = [c for c, t in types.items() if t == CATEGORICAL and isinstance(df.schema[c].dataType, T.StringType)]
    return out.unionByName(shape_violations(df, texts, len(checks) + 2)) if rules.shapes and texts else out


def mixed_shapes(df: DataFrame, columns: list[str], dominant: float = FORMAT_SHARE, second: float = SECOND_SHARE) -> DataFrame:
    """``(column, shape, n, second_shape, second_n, shapes, total)`` of the text columns that come in several shapes.

    A shape is a signature with runs folded, so that words of different length have one. A column is mixed when its commonest
    shape covers at least half of its values but less than ``dominant``, and another one at least ``second``: prose, where no
    shape is common, is not. One row per column and shape crosses the network, long shapes as their beginning and a digest.
    """
    shapes = df.select(*[value_key(F.regexp_replace(signature(quoted(c)), r"([A9_.])\1+", "$1")).alias(c) for c in columns])
    counted = shapes.unpivot([], columns, "column", "value").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("shapes"))
    top = top_per_column(counted, 2).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
    first, other = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    rows = top.join(F.broadcast(totals), "column").select(
        "column", first["value"].alias("shape"), first["n"].alias("n"), other["value"].alias("second_shape"), other["n"].alias("second_n"), "shapes", "total"
    )
    return rows.where((F.col("n") >= 0.5 * F.col("total")) & (F.col("n") < dominant * F.col("total")) & (F.col("second_n") >= second * F.col("total")))


def shape_violations(df: DataFrame, columns: list[str], number: int) -> DataFrame:
    """A finding per column of several shapes, with both shapes and their counts; numbered from ``number`` in order of the columns."""
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    return mixed_shapes(df, columns).select(
        (F.lit(number - 1) + place).cast("long").alias("violation_id"),
        F.lit(INFO).alias("severity"),
        F.lit("FORMAT_INCONSISTENCY").alias("category"),
        F.lit("SHAPE").alias("subtype"),
        F.array("column").alias("affected_columns"),
        F.concat(F.col("column"), F.lit(" comes in several shapes")).alias("description"),
        F.format_string("%s in %d and %s in %d of %d values", "shape", "n", "second_shape", "second_n", "total").alias("evidence"),
        F.lit("bring the values into one shape").alias("suggested_action"),
        (F.col("total") - F.col("n")).alias("n_rows"),
    )


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(digest, n)`` of rows that occur more than once; 16 bytes per distinct row cross the network, not the row."""
    names = columns or df.columns
    return df.groupBy(row_digest(names).alias("digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: groups of equal rows, rows in them, and rows beyond the first of each."""
    return duplicate_groups(df, columns).agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
    )


def duplicate_violation(df: DataFrame, columns: list[str], number: int) -> DataFrame:
    counted = duplicate_summary(df, columns).where("rows > 0")
    return counted.select(
        F.lit(number).cast("long").alias("violation_id"),
        F.lit(INFO).alias("severity"),
        F.lit("DUPLICATE").alias("category"),
        F.lit("EXACT").alias("subtype"),
        F.array(*[F.lit(c) for c in columns]).alias("affected_columns"),
        F.lit("[EXACT] equal rows").alias("description"),
        F.concat(F.col("surplus").cast("string"), F.lit(" surplus rows in "), F.col("groups").cast("string"), F.lit(" groups")).alias("evidence"),
        F.lit("keep one row of each group").alias("suggested_action"),
        F.col("rows").alias("n_rows"),
    )


def near_duplicates_normalised(df: DataFrame, text: str) -> DataFrame:
    """One row: groups of texts equal up to case, punctuation and spacing."""
    shaped = df.select(F.unhex(F.md5(normalised_text(quoted(text)))).alias("digest"))
    groups = shaped.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus")
    )


# Multiplier and offset of each hash function of the sketch, drawn independently, modulo a Mersenne prime.
_PRIME = 2_147_483_647
_SEEDS = (
    (304_572_262, 1_938_672_329),
    (2_077_048_831, 535_143_864),
    (319_740_139, 501_680_725),
    (414_808_610, 354_535_317),
    (2_133_449_098, 2_141_167_558),
    (145_149_928, 1_913_911_866),
    (1_994_587_971, 183_052_704),
    (493_020_052, 301_316_274),
    (692_061_955, 2_052_187_672),
    (1_903_991_941, 82_108_813),
    (1_777_399_355, 975_188_785),
    (1_807_215_801, 375_712_170),
)
SHINGLE_WORDS, BAND_ROWS = 3, 3


def near_duplicate_bands(df: DataFrame, key: str, text: str, partitions: int | None = None) -> DataFrame:
    """``(key, band, bucket)``: min-hash sketch of word triples of the whole text, in bands.

    Triples become rows and fold to twelve minima per text inside the task that read it; only those numbers, not the
    texts, are shuffled. ``partitions`` spreads the texts first, for a source that offers fewer splits than there are
    cores; a large source needs none. Two texts that share a bucket are near copies with high probability. Texts below three words
    have no triple and no bucket.
    """
    texts = df.select(quoted(key).alias(key), quoted(text).alias("_text"))
    texts = texts if partitions is None else texts.repartition(partitions, key)
    words = texts.select(key, F.split(normalised_text(F.col("_text")), " ").alias("w"))
    placed = words.select(key, "w", F.posexplode("w").alias("p", "first")).where(F.col("p") <= F.size("w") - SHINGLE_WORDS)
    rest = [F.get("w", F.col("p") + i) for i in range(1, SHINGLE_WORDS)]
    exploded = placed.select(key, F.concat_ws(" ", "first", *rest).alias("t"))
    hashed = exploded.select(key, F.conv(F.substring(F.md5("t"), 1, 7), 16, 10).cast("long").alias("h"))
    sketched = hashed.groupBy(key).agg(*[F.min((F.col("h") * F.lit(a) + F.lit(b)) % F.lit(_PRIME)).alias(f"m{i}") for i, (a, b) in enumerate(_SEEDS)])
    bands = [
        F.struct(F.lit(i // BAND_ROWS).alias("band"), F.concat_ws("-", *[F.col(f"m{j}").cast("string") for j in range(i, i + BAND_ROWS)]).alias("bucket"))
        for i in range(0, len(_SEEDS), BAND_ROWS)
    ]
    return sketched.select(key, F.explode(F.array(*bands)).alias("b")).select(key, "b.band", "b.bucket")


def near_duplicates(df: DataFrame, key: str, text: str, partitions: int | None = None) -> DataFrame:
    """``(key, anchor)``: every row that shares a bucket with another, beside the smallest key it shares one with.

    A bucket emits one line per member, to its smallest key, never its pairs. The buckets' anchors come from an
    aggregate with partial results, so a bucket that holds a third of all rows is one small row per task; the way
    back joins through the bucket-safe lookup, heavy buckets broadcast.
    """
    # The sketch reads every text, so it is written once; what is written is four numbers per text.
    slots = near_duplicate_bands(df, key, text, partitions).select(key, F.xxhash64("band", "bucket").alias("slot"))
    bands = cut_lineage(slots)
    anchors = bands.groupBy("slot").agg(F.min(key).alias("anchor"), F.count(F.lit(1)).alias("size")).where("size > 1")
    linked = skew_safe_lookup(bands, anchors, "slot", "size", "anchor").where("anchor is not null")
    return linked.groupBy(key).agg(F.min("anchor").alias("anchor"))


def drop_candidates(profile_rows: DataFrame, violations: DataFrame | None = None, target: str | None = None, leaky: list[str] | None = None) -> DataFrame:
    """``(column, reason)``: identifiers, constants, personal data and declared leaks; never the target."""
    own = profile_rows.where(F.col("column") != F.lit(target or ""))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("unique_factor") > ID_FACTOR, "identifier"),
            F.when(F.col("unique_count") <= 1, "constant"),
            F.when(F.col("column").isin(*(leaky or [""])), "leaks the outcome"),
        )
    )
    out = own.select("column", F.explode(reasons).alias("reason"))
    if violations is not None:
        personal = violations.where("category = 'PII_DETECTED'").select(F.explode("affected_columns").alias("column"), F.lit("personal data").alias("reason"))
        out = out.unionByName(personal.where(F.col("column") != F.lit(target or ""))).distinct()
    return out


def task_type(df: DataFrame, target: str, few: int = 20) -> DataFrame:
    """One row: task type from the target's distinct values and type."""
    c = quoted(target)
    text = isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType))
    whole = isinstance(df.schema[target].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
    n = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_classes"))
    many = F.lit("multiclass_classification") if text else F.lit("regression")
    few_is_class = F.lit(text or whole)
    return n.select(
        F.lit(target).alias("target"),
        "n_classes",
        F.when(F.col("n_classes") == 2, "binary_classification")
        .when(few_is_class & (F.col("n_classes") <= few), "multiclass_classification")
        .otherwise(many)
        .alias("task_type"),
    )


def target_candidates(profile_rows: DataFrame, question: str = "", limit: int = TARGETS_LISTED) -> DataFrame:
    """Ranked target columns: named in the question first, then complete, then by few distinct values; with a reason.

    Identifiers and constants are never proposed.
    """
    words = [w for w in re.split(r"\W+", question.lower()) if len(w) > 2]
    named = F.lit(False)
    for w in words:
        named = named | F.lower("column").contains(w)
    usable = profile_rows.where((F.col("unique_factor") <= ID_FACTOR) & (F.col("unique_count") > 1) & (F.col("inferred_type") != DATETIME))
    ranked = usable.select(
        "column",
        named.alias("named"),
        "completeness",
        "unique_count",
        F.concat(
            F.when(named, F.lit("named in the question; ")).otherwise(F.lit("")),
            F.col("inferred_type"),
            F.lit(", "),
            F.col("unique_count").cast("string"),
            F.lit(" distinct values"),
        ).alias("rationale"),
    )
    return ranked.orderBy(F.desc("named"), F.desc("completeness"), "unique_count", "column").limit(limit)


def choose_target(columns: list[str], candidates: list[str], current: str | None = None, wanted: str | None = None) -> str | None:
    """A target already set stays; an explicit one wins over the ranking and must exist; else the first candidate."""
    if current:
        return current
    if wanted is not None:
        if wanted not in columns:
            raise ValueError(f"target '{wanted}' is not a column: {columns}")
        return wanted
    return candidates[0] if candidates else None


def caveats(df: DataFrame, violations: DataFrame) -> DataFrame:
    """Messages an answer should carry: a small table, and the share of rows behind each sentinel or missing finding."""
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    small = total.where(F.col("rows") < SMALL_ROWS).select(F.concat(F.lit("small data: "), F.col("rows").cast("string"), F.lit(" rows")).alias("caveat"))
    share = (
        violations.where(F.col("category").isin("SENTINEL_VALUE", "MISSING_DATA"))
        .withColumn("rows", total.scalar())
        .select(F.concat(F.array_join("affected_columns", ", "), F.lit(": "), F.lower("category"), F.lit(" in "), F.format_number(F.col("n_rows") / F.col("rows") * 100, 1), F.lit("% of rows")).alias("caveat"))
    )
    return small.unionByName(share)


def findings_summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("findings"), F.sum("n_rows").alias("n_rows"))


def suppress_fixed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings of this pass without those of the previous pass whose evidence is gone (no rows left)."""
    names = F.array_join(F.array_sort("affected_columns"), ",")
    gone = previous.select("category", names.alias("_names")).distinct()
    marked = current.withColumn("_names", names)
    settled = marked.where("n_rows = 0").join(gone, ["category", "_names"], "left_anti")
    return marked.where("n_rows > 0").unionByName(settled).drop("_names")


