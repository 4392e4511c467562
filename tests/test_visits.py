"""A small messy table with one known defect per kind, from raw text to a clean table."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltworks.operators import profiling as pr
from siltworks.operators.inference import inferred_map
from siltworks.operators.quality import quality_score
from siltworks.operators.violations import Rules, choose_target, detect, suppress_fixed
from siltworks.plans.passes import clean_in_passes
from siltworks.plans.recipe import replay
from siltworks.sources.readers import attach_notes, concat_columns, read_csv, shape_summary

COLUMNS = ["patient_id", "visit_date", "age", "systolic_bp", "diastolic_bp", "temperature_c", "bill_usd", "plan", "email"]
AS_OF = dt.date(2026, 3, 1)


def visits() -> list[list[str]]:
    rows = [[f"P{i:04d}", f"2026-01-{i % 28 + 1:02d}", str(30 + i % 40), str(110 + i % 30), str(70 + i % 15), "36.6", f"{100 + i}.50", "PPO" if i % 3 else "HMO", f"p{i}@example.com"] for i in range(60)]
    rows[1][1] = "01/17/2026"
    rows[2][1] = "2026-13-01"
    rows[3][1] = "not_a_date"
    rows[4][1] = "2030-05-01"
    rows[5][2] = "-4"
    rows[6][3] = "120 mmHg"
    rows[7][3] = "one twenty"
    rows[8][3] = ""
    rows[9][3], rows[9][4] = "80", "120"
    rows[10][5] = "36.7C"
    rows[11][5] = "-273.15"
    rows[12][5] = "NaN"
    rows[13][6] = "Infinity"
    rows[14][6] = "1e309"
    rows[15][6] = ""
    rows[16][6] = "120USD"
    rows[17][7] = "UNKNOWN"
    rows[18][7] = " HMO "
    rows[19][8] = ""
    rows[20] = list(rows[21])
    return rows


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("visits") / "visits.csv"
    path.write_text("\n".join([",".join(COLUMNS)] + [",".join(r) for r in visits()]) + "\n")
    return read_csv(spark, str(path)).persist()


@pytest.fixture(scope="module")
def profile(raw):
    return {r["column"]: r for r in pr.profile(raw, pr.ProfileOptions(as_of=AS_OF)).collect()}


def test_everything_is_read_as_text(raw):
    assert {t for _, t in raw.dtypes} == {"string"} and raw.count() == 60
    assert shape_summary(raw, "visits.csv").first().asDict() == {"name": "visits.csv", "rows": 60, "columns": 9}


def test_types_follow_the_values(raw):
    assert inferred_map(raw) == {
        "patient_id": "Categorical",
        "visit_date": "Datetime",
        "age": "Numeric",
        "systolic_bp": "Numeric",
        "diastolic_bp": "Numeric",
        "temperature_c": "Numeric",
        "bill_usd": "Numeric",
        "plan": "Categorical",
        "email": "Categorical",
    }


def test_default_null_tokens(profile):
    missing = {c: r["row_count"] - r["non_null"] for c, r in profile.items() if r["row_count"] != r["non_null"]}
    assert missing == {"systolic_bp": 1, "temperature_c": 1, "bill_usd": 1, "email": 1}


def test_defects_are_counted(profile):
    assert profile["age"]["negative_count"] == 1 and profile["age"]["min"] == -4
    assert profile["systolic_bp"]["coercion_failure_count"] == 2
    assert profile["systolic_bp"]["coercion_failure_samples"] == "120 mmHg|one twenty"
    assert profile["bill_usd"]["inf_nan_count"] == 3 and profile["bill_usd"]["coercion_failure_count"] == 2
    assert profile["bill_usd"]["coercion_failure_samples"] == "120USD|1e309"
    date = profile["visit_date"]
    assert (date["coercion_failure_count"], date["future_date_count"]) == (2, 1)
    assert date["latest"] == "2030-05-01T00:00:00" and date["coercion_failure_samples"] == "2026-13-01|not_a_date"
    assert profile["patient_id"]["unique_count"] == 59 and profile["plan"]["dominant_pattern"] == "AAA"


def test_warnings(profile):
    assert profile["patient_id"]["warnings"] == ["High Cardinality"]
    assert profile["plan"]["warnings"] == ["Leading/Trailing Whitespace"]
    assert profile["age"]["warnings"] == ["Contains Negative Values"]
    assert profile["visit_date"]["warnings"] == ["Future Dates Detected: 1 values after 2026-03-01"]
    assert "Near Constant Value" not in profile["temperature_c"]["warnings"]


def test_score_flags_the_target(raw):
    score = quality_score(pr.profile(raw, pr.ProfileOptions(as_of=AS_OF)), "bill_usd").first()
    assert score["structural_integrity"] == 0.4
    assert score["target_integrity"] == pytest.approx(59 / 60 * (1 - 3 / 60), abs=5e-4)
    assert "target_inf_nan: bill_usd has 3 inf/nan values" in score["flags"]
    assert "target_column_not_found: x" in quality_score(pr.profile(raw), "x").first()["flags"]


RULES = Rules(target="bill_usd", as_of=AS_OF, ranges={"age": (0.0, 120.0), "temperature_c": (25.0, 45.0)}, row_rules={"cast(diastolic_bp as double) < 100": "diastolic_bp"}, keys=COLUMNS)


def test_violations_name_the_defects(raw):
    found = {(r["category"], r["subtype"], ",".join(r["affected_columns"])): r["n_rows"] for r in detect(raw, RULES).collect()}
    assert found[("OUTLIER", "IMPOSSIBLE", "age")] == 1
    assert found[("OUTLIER", "IMPOSSIBLE", "temperature_c")] == 1
    assert found[("OUTLIER", "TEMPORAL", "visit_date")] == 1
    assert found[("TYPE_ERROR", "UNIT_SUFFIX", "systolic_bp")] == 1
    assert found[("SENTINEL_VALUE", None, "plan")] == 1
    assert found[("SENTINEL_VALUE", None, "bill_usd")] == 1
    assert found[("MISSING_DATA", None, "bill_usd")] == 1
    assert found[("PII_DETECTED", "email", "email")] == 59
    assert found[("FORMAT_INCONSISTENCY", None, "visit_date")] == 1
    assert found[("CROSS_COLUMN_LOGIC", None, "diastolic_bp")] == 1
    assert found[("DUPLICATE", "EXACT", ",".join(COLUMNS))] == 2
    ids = [r["violation_id"] for r in detect(raw, RULES).collect()]
    assert len(set(ids)) == len(ids)


def test_passes_clean_the_table(raw):
    rules = Rules(target="bill_usd", as_of=AS_OF, ranges=RULES.ranges)
    result = clean_in_passes(raw, rules)
    clean = result.table.persist()
    types = dict(clean.dtypes)
    assert types["bill_usd"] == "double" and types["visit_date"] == "timestamp" and "email" not in types
    # Missing, infinite and overflowing bills go; the amount with a unit is kept.
    assert clean.count() == 57 and clean.where("bill_usd = 120").count() == 1
    assert clean.where("age < 0 or temperature_c < 25").count() == 0
    assert clean.where("visit_date is null").count() == 3
    assert len(result.history) == 2 and result.history[-1]["critical"] == 0 and result.history[-1]["steps_executed"] == 0
    again = replay(result.steps, raw, "bill_usd")
    key = clean.columns
    assert sorted(map(str, again.select(key).collect())) == sorted(map(str, clean.collect()))


def test_target_choice():
    assert choose_target(["a", "b"], ["b"], current="x", wanted="a") == "x"
    assert choose_target(["a", "b"], ["b"], wanted="a") == "a"
    assert choose_target(["a", "b"], ["b"]) == "b" and choose_target(["a"], []) is None
    with pytest.raises(ValueError):
        choose_target(["a", "b"], ["b"], wanted="c")


def test_repeated_findings_are_suppressed(spark):
    schema = "category string, affected_columns array<string>, n_rows long"
    previous = spark.createDataFrame([("OUTLIER", ["a"], 4), ("OUTLIER", ["b"], 4)], schema)
    current = spark.createDataFrame([("OUTLIER", ["a"], 0), ("OUTLIER", ["b"], 2), ("OTHER", ["a"], 0)], schema)
    got = {(r["category"], r["affected_columns"][0]) for r in suppress_fixed(current, previous).collect()}
    assert got == {("OUTLIER", "b"), ("OTHER", "a")}


def test_parts_and_notes(spark):
    a, b = spark.range(3).withColumn("x", F.col("id") * 2), spark.range(1, 4).withColumn("y", F.col("id"))
    assert concat_columns(a, None, "id") is a and concat_columns(None, b, "id") is b and concat_columns(None, None, "id") is None
    assert concat_columns(a, b, "id").count() == 2
    notes = spark.createDataFrame([(1, "first")], "row_number long, notes string")
    assert attach_notes(spark.range(1, 4).withColumnRenamed("id", "row_number"), notes).where("notes is null").count() == 2


def test_malformed_lines_stay_visible(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\n3,4,5\n")
    out = read_csv(spark, str(path), ["a", "b"], keep_corrupt=True)
    assert [r["_corrupt_record"] for r in out.orderBy("a").collect()] == [None, "3,4,5"]


def test_extended_and_approximate_profiles(raw):
    rows = {r["column"]: r for r in pr.profile(raw, pr.ProfileOptions(as_of=AS_OF, extended=True)).collect()}
    assert set(rows["age"]["metrics"]) >= {"n_missing", "std", "mad", "iqr"} and "avg_length" in rows["plan"]["metrics"]
    wide = pr.profile(raw, pr.ProfileOptions(as_of=AS_OF, extended=True, extended_column_limit=5))
    assert "metrics" not in wide.columns and wide.where("not array_contains(warnings, 'extended_skipped_wide_table')").count() == 0
    rough = {r["column"]: r for r in pr.profile(raw, pr.ProfileOptions(as_of=AS_OF, exact=False)).collect()}
    assert abs(rough["patient_id"]["unique_count"] - 59) <= 3 and rough["age"]["median"] is not None


def test_rows_that_differ_by_microseconds_are_no_duplicates(spark):
    from siltworks.operators.violations import duplicate_summary

    df = spark.range(3).select(F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.least(F.col("id"), F.lit(1))).alias("t"))
    for frame in (df, df.select(F.col("t").cast("timestamp_ntz").alias("t"))):
        assert duplicate_summary(frame).first().asDict() == {"groups": 1, "rows": 2, "surplus": 1}
