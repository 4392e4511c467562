"""Line dedup by distinct-site spread, in DataFrame operations only.

HyperLogLog sketches of the sites of each line hash are merged by aggregation; lines whose estimate is near the
threshold get an exact distinct count; lines on at least ``min_sites`` sites are boilerplate and are cut out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.frames import text_mark, text_of, written

MIN_SITES = 10
# A sketch of 2^10 slots errs by about 3 %; everything within these factors of the threshold is counted exactly.
SKETCH_LG, NEAR_LOW, NEAR_HIGH = 10, 0.7, 1.4
# A document that would lose more than this share of its characters is no page around boilerplate but the repeated text itself.
MOST_CUT = 0.5


def _copied_texts(df: DataFrame, text_col: str, site_col: str, min_sites: int) -> DataFrame:
    """Marks of the whole texts that stand on at least ``min_sites`` distinct sites, as rows of (doc)."""
    sites = df.select(text_mark(text_of(text_col)).alias("doc"), F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\0null")).alias("site")).distinct()
    return written(sites.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("doc"), "copied-texts")


def boilerplate_lines(df: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, copies: DataFrame | None = None) -> DataFrame:
    """Marks of the lines that stand on at least ``min_sites`` distinct sites, as rows of (line).

    Lines are what stands between line breaks, without blanks around; empty lines are never boilerplate, and a null
    site is a site like any other. Copies of a text count once for each of their sites; those of the texts in ``copies``
    count as one site together.
    """
    lines = F.array_distinct(F.transform(F.split(text_of(text_col), "\n"), lambda x: F.trim(x)))
    site = F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\0null"))
    if copies is not None:
        inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
        marked = df.toDF(*inner.values()).withColumn("doc", text_mark(text_of(inner[text_col]))).join(copies.withColumn("copied", F.lit(True)), "doc", "left")
        df = marked.select(F.col(inner[text_col]).alias(text_col), F.when(F.col("copied"), F.concat_ws("\0", F.lit("\0copy"), "doc.a", "doc.b")).otherwise(F.col(inner[site_col]).cast("string")).alias(site_col))
    rows = df.select(site.alias("site"), F.explode(F.filter(lines, lambda x: x != "")).alias("x"))
    rows = rows.select("site", text_mark(F.col("x")).alias("line"))
    sketches = rows.groupBy("line").agg(F.hll_sketch_agg("site", SKETCH_LG).alias("s"))
    spread = written(sketches.select("line", F.hll_sketch_estimate("s").alias("n")).where(F.col("n") >= min_sites * NEAR_LOW), "line-spread")
    far = spread.where(F.col("n") > min_sites * NEAR_HIGH).select("line")
    near = spread.where(F.col("n") <= min_sites * NEAR_HIGH).select("line")
    exact = rows.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line")
    return written(far.unionByName(exact), "boilerplate-lines")


def dedup_lines(df: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, most_cut: float | None = MOST_CUT, report: bool = False) -> DataFrame:
    """``df`` with boilerplate lines cut out of its texts; with ``report`` also n_lines and n_cut.

    The kept lines stay as they are, joined by line breaks. A text that would lose more than ``most_cut`` of its
    characters stays whole, as do null and empty texts. All rows and columns stay, repeated rows too.

    With ``most_cut`` None boilerplate is cut whatever its share of a text, and repeated texts are told by themselves:
    a whole text on at least ``min_sites`` sites counts as one site for its lines, so copies alone make no boilerplate.
    """
    copies = _copied_texts(df, text_col, site_col, min_sites) if most_cut is None else None
    marks = boilerplate_lines(df, text_col, site_col, min_sites, copies)
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
    text = F.col(inner[text_col])
    rows = df.toDF(*inner.values()).withColumn("doc", text_mark(F.coalesce(text.cast("string"), F.lit(""))))
    found = rows.select("doc", F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: text_mark(F.trim(x))))).alias("line"))
    cut = found.join(marks, "line").groupBy("doc").agg(F.collect_set("line").alias("cut"))
    joined = rows.join(cut, "doc", "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("cut"), text_mark(F.trim(x))))
    left = F.array_join(kept, "\n")
    cut_chars = F.aggregate(F.filter(lines, lambda x: F.array_contains(F.col("cut"), text_mark(F.trim(x)))), F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    acts = F.col("cut").isNotNull()
    if most_cut is not None:
        acts = acts & (cut_chars <= F.length(text) * F.lit(most_cut))
    out = [F.when(acts, left).otherwise(text).alias(c) if c == text_col else F.col(i).alias(c) for c, i in inner.items()]
    if report:
        out += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.when(acts, F.size(lines) - F.size(kept)).otherwise(F.lit(0)).cast("long").alias("n_cut")]
    return joined.select(*out)


def recount(df: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``df`` with the characters of the text in ``count_col``, where it has that column; null for a null text."""
    if count_col not in df.columns:
        return df
    kind = df.schema[count_col].dataType
    return df.withColumn(count_col, F.char_length(F.col(f"`{text_col}`")).cast(kind))
