"""The registered corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.catalog.registry import Family
from siltworks.llm import decontaminate, exact_dedup, fertility, filter_audit, html_extract, jaccard_join, line_dedup, packing, quality, substring_dedup, toxicity, warc, whitening
from siltworks.llm.frames import LOWER, UPPER, crc_fold, table
from siltworks.session import scratch_path

family = Family()

QUALITY_AT, TOXIC_AT = 0.3, 0.5


@family.query(f"""
with n as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as norm from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256 from n
""")
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"), keep="largest")


@family.query()
def op2_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    found = html_extract.extract(pages, html_extract.train(pages), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@family.query()
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", crc_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


@family.query("""
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as payload_bytes, sha256(body) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first then first end as refers_to from f
""")
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    index = warc.write_archives(table(spark, folder, "pages"), root)
    return warc.read_records(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@family.query()
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    groups = jaccard_join.similar_groups(table(spark, folder, "documents"), jaccard_join.Rule(shingle=4, percent=85))
    return groups.select("doc_id", "n_shingles", "component_id")


@family.query()
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    words_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id", "n_words", words_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (words_hit > 0).alias("contaminated"),
    )


@family.query()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@family.query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", crc_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "worst")


@family.query(f"""
with c as (select text, count(distinct coalesce(source, chr(1))) >= {line_dedup.MIN_SITES} as copied from (select coalesce(text, '') as text, source from documents) group by 1),
l as (select d.doc_id, d.text, case when c.copied then 'copies of ' || md5(d.text) else 'site ' || coalesce(d.source, chr(1)) end as site,
  unnest(string_split(d.text, chr(10))) as raw, unnest(range(len(string_split(d.text, chr(10))))) as pos from documents d left join c on c.text = d.text),
s as (select trim(raw) as line from l where trim(raw) <> '' group by 1 having count(distinct site) >= {line_dedup.MIN_SITES}),
m as (select l.*, s.line is not null as cut from l left join s on trim(l.raw) = s.line)
select doc_id, coalesce(string_agg(raw, chr(10) order by pos) filter (where not cut), '') as text, count(*) as n_lines, count(*) filter (where cut) as n_cut from m group by doc_id
""")
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs, report=True, most_cut=None).drop("source")


@family.query()
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, folder, "documents")).drop("uid")


@family.query()
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitening(table(spark, folder, "embeddings"))


@family.query(r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
  + case when 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) then 4 else 0 end
  + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
  + case when coalesce(doc_id > min(doc_id) over (partition by text), false) then 16 else 0 end as fails
  from w left join l using (doc_id)),
v as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
i as (select unnest(range(5)) as i),
o as (select chr(65 + a.i::int) || chr(65 + b.i::int) || chr(65 + c.i::int) || chr(65 + d.i::int) || chr(65 + e.i::int) as filter_order, [1 << a.i, 1 << b.i, 1 << c.i, 1 << d.i, 1 << e.i] as bits
  from i a, i b, i c, i d, i e where (1 << a.i) | (1 << b.i) | (1 << c.i) | (1 << d.i) | (1 << e.i) = 31),
s as (select filter_order, (i + 1)::int as step, bits[i + 1] as own, list_sum(bits[1:i])::bigint as before from o, i),
c as (select filter_order, step, own, coalesce(before, 0) as before from s),
r as (select part, filter_order, step, own, sum(n) filter (where fails & (own | before) = 0) as kept, sum(n) filter (where fails & own > 0 and fails & before = 0) as removed,
  sum(n) filter (where fails & own > 0 and fails & before > 0) as redundant, sum(n) filter (where fails = own) as unique_fails,
  sum(good) filter (where fails & own > 0 and fails & before = 0) as good_lost, sum(toxic) filter (where fails & own > 0 and fails & before = 0) as toxic_lost from v, c group by 1, 2, 3, 4)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, own), 0)::bigint as shapley from r
""")
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@family.query()
def op13_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.rules(table(spark, folder, "documents"), ["doc_id"])


QUERIES, ORACLES = family.queries, family.oracles
