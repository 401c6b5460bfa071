"""Queries over the given tables for the operators that use DataFrame functions alone, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontamination, quality_rules, secret_scans, warc
from tidegrid.llm.common import table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(led).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


OP9_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), m as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines
  from d
), g as (
  select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as g from d, unnest(range(1, len(w) - 1)) as r(i)
), rep as (
  select doc_id, count(distinct i + k)::bigint as n
  from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g), (values (0), (1), (2)) as v(k)
  where c > 1 group by doc_id
), a as (
  select m.*, coalesce(n, 0)::bigint as n_repeat_words from m left join rep using (doc_id)
), b as (
  select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 2 * n_symbols > n_words then 4 else 0 end + case when 2 * n_dup_lines > n_lines and n_lines > 1 then 8 else 0 end
    + case when word_chars < 2 * n_words then 16 else 0 end + case when word_chars > 20 * n_words then 32 else 0 end)::bigint as fail_bits
  from a
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed,
       fail_bits = 0 as kept, fail_bits
from b
"""


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan_paths(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def _secrets_sql() -> str:
    """Each rule's gaps and matches in turn, their lengths summed up."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = " union all ".join(
        f"select doc_id, {k} as k, {quoted(r.kind)} as kind, {r.least} as least, regexp_split_to_array(t, {p}) as gaps, regexp_extract_all(t, {p}) as hits, "
        f"regexp_extract_all(t, {p}, {r.group}) as shown from d" for k, r in enumerate(secret_scans.RULES) for p in (quoted(r.pattern),)
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), x as ({each}),
l as (select doc_id, k, kind, least, unnest(range(1, len(hits) + 1)) as i, unnest(gaps[1:len(hits)]) as gap, unnest(hits) as hit, unnest(shown) as shown from x),
e as (select *, sum(length(gap) + length(hit)) over (partition by doc_id, k order by i) as e from l),
s as (select doc_id, k, kind, e - length(hit) as s, e from e where length(shown) >= least),
g as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (where k < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans
      from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)
"""


QUERIES = {"op9_quality_rules": op9_quality_rules, "op10_secret_scans": op10_secret_scans}
ORACLE = {"op9_quality_rules": OP9_SQL, "op10_secret_scans": _secrets_sql()}


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "intact"
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES |= {"op1_warc": op1_warc, "op5_decontamination": op5_decontamination}
