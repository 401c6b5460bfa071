"""Queries over the given tables for mining, audits of filters and packing, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import filter_audit, hard_negatives, packing
from tidegrid.llm.common import table

WORDS = public_tokenizers.path("word_bpe_49k.json")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 50 == 0)


OP11_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double)::bigint for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_sum([a.v[i] * b.v[i] for i in range(1, len(a.v) + 1)])::bigint as s
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
  select * from s where same qualify row_number() over (partition by a order by s desc, b) <= 5
), n as (
  select p.a, p.b as p, p.s as ps, s.b as n, s.s as ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) as rank
  from p join s on s.a = p.a and not s.same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s
)
select a as anchor_id, p as positive_id, rank::integer as rank, n as negative_id, ps as positive_score, ns as negative_score from n where rank <= 3
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31
), st as (
  select filter_order, k as step, bits[k] as bit, coalesce(list_sum(bits[:k - 1]), 0)::integer as before from o, (select unnest([1, 2, 3, 4, 5]) as k)
), d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         min(doc_id) over (partition by coalesce(text, '')) as first
  from documents
), l as (
  select doc_id, max((quality = 1)::integer) as good, max((toxic = 1)::integer) as toxic from labels where doc_id is not null group by doc_id
), m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         (len(w) < 100)::integer + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::integer
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::integer
         + 8 * regexp_matches(t, '[#$%&*|]')::integer + 16 * coalesce(doc_id > first, false)::integer as mask
  from d left join l using (doc_id)
), r as (
  select part, filter_order, step, st.bit,
         count(*) filter (where mask & (before | bit) = 0) as kept,
         count(*) filter (where mask & before = 0 and mask & bit <> 0) as removed,
         count(*) filter (where mask & before <> 0 and mask & bit <> 0) as redundant,
         count(*) filter (where mask = bit) as unique_fails,
         coalesce(sum(good) filter (where mask & before = 0 and mask & bit <> 0), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (where mask & before = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
  from m, st group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) over (partition by part, bit)::bigint as shapley
from r
"""


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS)


QUERIES = {"op11_hard_negatives": op11_hard_negatives, "op12_filter_audit": op12_filter_audit, "op13_best_fit_packing": op13_best_fit_packing}
ORACLE = {"op11_hard_negatives": OP11_SQL, "op12_filter_audit": OP12_SQL}
