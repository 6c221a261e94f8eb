"""Query op2: components of documents whose word 4-grams are alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import nearjoin
from ._io import table


def joined(docs: DataFrame) -> DataFrame:
    return nearjoin.join(docs.select("doc_id", "text"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")


def op2_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b using (s) where a.doc_id < b.doc_id group by all),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
arrows as (select a, b from links union all select b, a from links),
reach as (
  select doc_id, doc_id as to_id from sizes
  union
  select r.doc_id, b from reach r join arrows on a = to_id),
lowest as (select doc_id, min(to_id) as component_id from reach group by doc_id)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id
from words left join sizes using (doc_id) left join lowest using (doc_id)
"""

QUERIES = {"op2_nearjoin": op2_nearjoin}
ORACLES = {"op2_nearjoin": SQL}
