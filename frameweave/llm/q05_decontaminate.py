"""Query op5: words of documents that benchmark items share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate
from ._io import table


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate.find(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with docs as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null),
windows as (
  select distinct item_id, least(10, len(w)) as size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as words
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)),
places as (
  select r, size, i, array_to_string(w[i : i + size - 1], ' ') as words
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, (select distinct size from windows) where len(w) >= size)),
found as (select r, p.size, i, item_id from places p join windows using (size, words)),
hit as (select r, count(distinct i + k) as n_hit from (select distinct r, i, unnest(range(0, size)) as k from found) group by r),
owners as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, cast(item_id as varchar) as id from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join owners using (r)
"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES = {"op5_decontaminate": SQL}
