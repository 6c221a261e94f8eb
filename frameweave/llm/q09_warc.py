"""Query op9: pages into WARC archives and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from ._io import shared_dir, table


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` below ``path`` and read both kinds of records: digests of payloads as read, of revisits as said."""
    spark = pages.sparkSession
    warc.write(pages, path)
    whole = warc.read(spark, path, where=F.col("warc_type") == "response")
    responses = whole.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), warc.digest(F.col("payload")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.col("refers_to"),
    )
    heads = warc.read(spark, path, ["page_id", "warc_type", "payload_bytes", "payload_digest", "refers_to"], F.col("warc_type") == "revisit")
    return responses.unionByName(heads.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select *, strlen(html) as n, sha1(html) as h, max(page_id) over (partition by sha1(html)) as top from p)
select page_id, cast(n as bigint) as payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + cast((('0x' || substr(h, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31 as integer), 1) for i in range(0, 32)], 'string_agg', '') as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id = top then null else top end as refers_to
from d
"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": SQL}
