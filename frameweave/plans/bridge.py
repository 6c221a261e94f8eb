"""Views of the relational tables as clips, pixels, palettes, index streams and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the frames that ``pixels`` makes.
SIDE = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``px``: 256 events are a frame of 16 x 16 pixels; the last one is partial. A click is transparent."""
    e = table(spark, sf_dir, "events")
    within = F.col("event_id") % 256
    return e.select(
        F.expr("event_id div 256").alias("frame_idx"),
        (within % SIDE).cast("int").alias("x"),
        F.floor(within / SIDE).cast("int").alias("y"),
        (F.col("user_id") % 16).cast("int").alias("idx"),
        ((F.col("user_id") * 37) % 256).cast("int").alias("r"),
        (F.floor("value").cast("bigint") % 256).cast("int").alias("g"),
        (F.length("event_type") * 29 % 256).cast("int").alias("b"),
        F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 128).otherwise(255).alias("a"),
    )


#: The same view in DuckDB's dialect, as a common table expression.
PX_SQL = """px as (
  select event_id // 256 as frame_idx, cast((event_id % 256) % 16 as integer) as x, cast((event_id % 256) // 16 as integer) as y,
         cast(user_id % 16 as integer) as idx, cast((user_id * 37) % 256 as integer) as r,
         cast(cast(floor(value) as bigint) % 256 as integer) as g, cast(length(event_type) * 29 % 256 as integer) as b,
         case when event_type = 'click' then 0 when event_type = 'view' then 128 else 255 end as a
  from events)"""


def palette(spark: SparkSession) -> DataFrame:
    """A palette of 16 colours, by rule."""
    i = F.col("id").cast("int")
    return spark.range(16).select(i.alias("idx"), (i * 17 % 256).alias("pr"), ((i * 41 + 5) % 256).alias("pg"), ((i * 97 + 13) % 256).alias("pb"))


PALETTE_SQL = """pal as (
  select cast(i as integer) as idx, cast(i * 17 % 256 as integer) as pr, cast((i * 41 + 5) % 256 as integer) as pg, cast((i * 97 + 13) % 256 as integer) as pb
  from range(16) t(i))"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each user: frames in order of time, milliseconds since the first."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"), "event_id")
    w = Window.partitionBy("clip_id")
    return e.select(
        "clip_id",
        (F.row_number().over(w.orderBy("ms", "event_id")) - 1).alias("frame_idx"),
        (F.col("ms") - F.min("ms").over(w)).alias("pts_ms"),
    )


TIMELINE_SQL = """tl as (
  select user_id as clip_id, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) - 1 as frame_idx,
         epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) over (partition by user_id) as pts_ms
  from events)"""


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index stream for each document: the low four bits of its UTF-8 bytes, whole."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.encode("text", "UTF-8").alias("bytes"))
    code = F.conv(F.hex(F.substring(F.col("bytes"), F.col("pos") + 1, F.lit(1))), 16, 10).cast("int")
    return d.select("clip_id", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - 1)).alias("pos")).select("clip_id", "pos", code.bitwiseAND(15).alias("idx"))
