"""Queries over streams: the events as they lie in their files, through keyed state, to a written table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _values(s, d):
    """Every event is a frame of its user's clip, valued by its event."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    events = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return events.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("pts"), F.col("value").cast("double").alias("value"))


_FOLD = "with v as (select user_id as clip_id, event_id as pts, value from events)"
QUERIES["stream_running_mean"] = lambda s, d: state.drain(state.running_mean(_values(s, d), 0.35)).withColumn("value", F.round("value", 6))
ORACLES["stream_running_mean"] = f"{_FOLD} select clip_id, pts, round(list_reduce(list(value) over (partition by clip_id order by pts rows between unbounded preceding and current row), lambda m, x: m + (x - m) * 0.35e0), 6) as value from v"
QUERIES["stream_trails"] = lambda s, d: state.drain(state.trails(_values(s, d), 2, 0.5)).withColumn("value", F.round("value", 6))
ORACLES["stream_trails"] = f"{_FOLD} select clip_id, pts, round(greatest(value, coalesce(lag(value) over w * 0.5e0, value), coalesce(lag(value, 2) over w * 0.25e0, value)), 6) as value from v window w as (partition by clip_id order by pts)"
QUERIES["stream_stabilizer"] = lambda s, d: state.drain(state.stabilizer(_values(s, d).withColumn("value", (F.col("pts") % 7 - 3).cast("double")))).withColumn("value", F.round("value", 6))
ORACLES["stream_stabilizer"] = """with m as (select user_id as clip_id, event_id as pts, sum(event_id % 7 - 3) over (partition by user_id order by event_id) * 1e0 as moved from events)
select clip_id, pts, round(moved - list_reduce(list_prepend(0e0, list(moved) over (partition by clip_id order by pts rows between unbounded preceding and current row)), lambda c, x: c * 0.65e0 + x * (1 - 0.65e0)), 6) as value from m"""
