"""Samples of tracks: presentation times, what has to be decoded to show a moment or a span, and decoding with replay.

``samples`` have ``track_id``, ``sample_idx`` (order of decoding, from 0), ``pts`` and ``duration`` (ticks), ``key``, ``size``.
Tracks are independent; within one, all is windows and equi-joins on it, and folds run once over its samples in order.
Null times sort first; a track without samples has no rows; a track without a key frame is decoded from its start.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import round_half_up

#: Samples of fewer bytes are not fed.
MIN_CHUNK_BYTES = 1
TRACK = "track_id"


def frame_times(samples: DataFrame, timescale: Column | int = 1000, edit_delay: Column | int = 0, merge_ms: float | None = None, keys_only: bool = False) -> DataFrame:
    """Frames in the order of presentation: ``place``, ``pts_ms`` (after what an edit list cuts off), ``duration_ms``,
    ``to_next`` (null for the last). ``merge_ms``: frames that the next one follows sooner than that are left out."""
    scale, edit = (c if isinstance(c, Column) else F.lit(c) for c in (timescale, edit_delay))
    w = W.partitionBy(TRACK).orderBy("pts", "sample_idx")
    ms = F.col("pts") * 1000.0 / scale - edit * 1000.0 / scale
    out = samples.select("*", (F.row_number().over(w) - 1).alias("place"), ms.alias("pts_ms"), (F.col("duration") * 1000.0 / scale).alias("duration_ms"))
    out = out.withColumn("to_next", F.lead("pts_ms").over(w) - F.col("pts_ms"))
    if merge_ms is not None:
        out = out.where(F.col("to_next").isNull() | (F.col("to_next") >= merge_ms))
    return out.where("key") if keys_only else out


def _from_key(samples: DataFrame) -> DataFrame:
    """``samples`` with ``from_key``: the last key frame that isn't after it in the order of decoding, or the first sample."""
    w = W.partitionBy(TRACK).orderBy("sample_idx").rowsBetween(W.unboundedPreceding, 0)
    return samples.withColumn("from_key", F.coalesce(F.last(F.when(F.col("key"), F.col("sample_idx")), ignorenulls=True).over(w), F.first("sample_idx").over(w)))


def seek_range(times: DataFrame, wanted: DataFrame, at: str = "want_ms") -> DataFrame:
    """For each moment in ``wanted`` (track, ``at``) the frame that is shown first from a millisecond before it on, or the last:
    ``first_sample`` (a key frame) to ``last_sample`` have to be decoded, ``warmup`` of them. One sort of the union."""
    names = [c for c in wanted.columns if c != TRACK]
    frames = _from_key(times).select(TRACK, F.col("pts_ms").alias("_t"), F.lit(1).alias("_side"), F.struct("sample_idx", "from_key", "pts_ms").alias("_f"))
    both = frames.unionByName(wanted.select(TRACK, (F.col(at) - 1.0).alias("_t"), F.lit(0).alias("_side"), F.struct(*names).alias("_row")), allowMissingColumns=True)
    order = W.partitionBy(TRACK).orderBy("_t", "_side", F.col("_f.sample_idx"))
    # the other way round: a window that reaches to the end is gone through anew for each row
    back = W.partitionBy(TRACK).orderBy(F.desc("_t"), F.desc("_side"), F.desc("_f.sample_idx"))
    later = F.last("_f", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    earlier = F.last("_f", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("_n", F.coalesce(later, earlier)).where("_side = 0 and _n is not null")
    return found.select(
        TRACK, *(F.col(f"_row.{n}").alias(n) for n in names), F.col("_n.from_key").alias("first_sample"), F.col("_n.sample_idx").alias("last_sample"),
        (F.col("_n.sample_idx") - F.col("_n.from_key") + 1).alias("warmup"), F.col("_n.pts_ms").alias("target_ms"),
    )


def pts_key(ms: Column) -> Column:
    """Times to an eighth of a millisecond, by which a decoder's pictures are found again."""
    return round_half_up(ms * 8.0) / 8.0


def decode_range(times: DataFrame, in_ms: Column | float = 0.0, out_ms: Column | float | None = None, places: list[int] | None = None) -> DataFrame:
    """What a decoder is fed so that the wanted frames come out: ``wanted`` ones lie between ``in_ms`` and ``out_ms`` (a millisecond
    of grace on either side) and, if ``places`` are given and any of them does, are those; from the key frame before the first of
    them to the last, in the order of decoding. ``rank``: a wanted frame's number in the order of presentation; ``warmup``:
    samples before the first wanted one."""
    low = F.col("pts_ms") >= (in_ms if isinstance(in_ms, Column) else F.lit(float(in_ms))) - 1
    inside = low if out_ms is None else low & (F.col("pts_ms") <= (out_ms if isinstance(out_ms, Column) else F.lit(float(out_ms))) + 1)
    marked = _from_key(times).withColumn("_in", inside)
    if places is not None:
        picked = F.col("_in") & F.col("place").isin(places)
        any_picked = F.max(picked.cast("int")).over(W.partitionBy(TRACK)) == 1
        marked = marked.withColumn("_in", F.when(any_picked, picked).otherwise(F.col("_in")))
    span = marked.where("_in").groupBy(TRACK).agg(F.min("from_key").alias("_from"), F.min("sample_idx").alias("_first"), F.max("sample_idx").alias("_last"))
    # a row for each track: Spark sees its size
    fed = marked.join(span, TRACK).where(F.col("sample_idx").between(F.col("_from"), F.col("_last")))
    rank = F.row_number().over(W.partitionBy(TRACK, "_in").orderBy("pts_ms", "sample_idx")) - 1
    return fed.select(TRACK, "sample_idx", "pts_ms", "key", F.col("_in").alias("wanted"), F.when(F.col("_in"), rank).alias("rank"), pts_key(F.col("pts_ms")).alias("pts_key"), (F.col("_first") - F.col("_from")).alias("warmup"))


def frames_from_list(frames: DataFrame, start_ms: float = 0.0, frame_ms: float = 100.0, clip: str = "clip_id") -> DataFrame:
    """Pictures that are decoded already, with ``index`` in their order and ``pts_ms``: their own, or one every ``frame_ms``."""
    place = F.row_number().over(W.partitionBy(clip).orderBy("frame_idx")) - 1
    own = F.col("pts_ms").cast("double") if "pts_ms" in frames.columns else F.lit(None).cast("double")
    return frames.withColumn("index", place).withColumn("pts_ms", F.coalesce(own, F.lit(float(start_ms)) + F.col("index") * F.lit(float(frame_ms))))


def list_facts(frames: DataFrame, clip: str = "clip_id", forced_ms: float | None = None) -> DataFrame:
    """``frames``, ``duration_ms`` (from the first picture to the last, or as given), ``fps`` of each clip."""
    spread = F.when(F.count("*") > 1, F.greatest(F.lit(1.0), F.lit(forced_ms) if forced_ms is not None else F.max("pts_ms") - F.min("pts_ms"))).otherwise(F.lit(float(forced_ms or 1000.0)))
    return frames.groupBy(clip).agg(F.count("*").alias("frames"), spread.alias("duration_ms"), (F.count("*") * 1000.0 / F.greatest(F.lit(1.0), spread)).alias("fps"))


# --- decoding with replay ---


@dataclass
class Replay:
    """A decoder's run over the samples of one track, as a fold: ``feed`` takes them in the order of decoding and returns the
    pictures that are due, ``finish`` the rest, each once and in the order of presentation within a window.

    A sample that fails resets the decoder: all is fed anew from the last key frame, without the samples that failed,
    ``most_replays`` times; after that, what follows up to the next key frame is passed over. Pictures that came out already
    wait on for their turn. Empty samples are skipped. ``stats`` counts what happened. The state is small: the samples since
    the last key frame, and as many pictures as the window has.
    """

    window: int = 4
    most_replays: int = 4
    since_key: list[tuple[int, int]] = field(default_factory=list)
    waiting: list[tuple[int, int]] = field(default_factory=list)  # a heap
    held: set[int] = field(default_factory=set)  # the samples in it
    delivered: set[int] = field(default_factory=set)
    skipped: set[int] = field(default_factory=set)
    blind: bool = False
    stats: dict[str, int] = field(default_factory=lambda: {"fed": 0, "delivered": 0, "replays": 0, "failed": 0, "empty": 0, "lost": 0})

    def feed(self, sample: int, pts: int, key: bool, size: int, ok: bool) -> list[tuple[int, int]]:
        if size < MIN_CHUNK_BYTES:
            self.stats["empty"] += 1
            return []
        if key:
            self.blind = False
            self.delivered.clear()  # no replay reaches behind a key frame
            self.since_key = []
        if self.blind:
            self.stats["lost"] += 1
            return []
        if ok:
            self.since_key.append((sample, pts))
            return self._decoded(sample, pts)
        self.stats["failed"] += 1
        self.stats["fed"] += 1
        self.skipped.add(sample)
        if self.stats["replays"] < self.most_replays and self.since_key:
            self.stats["replays"] += 1
            return [p for s, t in self.since_key for p in self._decoded(s, t)]
        self.blind = True
        return []

    def _decoded(self, sample: int, pts: int) -> list[tuple[int, int]]:
        self.stats["fed"] += 1
        if sample in self.delivered or sample in self.held:
            return []
        heapq.heappush(self.waiting, (pts, sample))
        self.held.add(sample)
        return self._due(max(2, self.window))

    def _due(self, most: int) -> list[tuple[int, int]]:
        out = []
        while len(self.waiting) > most:
            first = heapq.heappop(self.waiting)
            self.held.discard(first[1])
            self.delivered.add(first[1])
            self.stats["delivered"] += 1
            out.append((first[1], first[0]))
        return out

    def finish(self) -> list[tuple[int, int]]:
        return self._due(0)


DELIVERED = "sample_idx bigint, pts bigint, out_idx bigint"
FED = ("sample_idx", "pts", "key", "size", "ok")
#: Samples that a fold takes as Python values at once.
SLICE = 1 << 16


def _run(table: pa.Table, window: int, most_replays: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """``Replay`` over one track's samples: numbers and times of the pictures in their order, and what is counted.

    What is fed, fails or is passed over follows from counts since the last key frame, so columns do; a replay brings nothing
    new, since what it feeds waits already or is delivered. Samples whose number repeats, or that lack one, are folded."""
    sample, pts, size = (table.column(c) for c in ("sample_idx", "pts", "size"))
    number = sample.to_numpy() if not sample.null_count else None
    if number is not None and (np.diff(number) < 0).any():
        table = table.take(pa.array(np.argsort(number, kind="stable")))
        sample, pts, size = (table.column(c) for c in ("sample_idx", "pts", "size"))
        number = sample.to_numpy()
    if number is None or pts.null_count or size.null_count or (np.diff(number) == 0).any():
        fold, got = Replay(window, most_replays), []
        for x in (table if number is not None else table.sort_by("sample_idx")).to_pylist():
            got += fold.feed(*(x[c] for c in FED))
        got += fold.finish()
        return np.array([s for s, _ in got], dtype=np.int64), np.array([p for _, p in got], dtype=np.int64), fold.stats
    fed = size.to_numpy() >= MIN_CHUNK_BYTES
    number, pts = number[fed], pts.to_numpy()[fed]
    key, ok = (table.column(c).fill_null(False).to_numpy()[fed] for c in ("key", "ok"))
    n = len(number)
    stats = {name: 0 for name in Replay().stats} | {"empty": len(fed) - n}
    if not n:
        return number, pts, stats
    starts = np.union1d([0], np.flatnonzero(key))
    part = np.searchsorted(starts, np.arange(n), "right") - 1  # from a key frame to the next
    before = np.cumsum(ok) - ok
    since = before - before[starts][part]  # of them, what decoded since the key frame
    failed = np.flatnonzero(~ok)
    failed = failed[since[failed] > 0]
    failed = failed[ok[starts[part[failed]]]]  # a part whose first sample fails is passed over
    most = max(0, most_replays)
    blind = np.where(ok[starts], n, starts)
    np.minimum.at(blind, part[failed[most:]], failed[most:])
    lost = np.arange(n) > blind[part]
    out = ok & ~lost
    bad = int((~ok & ~lost).sum())
    replays = failed[:most]
    stats |= {"fed": int(out.sum()) + bad + int(since[replays].sum()), "delivered": int(out.sum()), "replays": len(replays), "failed": bad, "lost": int(lost.sum())}
    number, pts = number[out], pts[out]
    if len(number) <= max(2, window):  # all wait up to the end
        order = np.lexsort((number, pts))
        return number[order], pts[order], stats
    waiting, places, times = [], array("q"), array("q")
    for at in range(0, len(number), SLICE):
        for x in zip(pts[at : at + SLICE].tolist(), number[at : at + SLICE].tolist(), strict=True):
            if len(waiting) < max(2, window):
                heapq.heappush(waiting, x)
                continue
            t, s = heapq.heappushpop(waiting, x)
            times.append(t)
            places.append(s)
    for t, s in sorted(waiting):
        times.append(t)
        places.append(s)
    return np.frombuffer(places, dtype=np.int64), np.frombuffer(times, dtype=np.int64), stats


def decode(samples: DataFrame, window: int = 4, most_replays: int = 4) -> DataFrame:
    """Pictures in the order in which a decoder with replay delivers them (``out_idx``); ``ok`` tells which samples decode."""
    kind = samples.schema[TRACK].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        places, times, _ = _run(table, window, most_replays)
        key = pa.repeat(table.column(TRACK)[0], len(places))
        return pa.table([key, *(pa.array(x).cast(pa.int64()) for x in (places, times)), pa.array(np.arange(len(places)))], names=[TRACK, "sample_idx", "pts", "out_idx"])

    return samples.select(TRACK, *FED).groupBy(TRACK).applyInArrow(run, f"{TRACK} {kind}, {DELIVERED}")


def decode_stats(samples: DataFrame, window: int = 4, most_replays: int = 4) -> DataFrame:
    """What happened in each track's run, as counts."""
    kind = samples.schema[TRACK].dataType.simpleString()
    names = list(Replay().stats)

    def run(table: pa.Table) -> pa.Table:
        stats = _run(table, window, most_replays)[2]
        return pa.table([pa.repeat(table.column(TRACK)[0], 1), *(pa.array([stats[n]], type=pa.int64()) for n in names)], names=[TRACK, *names])

    return samples.select(TRACK, *FED).groupBy(TRACK).applyInArrow(run, f"{TRACK} {kind}, " + ", ".join(f"{n} bigint" for n in names))


def video_plans(files: DataFrame, data: str = "content", key: str = "path") -> DataFrame:
    """What each file's first video track is decoded by: container, codec, size, times of its frames, whether it can be sought in,
    or why there is no plan (``no-video-track``, ``encrypted``, ``corrupt``)."""
    from ..sources import demux, probe
    from ..sources.columns import one_at_a_time

    kind = files.schema[key].dataType.simpleString()

    def plan(raw: bytes) -> dict:
        fmt = probe.sniff(raw)[0]
        try:
            if fmt in ("webm", "mkv"):
                w = demux.parse_webm(raw)
                track = next((t for t in w["tracks"] if t["kind"] == "video"), None)
                if track is None:
                    return {"error": "no-video-track"}
                own = np.isin(w["blocks"].array("track"), (0, track["number"]))
                times, keys = (w["blocks"].array(c)[own] for c in ("pts_ms", "key"))
                return {"format": fmt, "codec": demux.webm_decoder_config(track)["codec"], "width": track["width"], "height": track["height"], "times": np.sort(times), "keys": int(keys.sum()), "seekable": bool(w["seek"]), "warning": None}
            if fmt == "avi":
                a = demux.parse_avi(raw)
                fps = a["fps"] or 10.0
                return {"format": fmt, "codec": a["codec"], "width": a["width"], "height": a["height"], "times": [i * 1000 / fps for i in range(len(a["frames"]))], "keys": sum(k for *_, k in a["frames"]), "seekable": True, "warning": "truncated" if a["partial"] else None}
            m = {"tracks": [demux.annex_b_track(raw)], "encrypted": False, "partial": False} if fmt == "h264-annexb" else demux.parse_mp4(raw)
            track = next((t for t in m["tracks"] if t["kind"] == "video"), None)
            if m["encrypted"]:
                return {"error": "encrypted"}
            if track is None:
                return {"error": "no-video-track"}
            own = track["samples"]  # all have a place
            times = np.sort((own.array("pts") - track["edit_delay"]) * 1000 / max(1, track["timescale"]))
            return {"format": fmt, "codec": track["codec"], "width": track["width"], "height": track["height"], "times": times, "keys": int(own.array("key").sum()), "seekable": True, "warning": "truncated" if m["partial"] else None}
        except (demux.DemuxError, struct.error, ValueError, IndexError, TypeError, OverflowError) as e:
            return {"error": f"corrupt: {e}"}

    kinds = {"format": pa.string(), "codec": pa.string(), "width": pa.int32(), "height": pa.int32(), "times": pa.list_(pa.float64()), "keys": pa.int32(), "seekable": pa.bool_(), "warning": pa.string(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, raw in demux.contents(batches, data, key):
            made = plan(raw)
            del raw
            yield pa.RecordBatch.from_arrays([pa.repeat(k, 1), *(pa.array([made.get(n)], type=t) for n, t in kinds.items())], names=[key, *kinds])

    schema = "format string, codec string, width int, height int, times array<double>, keys int, seekable boolean, warning string, error string"
    one_at_a_time(files.sparkSession)
    return files.select(key, data).mapInArrow(run, f"{key} {kind}, {schema}")
