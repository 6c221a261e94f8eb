"""Timelines, schedules, differences between frames, compositing and transitions.

Frames of a clip are compared by windows over (clip, pixel, stretch of frames) ordered by frame; a stretch has ``STRETCH``
frames, and with them those of its neighbours that a comparison reaches. So a long clip is many partitions, whatever its frames'
size, and any number of clips runs in parallel. Nearest-time joins are equi-joins on the clip with the candidates found by
windows over the union of both sides. Folds that have no end (means over all frames so far) run over groups of places.
"The frame before" is the one whose number is one less; a place without a pixel there is compared with nothing. Null pixels and
empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.numeric import byte, clamp, round_half_up


def slots(clips: DataFrame, fps: float, clip: str = "clip_id") -> DataFrame:
    """Output slots of each clip (``start_ms``, ``end_ms``): ``slot``, ``pts_ms``, ``duration_ms``."""
    rate = max(1.0, min(70.0, fps))
    span = F.col("end_ms") - F.col("start_ms")
    count = F.greatest(F.lit(1), round_half_up(span / 1000.0 * rate))
    out = clips.withColumn("_n", count).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("_n") - 1).cast("bigint"))))
    step = span / F.col("_n")
    return out.select(clip, "slot", (F.col("start_ms") + step * F.col("slot")).alias("pts_ms"), step.alias("duration_ms"), (F.col("start_ms") + step * (F.col("slot") + 0.5)).alias("centre"))


def nearest_time(left: DataFrame, right: DataFrame, at: str, time: str, value: str, key: str = "clip_id") -> DataFrame:
    """As-of join: ``left`` with the ``value`` of the row of ``right`` whose ``time`` is nearest to ``at``, the earlier of equal ones
    (and of equal times the smallest value). One sort of the union by key and time; nothing is paired."""
    names = [c for c in left.columns if c != key]
    times = right.groupBy(key, F.col(time).cast("double").alias("_t")).agg(F.min(value).alias("_v"))
    both = left.select(key, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast("struct<t:double,v:bigint>").alias("_s")).unionByName(
        times.select(key, "_t", F.lit(0).alias("_side"), F.struct(F.col("_t").alias("t"), F.col("_v").cast("bigint").alias("v")).alias("_s")), allowMissingColumns=True
    )
    up = W.partitionBy(key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(key).orderBy(F.desc("_t"), "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.select("*", F.last("_s", ignorenulls=True).over(up).alias("_a"), F.last("_s", ignorenulls=True).over(down).alias("_b")).where("_side = 1")
    later = F.col("_a").isNull() | (F.abs(F.col("_b.t") - F.col("_t")) < F.abs(F.col("_a.t") - F.col("_t")))
    return found.select(key, "_row.*", F.when(later, F.col("_b.v")).otherwise(F.coalesce("_a.v", "_b.v")).alias(value))


def plan_frame_rate(frames: DataFrame, fps: float, skip_duplicates: bool = False, clip: str = "clip_id", time: str = "pts_ms", frame: str = "frame_idx") -> DataFrame:
    """Schedule of each clip: ``slot``, ``src_frame_idx`` (nearest start to the slot's centre), ``pts_ms``, ``duration_ms``, ``duplicate``."""
    clips = frames.groupBy(clip).agg(F.min(time).cast("double").alias("start_ms"), F.max(time).cast("double").alias("end_ms"))
    got = nearest_time(slots(clips, fps, clip), frames.select(clip, time, F.col(frame).cast("bigint").alias("src_frame_idx")), "centre", time, "src_frame_idx", clip)
    same = F.lag("src_frame_idx").over(W.partitionBy(clip).orderBy("slot")) == F.col("src_frame_idx")
    out = got.select(clip, "slot", "src_frame_idx", "pts_ms", "duration_ms", F.coalesce(same, F.lit(False)).alias("duplicate"))
    return out.where("not duplicate") if skip_duplicates else out


def thin(schedule: DataFrame, most: int, clip: str = "clip_id") -> DataFrame:
    """At most ``most`` distinct source frames of each clip, spread evenly over its slots."""
    w = W.partitionBy(clip)
    ranked = schedule.select(clip, "src_frame_idx", (F.row_number().over(w.orderBy("slot")) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    kth = F.expr(f"(_i * {int(most)} + _n - 1) div _n")  # slot floor(k * n / most) is taken for each k below most
    chosen = F.when(F.col("_n") <= most, F.lit(True)).otherwise((kth < most) & (F.floor(kth * F.col("_n") / float(most)) == F.col("_i")))
    return ranked.where(chosen).select(clip, "src_frame_idx").distinct()


def boomerang(count: Column, hold: int = 0, twice: bool = False) -> Column:
    """Array of frame numbers forth and back, held at both ends."""
    n = count.cast("int")
    back = F.when(n >= 2, F.sequence(n - 2, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    once = F.concat(F.sequence(F.lit(0), n - 1), F.array_repeat(n - 1, F.lit(hold)), back, F.array_repeat(F.lit(0), F.lit(hold)))
    once = F.when(n > 0, once).otherwise(F.array().cast("array<int>"))
    return F.concat(once, once) if twice else once


def speed(count: Column, rate: float) -> Column:
    """Array of frame numbers at ``rate`` times the speed: every so manieth, or each repeated."""
    if rate <= 0:
        raise ValueError("the rate must be positive")
    every = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    if rate >= 1:
        return F.filter(every, lambda i: i % max(1, math.floor(rate + 0.5)) == 0)
    return F.flatten(F.transform(every, lambda i: F.array_repeat(i, F.lit(max(1, math.floor(1 / rate + 0.5))))))


def fade_envelope(index: Column, count: Column, fade_in: float = 0.1, fade_out: float = 0.1) -> Column:
    one = F.lit(1.0)
    rise = index / F.greatest(one, count * F.lit(fade_in))
    fall = (count - 1 - index) / F.greatest(one, count * F.lit(fade_out))
    return F.least(clamp(rise, 0.0, 1.0), clamp(fall, 0.0, 1.0))


# --- differences ---


#: Frames of a stretch.
STRETCH = 64


def beside(px: DataFrame, shifts: dict[str, tuple[str, int]], clip: tuple[str, ...] = ()) -> DataFrame:
    """``px`` with new columns: ``shifts`` maps a name to a channel and how many frames before (or, negative, after) it is
    taken from; null where the place has no pixel in that very frame. Pixels are exchanged once."""
    back, ahead = max(0, *(n for _, n in shifts.values())), max(0, *(-n for _, n in shifts.values()))
    frame, own = F.col("frame_idx"), F.floor(F.col("frame_idx") / STRETCH)
    reached = F.sequence(F.floor((frame - ahead) / STRETCH), F.floor((frame + back) / STRETCH))
    dealt = px.withColumn("_s", F.explode(reached)).withColumn("_own", F.col("_s") == own)
    w = W.partitionBy(*clip, "x", "y", "_s").orderBy("frame_idx")

    def taken(c: str, n: int) -> Column:
        # places may lack pixels in some frames: so many rows away is that frame or one farther off
        near = F.collect_list(F.struct("frame_idx", F.col(c).alias("v"))).over(w.rowsBetween(-n, -1) if n > 0 else w.rowsBetween(1, -n))
        return F.get(F.filter(near, lambda r: r["frame_idx"] == frame - n), F.lit(0))["v"]

    def shifted(c: str, n: int) -> Column:
        if abs(n) != 1:
            return taken(c, n)
        return F.when(F.lag("frame_idx", n).over(w) == frame - n, F.lag(c, n).over(w))

    return dealt.withColumns({name: shifted(c, n) for name, (c, n) in shifts.items()}).where("_own").drop("_s", "_own")


def with_previous(px: DataFrame, channels: str = "rgba", clip: tuple[str, ...] = ()) -> DataFrame:
    """``px`` with ``p_r`` ... of the same place in the frame before, or null."""
    return beside(px, {f"p_{c}": (c, 1) for c in channels if c in px.columns}, clip)


def delta(alpha: bool = True) -> Column:
    """Largest change of a channel; a change of alpha counts a quarter."""
    moved = [F.abs(F.col(c) - F.col(f"p_{c}")) for c in "rgb"]
    return F.greatest(*moved, F.shiftright(F.abs(F.col("a") - F.col("p_a")), 2)) if alpha else F.greatest(*moved)


def frame_diff(px: DataFrame, ignore: int = 2, clip: tuple[str, ...] = ()) -> DataFrame:
    d = with_previous(px, clip=clip).where("p_r is not null").withColumn("d", delta())
    mean, share = F.avg("d"), F.avg((F.col("d") > ignore).cast("int"))
    return d.groupBy(*clip, "frame_idx").agg(
        F.round(mean, 6).alias("mean"), F.max("d").alias("max"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 6).alias("rms"), F.round(share, 6).alias("changed"),
        F.round(F.least(F.lit(1.0), mean / 40 * 0.65 + share * 0.6), 6).alias("score"), F.count("*").alias("pixels"),
    )


def mean_abs_diff(px: DataFrame, sample: int = 4, clip: tuple[str, ...] = ()) -> DataFrame:
    d = with_previous(px.where((F.col("x") % sample == 0) & (F.col("y") % sample == 0)), clip=clip).where("p_r is not null")
    return d.groupBy(*clip, "frame_idx").agg(F.round(F.avg(sum(F.abs(F.col(c) - F.col(f"p_{c}")) for c in "rgb") / 3.0), 6).alias("mad"))


def dirty_rect(px: DataFrame, threshold: int = 0, padding: int = 0, align: int = 1, width: int | None = None, height: int | None = None, clip: tuple[str, ...] = ()) -> DataFrame:
    """Bounding box of what differs from the frame before: ``x0``, ``y0``, ``w``, ``h``, ``changed``."""
    d = with_previous(px, clip=clip).where("p_r is not null").where(delta() > threshold)
    box = d.groupBy(*clip, "frame_idx").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("changed"))
    if padding or align > 1:
        low = {c: F.floor(F.greatest(F.col(c) - padding, F.lit(0)) / align) * align for c in ("x0", "y0")}
        high = {c: F.least(F.ceil((F.col(c) + padding + 1) / align) * align, F.lit(n)) - 1 for c, n in (("x1", width), ("y1", height))}
        box = box.withColumns({k: v.cast("int") for k, v in (low | high).items()})
    return box.select(*clip, "frame_idx", "x0", "y0", (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"), "changed")


def change_fraction(px: DataFrame, width: int, height: int, clip: tuple[str, ...] = ()) -> DataFrame:
    return dirty_rect(px, clip=clip).select(*clip, "frame_idx", F.round(F.col("w") * F.col("h") / float(width * height), 6).alias("fraction"))


def composite(ipx: DataFrame, clip: tuple[str, ...] = ()) -> DataFrame:
    """Index planes whose transparent (null) pixels show what was there before; frames that keep what they cover.

    What a stretch of frames begins with at a place is what the stretches before it left there, of which there is a row each."""
    dealt = ipx.withColumn("_s", F.floor(F.col("frame_idx") / STRETCH))
    place = [*clip, "x", "y"]
    inside = F.last("idx", ignorenulls=True).over(W.partitionBy(*place, "_s").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0))
    ends = dealt.where("idx is not null").groupBy(*place, "_s").agg(F.max_by("idx", "frame_idx").alias("_e"))
    # an end holds from the next stretch on, up to the one that has an end again
    following = F.coalesce(F.lead("_s").over(W.partitionBy(*place).orderBy("_s")), F.lit(1 << 62))
    spans = ends.select(*place, "_e", (F.col("_s") + 1).alias("_from"), following.alias("_to"))
    last = ipx.groupBy(*clip).agg(F.max(F.floor(F.col("frame_idx") / STRETCH)).alias("_last"))  # without clips, one row
    opened = (spans.join(last, list(clip)) if clip else spans.crossJoin(last)).where("_from <= least(_to, _last)").select(*place, "_e", F.explode(F.sequence("_from", F.least("_to", "_last"))).alias("_s"))
    found = dealt.withColumn("idx", inside).join(opened, [*place, "_s"], "left")
    return found.withColumn("idx", F.coalesce("idx", "_e")).select(*ipx.columns)


def composite_dirty_rect(ipx: DataFrame, clip: tuple[str, ...] = ()) -> DataFrame:
    """Rectangle that a frame changes after compositing; a frame that changes nothing has no row, nor has a clip's first."""
    shown = beside(composite(ipx, clip), {"_p": ("idx", 1), "_f": ("frame_idx", 1)}, clip)
    changed = shown.where("_f is not null").where(~F.col("idx").eqNullSafe(F.col("_p")))
    return changed.groupBy(*clip, "frame_idx").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")
    )


def union_rect(a: Column, b: Column) -> Column:
    """Smallest rectangle (struct x, y, width, height) over both."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right, low = F.greatest(a["x"] + a["width"], b["x"] + b["width"]), F.greatest(a["y"] + a["height"], b["y"] + b["height"])
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (low - y).alias("height"))


def contains(a: Column, b: Column) -> Column:
    return (b["x"] >= a["x"]) & (b["y"] >= a["y"]) & (b["x"] + b["width"] <= a["x"] + a["width"]) & (b["y"] + b["height"] <= a["y"] + a["height"])


def collapse_duplicates(frames: DataFrame, signature: str, delay: str, clip: tuple[str, ...] = ()) -> DataFrame:
    """Runs of equal frames become their first, with the delays' sum."""
    w = W.partitionBy(*clip, F.lit(0)).orderBy("frame_idx")
    opens = (~F.col(signature).eqNullSafe(F.lag(signature).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = frames.withColumn("_o", opens).withColumn("run", F.sum("_o").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*clip, "run").agg(F.min("frame_idx").alias("frame_idx"), F.count("*").alias("merged"), F.sum(delay).alias(delay)).drop("run")


def quantize_delays(frames: DataFrame, delay: str = "delay_cs", least: int = 2, clip: str = "clip_id", total: str | None = None) -> DataFrame:
    """Whole centiseconds (``delay_q``) whose sum so far follows the true one: a frame gets what the true sum, rounded, is ahead
    of what was handed out, and ``least`` at least; what a frame got too much the next ones get less.

    What is handed out up to the i-th frame is ``least * i`` plus the largest lead of the true sum over ``least * j`` so far,
    so one window does. ``total``: a column with the clip's wanted sum; what is missing or too much is spread over the longest
    frames, one each, round by round, six times at most, and what is left goes to the last frame. Null and negative delays are 0.
    """
    order = W.partitionBy(clip).orderBy("frame_idx")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    true = round_half_up(F.sum(F.greatest(F.coalesce(F.col(delay).cast("double"), F.lit(0.0)), F.lit(0.0))).over(upto))
    place = F.row_number().over(order)
    timed = frames.withColumns({"_t": true, "_i": place})
    given = F.col("_i") * least + F.greatest(F.lit(0), F.max(F.col("_t") - F.col("_i") * least).over(upto))
    handed = timed.withColumn("_s", given.cast("bigint"))
    out = handed.withColumn("delay_q", (F.col("_s") - F.coalesce(F.lag("_s").over(order), F.lit(0))).cast("int")).drop("_t", "_s")
    if total is None:
        return out.drop("_i")
    every = W.partitionBy(clip)
    rank = F.row_number().over(every.orderBy(F.desc("delay_q"), "_i")) - 1
    apart = out.withColumns({"_n": F.count("*").over(every), "_rank": rank, "_drift": (round_half_up(F.col(total)) - F.sum("delay_q").over(every)).cast("bigint")})
    # rounds that every frame (more) or every frame above the floor (fewer) takes part in; the longest ones come first
    room = F.col("delay_q") - least
    # what rounds 0 to r take together, for each of the six
    taken = [F.sum(F.least(F.greatest(room, F.lit(0)), F.lit(r + 1))).over(every) for r in range(6)]
    left = -F.col("_drift")
    whole = sum((F.when(t <= left, 1).otherwise(0) for t in taken), F.lit(0))
    apart = apart.withColumns({"_whole": whole, **{f"_k{r}": t for r, t in enumerate(taken)}})
    before = F.when(F.col("_whole") == 0, F.lit(0))
    for r in range(6):
        before = before.when(F.col("_whole") == r + 1, F.col(f"_k{r}"))
    fewer = F.least(F.greatest(room, F.lit(0)), F.col("_whole")) + F.when((F.col("_whole") < 6) & (room > F.col("_whole")) & (F.col("_rank") < left - before), 1).otherwise(0)
    shares = F.least(F.floor(F.col("_drift") / F.col("_n")), F.lit(6))
    more = shares + F.when((shares < 6) & (F.col("_rank") < F.col("_drift") - shares * F.col("_n")), 1).otherwise(0)
    spread = apart.withColumn("delay_q", F.when(F.col("_drift") >= 0, F.col("delay_q") + more).otherwise(F.col("delay_q") - fewer).cast("int"))
    rest = round_half_up(F.col(total)) - F.sum("delay_q").over(every)
    last = F.when(F.col("_i") == F.col("_n"), F.greatest(F.lit(least), F.col("delay_q") + rest)).otherwise(F.col("delay_q"))
    return spread.withColumn("delay_q", last.cast("int")).drop("_i", "_n", "_rank", "_drift", "_whole", *(f"_k{r}" for r in range(6)))


def normalize_delay(cs: Column, least: int = 2, zero: int = 10) -> Column:
    v = round_half_up(clamp(cs, least, 65535)).cast("int")
    return F.when(cs.isNull() | F.isnan(cs.cast("double")) | (cs <= 0), zero if least > 0 else 0).otherwise(v)


def estimate_motion(px: DataFrame, width: int, height: int, reach: int = 2, clip: tuple[str, ...] = ()) -> DataFrame:
    """Shift (dx, dy) by which the frame before fits best, by the mean squared difference of luma."""
    from ..functions.numeric import luma709

    y = px.select(*clip, "frame_idx", "x", "y", luma709(F.col("r"), F.col("g"), F.col("b")).alias("l"))
    inner = F.col("x").between(reach, width - 1 - reach) & F.col("y").between(reach, height - 1 - reach)
    shifts = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1))))
    sent = y.where(inner).withColumn("s", shifts).select(*clip, (F.col("frame_idx") + 1).alias("frame_idx"), (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "s.dx", "s.dy", F.col("l").alias("before"))
    err = sent.join(y, [*clip, "frame_idx", "x", "y"]).groupBy(*clip, "frame_idx", "dx", "dy").agg(F.round(F.avg((F.col("l") - F.col("before")) * (F.col("l") - F.col("before"))), 6).alias("err"))
    return err.groupBy(*clip, "frame_idx").agg(F.min(F.struct("err", "dy", "dx")).alias("m")).select(*clip, "frame_idx", "m.dx", "m.dy", "m.err")


def trails(px: DataFrame, frames: int = 3, decay: float = 0.5, clip: tuple[str, ...] = ()) -> DataFrame:
    """Each pixel over the decayed maximum of its last frames."""
    past = {f"_{c}{k}": (c, k) for c in "rgb" for k in range(1, frames + 1)}
    near = beside(px, past, clip)
    made = {c: byte(F.greatest(F.col(c), *(F.coalesce(F.col(f"_{c}{k}"), F.lit(0)) * F.lit(decay**k) for k in range(1, frames + 1)))) for c in "rgb"}
    return near.withColumns(made).drop(*past)


def accumulate(px: DataFrame, weight: float = 0.35, clip: tuple[str, ...] = (), tiles: int = 64) -> DataFrame:
    """Exponential mean over frames: ``out = out + (in - out) * weight``, truncated at every frame.

    One pass over the frames of each of ``tiles`` groups of places; a place that lacks a frame goes on with the next."""
    schema = T.StructType([T.StructField(c.name, T.IntegerType()) if c.name in ("r", "g", "b") else c for c in px.schema.fields] + [T.StructField("_tile", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        x, y, frame = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "frame_idx"))
        _, place = np.unique(np.stack((x, y)), axis=1, return_inverse=True)
        values = np.stack([table.column(c).to_numpy() for c in "rgb"], axis=1).astype(np.int64)
        order = np.argsort(frame, kind="stable")
        cuts = np.flatnonzero(np.diff(frame[order])) + 1
        mean, seen = np.zeros((place.max() + 1, 3), dtype=np.int64), np.zeros(place.max() + 1, dtype=bool)
        for rows in np.split(order, cuts):
            at = place[rows]
            mean[at] = np.where(seen[at, None], np.floor(mean[at] + (values[rows] - mean[at]) * weight).astype(np.int64), values[rows])
            seen[at] = True
            values[rows] = mean[at]
        for k, c in enumerate("rgb"):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(values[:, k].astype(np.int32)))
        return table

    tiled = px.withColumn("_tile", F.pmod(F.xxhash64("x", "y"), F.lit(tiles)))
    return tiled.groupBy(*clip, "_tile").applyInArrow(run, schema).drop("_tile")


def _after(px: DataFrame, clip: tuple[str, ...]) -> DataFrame:
    """Pixels that have one in the next frame, with it as ``n_r`` ..."""
    return beside(px, {f"n_{c}": (c, -1) for c in "rgba"}, clip).where("n_r is not null")


def crossfade(px: DataFrame, t: Column, ease: bool = True, clip: tuple[str, ...] = ()) -> DataFrame:
    """Each frame blended with the one after it; the last of a place has none."""
    k = clamp(t, 0.0, 1.0)
    k = k * k * (F.lit(3.0) - k * 2) if ease else k
    return _after(px, clip).withColumns({c: byte(F.col(c) + (F.col(f"n_{c}") - F.col(c)) * k) for c in "rgba"}).drop(*(f"n_{c}" for c in "rgba"))


def wipe_mask(shape: str, k: float, width: int, height: int, band: int = 12) -> Column:
    """Where the second picture shows at ``k`` of the transition."""
    x, y = F.col("x"), F.col("y")
    cx, cy = width / 2, height / 2
    return {
        "left": x / float(width) <= k, "right": F.lit(1.0) - x / float(width) <= k, "down": y / float(height) <= k, "up": F.lit(1.0) - y / float(height) <= k,
        "circle": F.hypot(x - cx, y - cy) <= math.hypot(cx, cy) * k,
        "rect": (F.abs(x - cx) / cx <= k) & (F.abs(y - cy) / cy <= k),
        "diamond": F.abs(x - cx) / (width * k or 1) + F.abs(y - cy) / (height * k or 1) <= 1,
        "blinds": (y % max(4, band)) / float(max(4, band)) <= k,
        "clock": (F.atan2(y - cy, x - cx) + math.pi) / (2 * math.pi) <= k,
    }[shape]


def wipe(px: DataFrame, shape: str, k: float, width: int, height: int, clip: tuple[str, ...] = ()) -> DataFrame:
    """Each frame with the one after it wiped in."""
    use = wipe_mask(shape, k, width, height)
    return _after(px, clip).withColumns({c: F.when(use, F.col(f"n_{c}")).otherwise(F.col(c)) for c in "rgba"}).drop(*(f"n_{c}" for c in "rgba"))


def cursor_echo(px: DataFrame, alpha: float = 0.25, every: int = 2, least: int = 40, clip: tuple[str, ...] = ()) -> DataFrame:
    """In every so manieth frame, pixels that changed much keep a share of what was there before."""
    p = with_previous(px, "rgb", clip)
    moved = sum(F.abs(F.col(c) - F.col(f"p_{c}")) for c in "rgb")
    echo = ((F.col("frame_idx") + 1) % every == 0) & (moved >= least)
    return p.withColumns({c: F.when(echo, byte(F.col(c) + (F.col(f"p_{c}") - F.col(c)) * F.lit(alpha))).otherwise(F.col(c)) for c in "rgb"}).drop("p_r", "p_g", "p_b")


def frame_hash(px: DataFrame, width: int = 16, height: int = 16, clip: tuple[str, ...] = ()) -> DataFrame:
    """FNV-like fold, 32 bits, over a grid of at least 16 by 16 pixels in order: equal frames have equal hashes."""
    on_grid = (F.col("x") % max(1, width // 16) == 0) & (F.col("y") % max(1, height // 16) == 0)
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", F.shiftleft("r", 16).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("b")).cast("bigint").alias("v"))))
    h = F.aggregate(ordered, F.lit(2166136261).cast("bigint"), lambda acc, p: (acc.bitwiseXOR(p["v"]) * 16777619).bitwiseAND(0xFFFFFFFF))
    return px.where(on_grid).groupBy(*clip, "frame_idx").agg(h.alias("hash"))


def rect_area(rect: Column) -> Column:
    """Pixels of a rectangle (struct with ``width`` and ``height``); 0 for none."""
    return F.coalesce(rect["width"] * rect["height"], F.lit(0))


def plan_disposal(px: DataFrame, width: int, height: int, threshold: int = 0, padding: int = 0, align: int = 1, limit: float = 0.92, full: bool = False, clip: tuple[str, ...] = ()) -> DataFrame:
    """What of each frame has to be encoded if every frame stays on the canvas: ``x0``, ``y0``, ``w``, ``h``, ``disposal`` (0: keep),
    ``unchanged`` (a frame that only prolongs the one before), ``sub_frame``, ``share`` of the canvas.

    The first frame of a clip is whole, as is one of whose canvas more than ``limit`` changes. The rectangle bounds all that
    changes by more than ``threshold``, so nothing outside it has to be restored, and keeping is always enough."""
    frames = px.select(*clip, "frame_idx").distinct()
    box = dirty_rect(px, threshold, padding, align, width, height, clip) if padding or align > 1 else dirty_rect(px, threshold, clip=clip)
    w = W.partitionBy(*clip, F.lit(0)).orderBy("frame_idx")  # a row for each frame
    j = frames.withColumn("_first", F.row_number().over(w) == 1).join(box, [*clip, "frame_idx"], "left")
    whole = F.col("_first") | F.lit(full) | (F.col("w") * F.col("h") > limit * width * height)
    unchanged = ~F.coalesce(whole, F.lit(False)) & F.col("w").isNull()
    sides = {"x0": F.lit(0), "y0": F.lit(0), "w": F.lit(width), "h": F.lit(height)}
    out = j.select(*clip, "frame_idx", *(F.when(unchanged, 0).when(whole, v).otherwise(F.col(c)).cast("int").alias(c) for c, v in sides.items()), unchanged.alias("unchanged"))
    area = F.col("w") * F.col("h")
    return out.withColumns({"disposal": F.lit(0), "sub_frame": ~F.col("unchanged") & (area < width * height), "share": F.round(area / float(width * height), 6)})


def clip_duration(frames: DataFrame, delay: str = "delay_cs", clip: str = "clip_id") -> DataFrame:
    total = F.sum(delay) * 10
    return frames.groupBy(clip).agg(
        total.alias("duration_ms"), F.round(F.count("*") * 1000.0 / F.greatest(total, F.lit(1)), 6).alias("fps"), F.count_distinct(delay).alias("distinct_delays"),
        F.min(delay).alias("min_delay"), F.max(delay).alias("max_delay"),
    )


def capture_policy(want: Column, source: Column, covered_ms: Column, trim: Column, callbacks: Column, seek: float = 45, play: float = 6, rate: float = 1.0) -> Column:
    """``play`` through or ``seek`` each frame, whichever is estimated to be cheaper."""
    play_cost = covered_ms / rate + want * play + F.when(trim, seek).otherwise(0)
    seek_cost = want * seek
    share = F.when(source > 0, want / source).otherwise(1.0)
    rest = F.when((share > 0.35) & ~trim & (play_cost < seek_cost), "play").when(play_cost * 1.25 < seek_cost, "play").otherwise("seek")
    return F.when(~callbacks | (want <= 3), "seek").otherwise(rest)
