"""Queries of geometry, neighbourhood filters and drawing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighborhood as H
from ..operators import spatial as S
from ..plans.bridge import PX_SQL, SIDE, pixels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RGB = ["frame_idx", "x", "y", "r", "g", "b"]
RGBA = [*RGB, "a"]
N = SIDE


def _add(name: str, apply, sql: str, columns: list[str] = RGB) -> None:
    QUERIES[name] = lambda spark, d: apply(pixels(spark, d)).select(*columns)
    ORACLES[name] = f"with {PX_SQL} {sql}"


_add("crop", lambda p: S.crop(p, 3, 2, 8, 9), "select frame_idx, x - 3 as x, y - 2 as y, r, g, b from px where x between 3 and 10 and y between 2 and 10")
_add("trim_edges", lambda p: S.trim_edges(p, N, N, 1, 2, 3, 4), "select frame_idx, x - 1 as x, y - 2 as y, r, g, b from px where x between 1 and 12 and y between 2 and 11")
_add("flip", lambda p: S.flip(p, N, N, True, False), "select frame_idx, 15 - x as x, y, r, g, b from px")
_add("transpose", S.transpose, "select frame_idx, y as x, x as y, r, g, b from px")
_add("rotate90", lambda p: S.rotate(p, N, N, 90), "select frame_idx, 15 - y as x, x as y, r, g, b from px")
_add("rotate270", lambda p: S.rotate(p, N, N, 270), "select frame_idx, y as x, 15 - x as y, r, g, b from px")
_GRID = "f as (select distinct frame_idx from px), g as (select frame_idx, cast(i % {w} as integer) as x, cast(i // {w} as integer) as y from f, range({n}) t(i))"
_add("pad", lambda p: S.pad(p, N, N, 20, 18, (9, 8, 7, 255)),
     f", {_GRID.format(w=20, n=360)} select g.frame_idx, g.x, g.y, coalesce(r, 9) as r, coalesce(p.g, 8) as g, coalesce(b, 7) as b, coalesce(a, 255) as a from g left join px p on p.frame_idx = g.frame_idx and p.x + 2 = g.x and p.y + 1 = g.y", RGBA)
_add("pad_mirror", lambda p: S.pad(p, N, N, 20, 18, mode="mirror"),
     f", {_GRID.format(w=20, n=360)} select g.frame_idx, g.x, g.y, r, p.g, b from g join px p on p.frame_idx = g.frame_idx and p.x = case when (g.x - 2 + 32) % 32 < 16 then (g.x - 2 + 32) % 32 else 31 - (g.x - 2 + 32) % 32 end and p.y = case when (g.y - 1 + 32) % 32 < 16 then (g.y - 1 + 32) % 32 else 31 - (g.y - 1 + 32) % 32 end")
_add("scale_nearest", lambda p: S.scale_nearest(p, N, N, 24, 10),
     f", {_GRID.format(w=24, n=240)} select g.frame_idx, g.x, g.y, r, p.g, b from g join px p on p.frame_idx = g.frame_idx and p.x = g.x * 16 // 24 and p.y = g.y * 16 // 10")
_add("scale_area", lambda p: S.scale_area(p, 4, 2),
     """select frame_idx, x // 4 as x, y // 2 as y, cast(case when sum(a) > 0 then floor(sum(r * a) / cast(sum(a) as double) + 0.5e0) else 0 end as integer) as r,
     cast(case when sum(a) > 0 then floor(sum(g * a) / cast(sum(a) as double) + 0.5e0) else 0 end as integer) as g, cast(case when sum(a) > 0 then floor(sum(b * a) / cast(sum(a) as double) + 0.5e0) else 0 end as integer) as b,
     cast(floor(avg(a) + 0.5e0) as integer) as a from px group by frame_idx, x // 4, y // 2""", RGBA)  # fmt: skip
_add("downscale2x", S.downscale2x, "select frame_idx, x // 2 as x, y // 2 as y, cast((sum(r) + 2) // 4 as integer) as r, cast((sum(g) + 2) // 4 as integer) as g, cast((sum(b) + 2) // 4 as integer) as b from px group by frame_idx, x // 2, y // 2 having count(*) = 4")
_BLOCK = "avg({c}) over (partition by frame_idx, x // {n}, y // {n})"
_add("pixelate", lambda p: S.pixelate(p, 4), f"select frame_idx, x, y, {', '.join(f'cast(floor({_BLOCK.format(c=c, n=4)}) as integer) as {c}' for c in 'rgb')} from px")
_Y = "(0.2126e0 * {r} + 0.7152e0 * {g} + 0.0722e0 * {b})"
_Y1, _Y2 = _Y.format(r="r", g="g", b="b"), _Y.format(r="mr", g="mg", b="mb")
_add("chroma_subsample", lambda p: S.chroma_subsample(p, 2),
     f", m as (select *, {', '.join(f'floor({_BLOCK.format(c=c, n=2)}) as m{c}' for c in 'rgb')} from px) select frame_idx, x, y, {', '.join(f'cast(trunc(least(greatest({_Y1} + (m{c} - {_Y2}), 0e0), 255e0)) as integer) as {c}' for c in 'rgb')} from m")
_T = "least(greatest((sqrt(((x + 0.5e0 - 8e0) / 8e0) * ((x + 0.5e0 - 8e0) / 8e0) + ((y + 0.5e0 - 8e0) / 8e0) * ((y + 0.5e0 - 8e0) / 8e0)) / 1.4142135623730951e0 - 0.5e0) / 0.5e0, 0e0), 1e0) * 0.75e0"
_add("vignette", lambda p: S.vignette(p, N, N, 0.75, 0.5), f"select frame_idx, x, y, {', '.join(f'cast(trunc(least(greatest({c} + (0e0 - {c}) * ({_T}), 0e0), 255e0)) as integer) as {c}' for c in 'rgb')} from px")
_C = "case when {v} < 4 then 4 when {v} >= 12 then 11 else {v} end"
_D2 = f"((x - {_C.format(v='x')}) * (x - {_C.format(v='x')}) + (y - {_C.format(v='y')}) * (y - {_C.format(v='y')}))"
_add("rounded_corners", lambda p: S.rounded_corners(p, N, N, 4), f"select frame_idx, x, y, r, g, b, cast(trunc(a * least(greatest(1e0 - ({_D2} - 16) / 8e0, 0e0), 1e0)) as integer) as a from px", RGBA)
_add("border", lambda p: S.border(p, N, N, 2, (1, 2, 3)), "select frame_idx, x, y, " + ", ".join(f"case when x < 2 or y < 2 or x >= 14 or y >= 14 then {k} else {c} end as {c}" for c, k in zip("rgba", (1, 2, 3, 255), strict=True)) + " from px", RGBA)
_add("tile_layout", lambda p: S.tile(p, N, N, 5), "select frame_idx, cast(x + (frame_idx % 5) * 16 as integer) as x, cast(y + (frame_idx // 5) * 16 as integer) as y, r, g, b from px")
_add("mirror4", lambda p: S.mirror(p, N, N), "select frame_idx, unnest([x, 15 - x, x, 15 - x]) as x, unnest([y, y, 15 - y, 15 - y]) as y, r, g, b from px where x < 8 and y < 8")
_add("stack_frames", lambda p: S.stack(p, S.flip(p, N, N), N, N, gap=2), "select frame_idx, x, y, r, g, b from px union all select frame_idx, 15 - x + 18, y, r, g, b from px")


def _next(p):
    return p.withColumn("frame_idx", F.col("frame_idx") - 1)


_add("compare_diff", lambda p: S.compare(p, _next(p), N, N),
     "select p.frame_idx, p.x, p.y, " + ", ".join(f"least(abs(p.{c} - q.{c}) * 4, 255) as {c}" for c in "rgb") + " from px p join px q on q.frame_idx = p.frame_idx + 1 and q.x = p.x and q.y = p.y")
_add("blit", lambda p: S.blit(p, S.crop(p, 0, 0, 6, 6), 5, 5, 0.5),
     """, j as (select p.*, q.r as r2, q.g as g2, q.b as b2, coalesce(q.a / 255e0 * 0.5e0, 0e0) as k from px p left join px q on q.frame_idx = p.frame_idx and q.x < 6 and q.y < 6 and q.x + 5 = p.x and q.y + 5 = p.y),
     m as (select *, k + a / 255e0 * (1e0 - k) as al from j)
     select frame_idx, x, y, """ + ", ".join(f"case when k = 0 then {c} else cast(trunc(({c}2 * k + {c} * (a / 255e0) * (1e0 - k)) / al + 0.5e0) as integer) end as {c}" for c in "rgb") + ", case when k = 0 then a else cast(trunc(al * 255 + 0.5e0) as integer) end as a from m", RGBA)  # fmt: skip
_add("fill_rect", lambda p: S.fill_rect(p, 2, 3, 5, 6, (255, 128, 0), 0.5),
     "select frame_idx, x, y, " + ", ".join(f"case when x between 2 and 6 and y between 3 and 8 then cast(trunc({c} + ({k}e0 - {c}) * 0.5e0) as integer) else {c} end as {c}" for c, k in zip("rgb", (255, 128, 0), strict=True)) + " from px")
_K = "least(greatest(5.5e0 - sqrt((x - 8e0) * (x - 8e0) + (y - 7e0) * (y - 7e0)), 0e0), 1e0)"
_add("fill_circle", lambda p: S.fill_circle(p, 8.0, 7.0, 5, (10, 200, 30)),
     "select frame_idx, x, y, " + ", ".join(f"case when {_K} > 0 then cast(trunc({c} + ({k}e0 - {c}) * {_K}) as integer) else {c} end as {c}" for c, k in zip("rgb", (10, 200, 30), strict=True)) + " from px")
_add("redact", lambda p: S.redact(p, 4, 4, 8, 8),
     f"select frame_idx, x, y, {', '.join(f'cast(floor({_BLOCK.format(c=c, n=4)}) as integer) as {c}' for c in 'rgb')} from px where x between 4 and 11 and y between 4 and 11 union all select frame_idx, x, y, r, g, b from px where not (x between 4 and 11 and y between 4 and 11)")
_add("black_bars", lambda p: S.black_bars(p.withColumns({c: F.when(F.col("y") < 3, 5).otherwise(F.col(c)) for c in "rgb"}), N, N),
     """, d as (select frame_idx, x, y, case when y < 3 then 0 else cast(greatest(r, g, b) > 24 as integer) end as lit from px),
     c as (select frame_idx, min(x) as x0, max(x) as x1 from (select frame_idx, x from d group by frame_idx, x having avg(lit) > 0.02) group by frame_idx),
     r as (select frame_idx, min(y) as y0, max(y) as y1 from (select frame_idx, y from d group by frame_idx, y having avg(lit) > 0.02) group by frame_idx)
     select frame_idx, coalesce(x0, 0) as "left", coalesce(y0, 0) as top, coalesce(15 - x1, 0) as "right", coalesce(15 - y1, 0) as bottom from (select distinct frame_idx from px) left join c using (frame_idx) left join r using (frame_idx)""",
     ["frame_idx", "left", "top", "right", "bottom"])
_add("watermark_anchor", lambda p: S.watermark_anchor(p, N, N),
     f""", q as (select frame_idx, case when y < 8 then 'top' else 'bottom' end || '-' || case when x < 8 then 'left' else 'right' end as anchor, round(var_pop({_Y1}), 6) as variance from px where x % 3 = 0 and y % 3 = 0 group by all)
     select frame_idx, anchor, variance from (select *, row_number() over (partition by frame_idx order by variance, anchor) as k from q) where k = 1""", ["frame_idx", "anchor", "variance"])  # fmt: skip
_add("mean_luma", S.mean_luma, f"select frame_idx, round(avg({_Y1}), 6) as mean_luma from px group by frame_idx", ["frame_idx", "mean_luma"])
_add("ken_burns", lambda p: S.ken_burns(p, N, N, 2.0),
     f", {_GRID.format(w=16, n=256)} select g.frame_idx, g.x, g.y, r, p.g, b from g join px p on p.frame_idx = g.frame_idx and p.x = 4 + g.x // 2 and p.y = 4 + g.y // 2")


# frames with all their places: what a frame lacks is 0 to its neighbours
_FULL = """, g0 as (select f.frame_idx, cast(i % 16 as integer) as x, cast(i // 16 as integer) as y from (select distinct frame_idx from px) f, range(256) t(i)),
  fp as (select g0.frame_idx, g0.x, g0.y, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b from g0 left join px using (frame_idx, x, y))"""


def _conv(k: list[int], div: int, bias: int = 0) -> str:
    taps = ", ".join(f"({dx}, {dy}, {k[(dy + 1) * 3 + dx + 1]})" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    sums = ", ".join(f"cast(least(greatest(floor(sum(q.{c} * w) / {div}e0 + {bias} + 0.5e0), 0), 255) as integer) as {c}" for c in "rgb")
    return f"""{_FULL}
    select p.frame_idx, p.x, p.y, {sums} from px p cross join (values {taps}) t(dx, dy, w)
    join fp q on q.frame_idx = p.frame_idx and q.x = least(greatest(p.x + dx, 0), 15) and q.y = least(greatest(p.y + dy, 0), 15) group by p.frame_idx, p.x, p.y"""


for _name, _kernel, _taps, _div, _bias in (
    ("convolve_sharpen", "sharpen", [0, -1, 0, -1, 5, -1, 0, -1, 0], 1, 0), ("convolve_edge", "edge", [-1, -1, -1, -1, 8, -1, -1, -1, -1], 1, 0),
    ("emboss", "emboss", [-2, -1, 0, -1, 1, 1, 0, 1, 2], 1, 128), ("gaussian", "gaussian", [1, 2, 1, 2, 4, 2, 1, 2, 1], 16, 0),
    ("convolve_sobel", "sobelX", [-1, 0, 1, -2, 0, 2, -1, 0, 1], 1, 0), ("convolve_box", "box", [1, 1, 1, 1, 1, 1, 1, 1, 1], 9, 0),
):
    _add(_name, lambda p, k=_kernel, b=_bias: H.convolve(p, N, N, k, bias=b), _conv(_taps, _div, _bias))
_add("denoise", lambda p: H.denoise(p, N, N, 6),
     f"""{_FULL}, t as (select unnest([-1, 0, 1]) as dx), s as (select t.dx, u.dx as dy from t, t u),
     n as (select p.frame_idx, p.x, p.y, q.r, q.g, q.b, case when dx = 0 and dy = 0 then 3 else 1 end as w from px p cross join s
       join fp q on q.frame_idx = p.frame_idx and q.x = least(greatest(p.x + dx, 0), 15) and q.y = least(greatest(p.y + dy, 0), 15)
       where (q.r - p.r) * (q.r - p.r) + (q.g - p.g) * (q.g - p.g) + (q.b - p.b) * (q.b - p.b) <= 6912)
     select frame_idx, x, y, cast(sum(r * w) // sum(w) as integer) as r, cast(sum(g * w) // sum(w) as integer) as g, cast(sum(b * w) // sum(w) as integer) as b from n group by frame_idx, x, y""")  # fmt: skip
_BLUR = f"""{_FULL}, o as (select unnest([-2, -1, 0, 1, 2]) as d),
  h as (select p.frame_idx, p.x, p.y, cast(sum(q.r) // 5 as integer) as r, cast(sum(q.g) // 5 as integer) as g, cast(sum(q.b) // 5 as integer) as b from fp p, o join fp q on q.frame_idx = p.frame_idx and q.y = p.y and q.x = least(greatest(p.x + d, 0), 15) group by p.frame_idx, p.x, p.y),
  v as (select p.frame_idx, p.x, p.y, cast(sum(q.r) // 5 as integer) as r, cast(sum(q.g) // 5 as integer) as g, cast(sum(q.b) // 5 as integer) as b from px p, o join h q on q.frame_idx = p.frame_idx and q.x = p.x and q.y = least(greatest(p.y + d, 0), 15) group by p.frame_idx, p.x, p.y)"""
_add("box_blur_1pass", lambda p: H.box_blur(p, N, N, 2), f"{_BLUR} select frame_idx, x, y, r, g, b from v")
_add("unsharp", lambda p: H.unsharp(p, N, N, 1.5, 2, 1),
     f"{_BLUR} select p.frame_idx, p.x, p.y, {', '.join(f'case when abs(p.{c} - v.{c}) > 1 then cast(trunc(least(greatest(p.{c} + (p.{c} - v.{c}) * 1.5e0, 0e0), 255e0)) as integer) else p.{c} end as {c}' for c in 'rgb')} from px p join v using (frame_idx, x, y)")
_add("auto_levels", H.auto_levels,
     f""", h as (select frame_idx, cast(floor({_Y1}) as integer) as v, count(*) as n from px where a >= 8 group by all),
     c as (select frame_idx, v, sum(n) over (partition by frame_idx order by v) as below, sum(n) over (partition by frame_idx order by v desc) as above, sum(n) over (partition by frame_idx) * 0.005e0 as lim from h),
     e as (select frame_idx, min(case when below >= lim then v end) as lo, max(case when above >= lim then v end) as hi from c group by frame_idx)
     select frame_idx, x, y, {', '.join(f'case when hi - lo >= 4 then cast(least(greatest(floor(({c} - lo) * 255 / cast(hi - lo as double) + 0.5e0), 0), 255) as integer) else {c} end as {c}' for c in 'rgb')} from px left join e using (frame_idx)""")  # fmt: skip
_DK = "((p.r - mr) * (p.r - mr) + (p.g - mg) * (p.g - mg) + (p.b - mb) * (p.b - mb))"
_add("auto_key", lambda p: H.auto_key(p, N, N),
     f""", m as (select frame_idx, cast(floor(avg(r)) as integer) as mr, cast(floor(avg(g)) as integer) as mg, cast(floor(avg(b)) as integer) as mb from px where x in (0, 15) and y in (0, 15) group by frame_idx)
     select p.frame_idx, x, y, r, g, b, case when {_DK} <= 3600 then 0 when {_DK} <= 6000 then cast(trunc(a * ({_DK} - 3600e0) / 2400e0) as integer) else a end as a from px p left join m using (frame_idx)""", RGBA)  # fmt: skip
