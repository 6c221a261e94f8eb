"""Queries of scaling, layouts, drawing, hashes, colours and plans."""

from __future__ import annotations

import math
import struct

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import overlays as O
from ..operators import palettes as P
from ..operators import pointwise as PW
from ..operators import size_model as M
from ..operators import spatial as S
from ..operators import temporal as T
from ..plans import filtergraph as FG
from ..plans.bridge import PX_SQL, SIDE, pixels, table, timeline, TIMELINE_SQL
from ..sources import lzw, mux, stills
from .time import _FR, _SLOTS, _STATS, _frames, _pixels_as_streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RGB = ["frame_idx", "x", "y", "r", "g", "b"]
RGBA = [*RGB, "a"]
_GRID = "fr0 as (select distinct frame_idx from px), g0 as (select frame_idx, cast(i % {w} as integer) as x, cast(i // {w} as integer) as y from fr0, range({n}) t(i))"


def _add(name: str, apply, sql: str, columns: list[str] | None = RGB) -> None:
    QUERIES[name] = lambda spark, d: apply(pixels(spark, d)).select(*columns) if columns else apply(pixels(spark, d))
    ORACLES[name] = f"with {PX_SQL} {sql}"


# --- scaling ---


def _bilinear(w: int, h: int) -> str:
    """Four neighbours by their weights, colours times alpha, clamped at the edges."""
    return f""", {_GRID.format(w=w, n=w * h)}, p0 as (select *, greatest((x + 0.5e0) * {16 / w!r}::double - 0.5e0, 0e0) as sx, greatest((y + 0.5e0) * {16 / h!r}::double - 0.5e0, 0e0) as sy from g0),
    p1 as (select *, least(floor(sx), 15)::integer as x0, least(floor(sy), 15)::integer as y0, case when floor(sx) > 15 then 0 else sx - floor(sx) end as wx, case when floor(sy) > 15 then 0 else sy - floor(sy) end as wy from p0),
    p2 as (select p1.frame_idx, p1.x, p1.y, q.r, q.g, q.b, q.a, (case when dx = 1 then wx else 1 - wx end) * (case when dy = 1 then wy else 1 - wy end) as w
      from p1 cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) t(dx, dy) join px q on q.frame_idx = p1.frame_idx and q.x = least(x0 + dx, 15) and q.y = least(y0 + dy, 15)),
    p3 as (select frame_idx, x, y, sum(r * a * w) as r, sum(g * a * w) as g, sum(b * a * w) as b, sum(a * w) as a from p2 where w > 0 group by 1, 2, 3)
    select frame_idx, x, y, {', '.join(f'case when a > 0 then cast(trunc(least(greatest(round({c} / a, 6), 0), 255)) as integer) else 0 end as {c}' for c in 'rgb')}, cast(trunc(least(round(a, 6), 255)) as integer) as a from p3"""


_add("scale_bilinear", lambda p: S.scale(p, SIDE, SIDE, 23, 9, "bilinear"), _bilinear(23, 9), RGBA)
_add("scale_area_grows", lambda p: S.scale(p, SIDE, SIDE, 20, 11, "area"), _bilinear(20, 11), RGBA)
_CELLS = """, c0 as (select *, (select max(t) from range({w}) r(t) where floor(t * 16e0 / {w}) <= x) as cx, (select max(t) from range({h}) r(t) where floor(t * 16e0 / {h}) <= y) as cy from px)
  select frame_idx, cast(cx as integer) as x, cast(cy as integer) as y, {rgb}, cast(floor(avg(a)) as integer) as a from c0 group by frame_idx, cx, cy"""
_add("scale_area_cells", lambda p: S.scale(p, SIDE, SIDE, 7, 5, "area"),
     _CELLS.format(w=7, h=5, rgb=", ".join(f"cast(case when sum(a) > 0 then floor(sum({c} * a) / cast(sum(a) as double)) else 0 end as integer) as {c}" for c in "rgb")), RGBA)
_add("filter_scale", lambda p: FG.apply(FG.Clip(p, SIDE, SIDE), "scale=7:5").px,
     _CELLS.format(w=7, h=5, rgb=", ".join(f"cast(case when sum(a) > 0 then floor(sum({c} * a) / cast(sum(a) as double)) else 0 end as integer) as {c}" for c in "rgb")), RGBA)

# --- layouts ---

_add("mosaic", lambda p: S.mosaic(p, SIDE, SIDE, 3, 2, 24, 16), "select frame_idx, cast(x // 2 + (frame_idx % 3) * 8 as integer) as x, cast(y // 2 + (frame_idx // 3) * 8 as integer) as y, "
     + ", ".join(f"cast(case when sum(a) > 0 then floor(sum({c} * a) / cast(sum(a) as double)) else 0 end as integer) as {c}" for c in "rgb") + " from px where frame_idx < 6 group by frame_idx, x // 2, y // 2")
_add("scroll_frames", lambda p: S.scroll_frames(p, SIDE, 6, 5), "select frame_idx, cast(k as integer) as slot, x, cast(y - o as integer) as y, r, g, b from px, (values (0, 0), (1, 3), (2, 5), (3, 8), (4, 10)) t(k, o) where y between o and o + 5", ["frame_idx", "slot", "x", "y", "r", "g", "b"])
_add("scroll_pingpong", lambda p: S.scroll_frames(p, SIDE, 6, 5, True), "select frame_idx, cast(k as integer) as slot, x, cast(y - o as integer) as y, r, g, b from px, (values (0, 0), (1, 5), (2, 10), (3, 5), (4, 0)) t(k, o) where y between o and o + 5", ["frame_idx", "slot", "x", "y", "r", "g", "b"])
_C30, _S30 = math.cos(math.radians(30)), math.sin(math.radians(30))
_add("blit_rotated", lambda p: S.blit_rotated(p, S.crop(p, 0, 0, 7, 5), 7, 5, 8.0, 8.0, 30, 0.75),
     f""", s0 as (select frame_idx, cast(floor({8 - 3.5 * _C30 + 2.5 * _S30!r}::double + x * {_C30!r}::double - y * {_S30!r}::double + 0.5e0) as integer) as tx, cast(floor({8 - 3.5 * _S30 - 2.5 * _C30!r}::double + x * {_S30!r}::double + y * {_C30!r}::double + 0.5e0) as integer) as ty,
       row_number() over (partition by frame_idx, tx, ty order by y desc, x desc) as k, r as r2, g as g2, b as b2, a / 255e0 * 0.75e0 as o from px where x < 7 and y < 5 and a > 0)
     select px.frame_idx, x, y, {', '.join(f'case when o > 0 then cast(trunc(least({c}2 * o + {c} * (1 - o), 255)) as integer) else {c} end as {c}' for c in 'rgb')}, case when o > 0 then cast(trunc(least(o * 255 + a * (1 - o), 255)) as integer) else a end as a
     from px left join s0 on s0.frame_idx = px.frame_idx and tx = x and ty = y and k = 1""", RGBA)  # fmt: skip

# --- drawing ---


def _drawn(k: str, color: tuple[int, int, int], base: str = "px") -> str:
    part = ", ".join(f"case when k > 0 then cast(trunc(least(greatest({c} + ({v}e0 - {c}) * k, 0e0), 255e0)) as integer) else {c} end as {c}" for c, v in zip("rgb", color, strict=True))
    return f"select frame_idx, x, y, {part}, case when k > 0 then greatest(a, cast(trunc(least(k * 255, 255e0)) as integer)) else a end as a from (select *, {k} as k from {base})"


_BOX = "case when x between 3 and 10 and y between 2 and 12 and not (x between 5 and 8 and y between 4 and 10) then 0.5e0 else 0e0 end"
_add("stroke_rect", lambda p: S.stroke_rect(p, 3, 2, 8, 11, 2, (9, 90, 200), 0.5), _drawn(_BOX, (9, 90, 200)), RGBA)


def _segment(x0: float, y0: float, x1: float, y1: float, thickness: float) -> str:
    vx, vy = x1 - x0, y1 - y0
    t = f"least(greatest(((x - {x0!r}::double) * {vx!r}::double + (y - {y0!r}::double) * {vy!r}::double) / {vx * vx + vy * vy!r}::double, 0e0), 1e0)"
    d = f"sqrt(pow(x - {x0!r}::double - {t} * {vx!r}::double, 2) + pow(y - {y0!r}::double - {t} * {vy!r}::double, 2))"
    return f"least(greatest({thickness / 2 + 0.5!r}::double - {d}, 0e0), 1e0)"


_add("draw_line", lambda p: S.draw_line(p, 1.5, 2.0, 13.0, 9.5, 2.0, (250, 10, 20)), _drawn(_segment(1.5, 2.0, 13.0, 9.5, 2.0), (250, 10, 20)), RGBA)


def _arrow() -> str:
    turn = math.atan2(8.0, 10.0)
    ends = [(12.0 + 5 * math.cos(turn + math.pi - side * math.pi / 6), 11.0 + 5 * math.sin(turn + math.pi - side * math.pi / 6)) for side in (-1, 1)]
    one = _drawn(_segment(2.0, 3.0, 12.0, 11.0, 1.5), (0, 255, 0))
    for x, y in ends:
        one = _drawn(_segment(12.0, 11.0, x, y, 1.5), (0, 255, 0), f"({one})")
    return one


_add("draw_arrow", lambda p: S.draw_arrow(p, 2.0, 3.0, 12.0, 11.0, 1.5, 5, (0, 255, 0)), _arrow(), RGBA)
_inner = "x between 2 and 9 and y between 4 and 11"
_add("highlight", lambda p: O.highlight(p, 2, 4, 8, 8, (255, 255, 0), 0.3),
     _drawn("case when x between 2 and 9 and y between 4 and 11 and not (x between 3 and 8 and y between 5 and 10) then 1e0 else 0e0 end", (255, 255, 0), f"({_drawn(f'case when {_inner} then 0.3e0 else 0e0 end', (255, 255, 0))})"), RGBA)
_add("progress_bar", lambda p: O.progress(p, SIDE, SIDE, F.col("frame_idx") / 40.0, 2, (1, 2, 3)), _drawn("case when y >= 14 and x < frame_idx / 40e0 * 16 then 1e0 else 0e0 end", (1, 2, 3)), RGBA)
# the digits 1 and 7 as their rows of bits, at (2, 3) and (6, 3)
_INK = " or ".join(f"(x = {x0 + i} and y = {3 + k})" for x0, rows in ((2, (".#.", "##.", ".#.", ".#.", "###")), (6, ("###", "..#", "..#", "..#", "..#"))) for k, row in enumerate(rows) for i, c in enumerate(row) if c == "#")
_add("draw_text", lambda p: O.draw_text(p, "17", 2, 3, (255, 0, 128)), _drawn(f"case when {_INK} then 1e0 else 0e0 end", (255, 0, 128)), RGBA)
_add("overlay_types", lambda p: O.overlay(p, [("rect", {"x": 1, "y": 1, "width": 4, "height": 4, "color": (9, 9, 9)}), ("counter", {"text": "17", "x": 2, "y": 3, "color": (255, 0, 128)}), ("frame", {"x": 3, "y": 2, "width": 8, "height": 11, "thickness": 2, "color": (9, 90, 200), "alpha": 0.5})]),
     _drawn(_BOX, (9, 90, 200), f"({_drawn(f'case when {_INK} then 1e0 else 0e0 end', (255, 0, 128), '(' + _drawn('case when x between 1 and 4 and y between 1 and 4 then 1e0 else 0e0 end', (9, 9, 9)) + ')')})"), RGBA)

# --- over time ---

_NEXT = ", d as (select p.*, q.r as nr, q.g as ng, q.b as nb, q.a as na from px p join px q on q.frame_idx = p.frame_idx + 1 and q.x = p.x and q.y = p.y)"
_add("interpolate_frame", lambda p: T.crossfade(p, F.lit(0.25), ease=False), f"{_NEXT} select frame_idx, x, y, " + ", ".join(f"cast(trunc({c} + (n{c} - {c}) * 0.25e0) as integer) as {c}" for c in "rgba") + " from d", RGBA)
_add("frame_hash", lambda p: T.frame_hash(p, SIDE, SIDE), "select frame_idx, list_reduce(list_prepend(2166136261::bigint, list((r::bigint << 16) | (g << 8) | b order by y, x)), lambda h, v: (xor(h, v) * 16777619) & 4294967295) as hash from px group by frame_idx", None)
_add("frame_hash_grid", lambda p: T.frame_hash(p, 48, 32), "select frame_idx, list_reduce(list_prepend(2166136261::bigint, list((r::bigint << 16) | (g << 8) | b order by y, x)), lambda h, v: (xor(h, v) * 16777619) & 4294967295) as hash from px where x % 3 = 0 and y % 2 = 0 group by frame_idx", None)


def _rects(s, d):
    r = lambda k: F.struct((F.col("p_partkey") * (3 + k) % 40).alias("x"), (F.col("p_partkey") * (5 + k) % 30).alias("y"), (F.col("p_size") % (9 + k) + 1).alias("width"), (F.col("p_partkey") % (8 - k) + 1).alias("height"))
    a, b = r(0), r(2)
    u = T.union_rect(a, b)
    return table(s, d, "part").select("p_partkey", u["x"].alias("x"), u["y"].alias("y"), u["width"].alias("w"), u["height"].alias("h"), T.contains(a, b).alias("inside"), T.contains(u, b).alias("covered"), T.rect_area(a).alias("area"))


QUERIES["rect_algebra"] = _rects
ORACLES["rect_algebra"] = """with r as (select p_partkey, p_partkey * 3 % 40 as ax, p_partkey * 5 % 30 as ay, p_size % 9 + 1 as aw, p_partkey % 8 + 1 as ah, p_partkey * 5 % 40 as bx, p_partkey * 7 % 30 as by_, p_size % 11 + 1 as bw, p_partkey % 6 + 1 as bh from part)
select p_partkey, least(ax, bx) as x, least(ay, by_) as y, greatest(ax + aw, bx + bw) - least(ax, bx) as w, greatest(ay + ah, by_ + bh) - least(ay, by_) as h,
  bx >= ax and by_ >= ay and bx + bw <= ax + aw and by_ + bh <= ay + ah as inside, true as covered, aw * ah as area from r"""
_MOVED = "greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b), abs(p.a - q.a) >> 2)"
_add("plan_disposal", lambda p: T.plan_disposal(p.where("x % 16 < 12 or frame_idx % 4 = 0"), SIDE, SIDE, 120),
     f""", v as (select * from px where x < 12 or frame_idx % 4 = 0), m as (select p.frame_idx, min(p.x) as x0, min(p.y) as y0, max(p.x) as x1, max(p.y) as y1 from v p join v q on q.frame_idx = p.frame_idx - 1 and q.x = p.x and q.y = p.y where {_MOVED} > 120 group by 1),
     b as (select frame_idx, x0, y0, x1 - x0 + 1 as w, y1 - y0 + 1 as h from m), f as (select distinct frame_idx from v), j as (select f.frame_idx, f.frame_idx = 0 or coalesce(w * h > 0.92 * 256, false) as whole, b.x0, b.y0, b.w, b.h from f left join b using (frame_idx)),
     o as (select frame_idx, case when whole or w is null then 0 else x0 end as x0, case when whole or w is null then 0 else y0 end as y0, case when whole then 16 when w is null then 0 else w end as w, case when whole then 16 when h is null then 0 else h end as h, not whole and w is null as unchanged from j)
     select frame_idx, x0, y0, w, h, unchanged, 0 as disposal, not unchanged and w * h < 256 as sub_frame, round(w * h / 256e0, 6) as share from o""", None)  # fmt: skip


def _shift(s, d):
    motion = pixels(s, d).select("frame_idx").distinct().select("frame_idx", (F.col("frame_idx") % 5 - 2).alias("dx"), (F.col("frame_idx") % 3 - 1).alias("dy"))
    return O.stabilize(pixels(s, d), motion, 0.65, 1, SIDE, SIDE).select(*RGB)


QUERIES["stabilize"] = _shift
ORACLES["stabilize"] = f"""with {PX_SQL}, m as (select frame_idx, sum(frame_idx % 5 - 2) over w as sx, sum(frame_idx % 3 - 1) over w as sy from (select distinct frame_idx from px) window w as (order by frame_idx)),
e as (select frame_idx, sx, sy, list_reduce(list_prepend(0e0, list(sx::double) over w), lambda acc, v: acc * 0.65e0 + v * (1 - 0.65e0)) as cx, list_reduce(list_prepend(0e0, list(sy::double) over w), lambda acc, v: acc * 0.65e0 + v * (1 - 0.65e0)) as cy from m window w as (order by frame_idx rows between unbounded preceding and current row)),
j as (select px.frame_idx, cast(x - floor(sx - cx + 0.5e0) as integer) as x, cast(y - floor(sy - cy + 0.5e0) as integer) as y, r, g, b from px join e using (frame_idx))
select frame_idx, x - 1 as x, y - 1 as y, r, g, b from j where x between 1 and 14 and y between 1 and 14"""

# --- colours, tables, alpha ---


def _colors(p):
    r, g, b = N.rgb_of_hsl(F.col("r") / 255.0, F.col("g") / 255.0, F.col("b") / 255.0)
    k = N.key555(F.col("r"), F.col("g"), F.col("b"))
    packed = N.unpack_rgba(N.pack_rgba(F.col("r"), F.col("g"), F.col("b"), F.col("a")))
    five = N.rgb_of_555(k)
    return p.select("frame_idx", "x", "y", *(v.alias(f"hsl_{c}") for v, c in zip((r, g, b), "rgb", strict=True)), *(v.alias(f"un_{c}") for v, c in zip(packed, "rgba", strict=True)), *(v.alias(f"five_{c}") for v, c in zip(five, "rgb", strict=True)),
                    N.css_color(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("css"), F.round(N.lerp(F.col("r"), F.col("g"), F.col("b") / 255.0), 6).alias("lerp"))


_QP = "case when b / 255e0 < 0.5e0 then b / 255e0 * (1 + g / 255e0) else b / 255e0 + g / 255e0 - b / 255e0 * (g / 255e0) end"


def _hsl(shift: str) -> str:
    t = f"((r / 255e0 - floor(r / 255e0)) + {shift} - floor((r / 255e0 - floor(r / 255e0)) + {shift}))"
    wave = f"case when {t} < 1 / 6e0 then p0 + (q0 - p0) * 6 * {t} when {t} < 0.5e0 then q0 when {t} < 2 / 3e0 then p0 + (q0 - p0) * (2 / 3e0 - {t}) * 6 else p0 end"
    return f"cast(floor((case when g = 0 then b / 255e0 else {wave} end) * 255 + 0.5e0) as integer)"


_add("color_functions", _colors, f""", m as (select *, {_QP} as q0 from px), n as (select *, 2 * b / 255e0 - q0 as p0 from m)
  select frame_idx, x, y, {_hsl('1 / 3e0')} as hsl_r, {_hsl('0e0')} as hsl_g, {_hsl('-1 / 3e0')} as hsl_b, r as un_r, g as un_g, b as un_b, a as un_a, {', '.join(f'(({c} >> 3) << 3) | ({c} >> 5) as five_{c}' for c in 'rgb')},
  case when a >= 255 then printf('rgb(%d,%d,%d)', r, g, b) else printf('rgba(%d,%d,%d,%.3f)', r, g, b, a / 255e0) end as css, round(r + (g - r) * (b / 255e0), 6) as lerp from n""", None)  # fmt: skip


def _oklab_key(p):
    return p.select("frame_idx", "x", "y", N.oklab_key(F.col("r") / 255.0, F.col("g") / 255.0 - 0.5, F.col("b") / 255.0 - 0.5).alias("key"))


_add("oklab_key", _oklab_key, ", k as (select frame_idx, x, y, least(greatest(floor(r / 255e0 * 31 + 0.5e0), 0), 31)::integer as l, least(greatest(floor((g / 255e0 - 0.5e0 + 0.4e0) * 78.75e0 + 0.5e0), 0), 63)::integer as a1, least(greatest(floor((b / 255e0 - 0.5e0 + 0.4e0) * 78.75e0 + 0.5e0), 0), 63)::integer as b1 from px) select frame_idx, x, y, (l << 12) | (a1 << 6) | b1 as key from k", None)
_LUTS = (PW.gamma_lut(2.2), [255 - i for i in range(256)], [min(255, i + 40) for i in range(256)])
_G22 = "cast(least(greatest(floor(255 * pow({c} / 255e0, 1 / 2.2e0) + 0.5e0), 0), 255) as integer)"
_add("gamma_lut", lambda p: PW.apply_lut(p, PW.gamma_lut(2.2)), f"select frame_idx, x, y, {', '.join(f'{_G22.format(c=c)} as {c}' for c in 'rgb')} from px")
_add("compose_luts", lambda p: PW.apply_lut(p, PW.compose_luts(*_LUTS)), f"select frame_idx, x, y, {', '.join(f'least(255, 255 - {_G22.format(c=c)} + 40) as {c}' for c in 'rgb')} from px")
_add("clear_alpha", PW.clear_alpha, "select frame_idx, x, y, r, g, b, 0 as a from px", RGBA)
_add("detect_alpha", lambda p: PW.detect_alpha(p.where("frame_idx % 3 = 0 or a = 255"), 2), "select frame_idx, bool_or(a < 255) as has_alpha from px where (frame_idx % 3 = 0 or a = 255) and x % 2 = 0 group by frame_idx", None)

_COLOR_TEXTS = {
    "#1a2b3c": (26, 43, 60, 255), "#abc": (170, 187, 204, 255), "#12345678": (18, 52, 86, 120), "red": (255, 0, 0, 255), " Teal ": (0, 128, 128, 255), "rgb(1, 2, 3)": (1, 2, 3, 255),
    "rgba(10,20,30,0.5)": (10, 20, 30, 128), "hsl(120, 100%, 25%)": (0, 128, 0, 255), "transparent": (0, 0, 0, 0), "no colour": (0, 0, 0, 255), "rgb(300,-5,7)": (255, 0, 7, 255),
}
QUERIES["parse_color"] = lambda s, d: s.createDataFrame([(t, *N.parse_color(t)) for t in _COLOR_TEXTS], "text string, r int, g int, b int, a int")
ORACLES["parse_color"] = "select * from (values " + ", ".join(f"('{t}', {r}, {g}, {b}, {a})" for t, (r, g, b, a) in _COLOR_TEXTS.items()) + ") t(text, r, g, b, a)"

# --- histograms, palettes ---

_H = "h as (select frame_idx, (r << 16) | (g << 8) | b as key, sum(a / 255e0) as weight from px where a > 8 group by 1, 2)"
QUERIES["histogram_arrays"] = lambda s, d: P.histogram_arrays(P.histogram(pixels(s, d), ("frame_idx",)), ("frame_idx",)).select(
    "frame_idx", F.size("colors").cast("bigint").alias("n"), F.array_join(F.col("colors").cast("array<string>"), ",").alias("colors"), F.round(F.aggregate("weights", F.lit(0.0), lambda t, w: t + w), 6).alias("weight"), *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in "rgb")
)
ORACLES["histogram_arrays"] = f"with {PX_SQL}, {_H} select frame_idx, count(*) as n, string_agg(key, ',' order by key) as colors, round(sum(weight), 6) as weight, string_agg(key >> 16, ',' order by key) as r, string_agg((key >> 8) & 255, ',' order by key) as g, string_agg(key & 255, ',' order by key) as b from h group by frame_idx"
QUERIES["select_heavy"] = lambda s, d: P.select_heavy(P.histogram(pixels(s, d), ("frame_idx",)), 40, ("frame_idx",)).withColumn("weight", F.round("weight", 6))
ORACLES["select_heavy"] = f"""with {PX_SQL}, {_H}, k as (select *, row_number() over (partition by frame_idx order by weight desc, key) as rank, (((key >> 19) & 15) << 8) + (((key >> 11) & 15) << 4) + ((key >> 3) & 15) as cell from h),
s as (select b * 256 + g * 16 + r as shift, row_number() over (order by b, g, r) as turn from (select unnest([-1, 0, 1]) as b), (select unnest([-1, 0, 1]) as g), (select unnest([-1, 0, 1]) as r)),
n as (select t.frame_idx, t.key, any_value(t.weight) as weight, arg_min(q.rank, s.turn * 1000000 + q.rank) as to_rank from k t cross join s join k q on q.frame_idx = t.frame_idx and q.rank <= 40 and q.cell = t.cell + s.shift where t.rank > 40 group by 1, 2),
m as (select t.frame_idx, coalesce(to_rank, 1) as rank, sum(t.weight) as more from k t left join n using (frame_idx, key) where t.rank > 40 group by 1, 2)
select frame_idx, key, round(weight + coalesce(more, 0) * 0.05e0, 6) as weight from k left join m using (frame_idx, rank) where rank <= 40"""


def _fixed(s, d):
    from ..operators import quantize as Q

    return s.createDataFrame([(name, i, *map(int, c)) for name in ("websafe", "grayscale", "mono") for i, c in enumerate(Q.FIXED[name](None, None, 6))], "name string, idx int, pr int, pg int, pb int")


QUERIES["fixed_quantizers"] = _fixed
ORACLES["fixed_quantizers"] = """with s as (select unnest([0, 51, 102, 153, 204, 255]) as v), c as (select r.v as pr, g.v as pg, b.v as pb from s r, s g, s b)
select 'websafe' as name, cast(row_number() over (order by 0.2126e0 * pr + 0.7152e0 * pg + 0.0722e0 * pb, pr, pg, pb) - 1 as integer) as idx, pr, pg, pb from c
union all select 'grayscale', cast(i as integer), cast(i * 51 as integer), cast(i * 51 as integer), cast(i * 51 as integer) from range(6) t(i) union all select 'mono', cast(i as integer), cast(i * 255 as integer), cast(i * 255 as integer), cast(i * 255 as integer) from range(2) t(i)"""
QUERIES["named_palettes"] = lambda s, d: s.createDataFrame([(n, len(P.named_palette(n)), min(min(c) for c in P.named_palette(n)), max(max(c) for c in P.named_palette(n))) for n in P.PALETTES], "name string, colors int, low int, high int")
ORACLES["named_palettes"] = """select * from (values ('websafe', 216, 0, 255), ('mac', 216, 0, 255), ('win', 214, 0, 255), ('grayscale', 64, 0, 255), ('mono', 2, 0, 255), ('mono2', 2, 0, 255), ('uniform', 64, 0, 255), ('pastel', 16, 40, 223),
('gameboy', 4, 18, 222), ('gameboy-pocket', 4, 49, 223), ('cga16', 15, 0, 255), ('pico8', 15, 0, 222), ('nes', 39, 0, 252), ('c64', 18, 0, 255), ('amstrad', 28, 0, 255), ('zx', 32, 0, 255)) t(name, colors, low, high)"""
QUERIES["dither_kinds"] = lambda s, d: s.createDataFrame([(n, P.is_ordered(n)) for n in ("bayer2", "bayer4", "bayer8", "bayer16", "clustered4", "bluenoise8", "floyd-steinberg", "atkinson", "none")], "name string, ordered boolean")
ORACLES["dither_kinds"] = "select * from (values ('bayer2', true), ('bayer4', true), ('bayer8', true), ('bayer16', true), ('clustered4', true), ('bluenoise8', true), ('floyd-steinberg', false), ('atkinson', false), ('none', false)) t(name, ordered)"

# --- bytes ---

QUERIES["hashes"] = lambda s, d: table(s, d, "customer").select("c_custkey", N.crc32(F.encode("c_name", "UTF-8")).alias("crc"), F.octet_length("c_name").alias("n"), (N.frame_signature(F.encode("c_name", "UTF-8")) == N.frame_signature(F.encode(F.concat("c_name", F.lit("")), "UTF-8"))).alias("same"), (N.frame_signature(F.encode("c_name", "UTF-8"), 1) == N.frame_signature(F.encode(F.concat("c_name", F.lit("x")), "UTF-8"), 1)).alias("confused"))
# the check sum's law, bit by bit: x ** 32 + ... over two, reflected
_CRC = "list_reduce(list_prepend(4294967295::bigint, [('0x' || v)::bigint for v in regexp_extract_all(hex(encode(c_name)), '..')]), lambda c, v: list_reduce(list_prepend(xor(c, v), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"
ORACLES["hashes"] = f"select c_custkey, xor({_CRC}, 4294967295) as crc, cast(strlen(c_name) as integer) as n, true as same, false as confused from customer"
_XX = {"": 0x02CC5D05, "a": 0x550D7456, "abc": 0x32D153FF, "Nobody inspects the spammish repetition": 0xE2293B2F}
QUERIES["xxhash32"] = lambda s, d: s.createDataFrame([(t, bytearray(t.encode())) for t in _XX], "text string, data binary").select("text", N.xxhash32(F.col("data")).alias("hash"))
ORACLES["xxhash32"] = "select * from (values " + ", ".join(f"('{t}', {h}::bigint)" for t, h in _XX.items()) + ") t(text, hash)"
QUERIES["human_sizes"] = lambda s, d: table(s, d, "orders").select("o_orderkey", N.bytes_to_human(F.col("o_orderkey") * F.col("o_custkey")).alias("human"), N.parse_aspect(F.concat((F.col("o_custkey") % 20 + 1).cast("string"), F.element_at(F.array(F.lit(":"), F.lit("x"), F.lit("/")), (F.col("o_orderkey") % 3 + 1).cast("int")), (F.col("o_orderkey") % 9 + 1).cast("string"))).alias("aspect"))
ORACLES["human_sizes"] = """with n as (select *, o_orderkey * o_custkey as n from orders) select o_orderkey, case when n < 1024 then n || ' B' when n < 10240 then printf('%.1f KiB', floor(n / 1024e0 * 10 + 0.5e0) / 10) when n < 1048576 then printf('%.0f KiB', floor(n / 1024e0 + 0.5e0)) else printf('%.2f MiB', floor(n / 1048576e0 * 100 + 0.5e0) / 100) end as human,
  (o_custkey % 20 + 1) / cast(o_orderkey % 9 + 1 as double) as aspect from n"""

# --- plans ---

_SIZES = [(w, h, a, b) for w, h in ((640, 480), (300, 500), (16, 16)) for a, b in ((320, 320), (100, 400), (640, 100))]
QUERIES["size_plans"] = lambda s, d: s.createDataFrame(
    [(m, *q, *S.fit_plan(*q, m).values()) for m in ("contain", "cover", "fill", "width", "height") for q in _SIZES], "mode string, sw int, sh int, dw int, dh int, w int, h int, x int, y int"
)
ORACLES["size_plans"] = f"""with q as (select * from (values {', '.join(map(str, _SIZES))}) t(sw, sh, dw, dh)), m as (select unnest(['contain', 'cover', 'fill', 'width', 'height']) as mode),
k as (select *, dw / sw::double as kx, dh / sh::double as ky from q, m), z as (select *, case mode when 'contain' then least(kx, ky) when 'cover' then greatest(kx, ky) when 'width' then kx else ky end as z from k),
o as (select mode, sw, sh, dw, dh, case when mode = 'fill' then dw else cast(greatest(1, floor(sw * z + 0.5e0)) as integer) end as w, case when mode = 'fill' then dh else cast(greatest(1, floor(sh * z + 0.5e0)) as integer) end as h from z)
select *, cast(floor((dw - w) / 2e0) as integer) as x, cast(floor((dh - h) / 2e0) as integer) as y from o"""
QUERIES["solved_sizes"] = lambda s, d: s.createDataFrame([(i, *S.solve_size(*q)) for i, q in enumerate(_SOLVE)] , "id int, w int, h int")
_SOLVE = [(640, 480, 320, None), (640, 480, None, 240), (640, 480, 100, 100), (300, 500, None, None), (8000, 4000, None, None), (640, 480, 333, None, 4096, 2)]
ORACLES["solved_sizes"] = "select * from (values (0, 320, 240), (1, 320, 240), (2, 100, 100), (3, 300, 500), (4, 4096, 2048), (5, 334, 250)) t(id, w, h)"
QUERIES["aspect_windows"] = lambda s, d: s.createDataFrame([(w, h, a, *S.aspect_crop(w, h, a)) for w, h in ((640, 480), (300, 500)) for a in (1.0, 1.7777777777777777, 0.5)], "sw int, sh int, aspect double, x int, y int, w int, h int")
ORACLES["aspect_windows"] = """with q as (select sw, sh, a as aspect from (values (640, 480), (300, 500)) t(sw, sh), (values (1e0), (1.7777777777777777e0), (0.5e0)) u(a)),
z as (select *, case when sw / sh::double < aspect then sw else cast(floor(sh * aspect + 0.5e0) as integer) end as w, case when sw / sh::double < aspect then cast(floor(sw / aspect + 0.5e0) as integer) else sh end as h from q)
select sw, sh, aspect, (sw - w) // 2 as x, (sh - h) // 2 as y, w, h from z"""
QUERIES["lzw_bounds"] = lambda s, d: s.createDataFrame([(n, lzw.max_bytes(n)) for n in (0, 1, 254, 255, 256, 65536, 1_000_000)], "pixels bigint, most bigint")
ORACLES["lzw_bounds"] = "with q as (select p::bigint as pixels, p + 2 + cast(ceil(p / 255e0) as bigint) + 1 as codes from (values (0), (1), (254), (255), (256), (65536), (1000000)) t(p)) select pixels, cast(ceil(codes * 12 / 8e0) + ceil(codes / 255e0) + 64 as bigint) as most from q"
QUERIES["prior_model"] = lambda s, d: M.prior(s)
ORACLES["prior_model"] = "select 1.183e0 as c, -0.344e0 as a, 0::bigint as points"


def _candidates(s, d):
    f = M.index_stats(_pixels_as_streams(s, d))
    return f.select((F.col("clip_id") % 5).alias("clip_id"), "pixels", "h0", "h1", "distinct_idx", (F.col("clip_id") % 2 == 0).alias("local"), F.floor(F.col("pixels") * F.col("h0") / 8).alias("real"))


_PRED16 = """floor(greatest(pixels / 22e0, pixels * least(greatest(-0.344e0 + 0.348e0 * least(greatest(h0, 0e0), 8.6e0) + 1.183e0 * least(greatest(h1, 0e0), 8.6e0), 0.045e0), 8.6e0) / 8e0
  + case when pixels > 4096 - 16 - 2 then pixels / cast(4096 - 16 - 2 as double) * (9 / 8e0 + 30) else 0e0 end) + 0.5e0)"""
_CAND = f", cd as (select clip_id % 5 as clip_id, pixels, h0, h1, distinct_idx, clip_id % 2 = 0 as local, cast({{lzw}} as bigint) as lzw from st), fz as (select *, 20 + case when local then 48 else 0 end + cast(ceil(lzw / 255e0) as bigint) + 1 as framing from cd) select clip_id, cast(sum(framing + lzw) + 81 as bigint) as bytes, count(*) as frames, cast(sum(lzw) as bigint) as payload_bytes, 81 as header_bytes, cast(sum(framing) as bigint) as framing_bytes, {{model}} as model_only from fz group by clip_id"
QUERIES["predict_candidate"] = lambda s, d: M.predict_candidate(_candidates(s, d), 16)
ORACLES["predict_candidate"] = f"with {PX_SQL}{_STATS}" + _CAND.format(lzw=_PRED16, model="true")
QUERIES["measured_candidate"] = lambda s, d: M.predict_candidate(_candidates(s, d), 16, "real")
ORACLES["measured_candidate"] = f"with {PX_SQL}{_STATS}" + _CAND.format(lzw="floor(pixels * h0 / 8)", model="false")
QUERIES["measure_gif"] = lambda s, d: M.measure_gif(_candidates(s, d), 16)
ORACLES["measure_gif"] = f"with {PX_SQL}{_STATS} select clip_id % 5 as clip_id, cast(sum(18 + pixels + ceil(pixels / 255e0) + 1 + case when clip_id % 2 = 0 then 3 * distinct_idx else 0 end) + 81 as bigint) as bytes from st group by 1"

# --- facts of stills, from headers that are made of the nations ---


def _png(i: int) -> bytes:
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 10 + i, 20 + i, 8, (2, 6, 3)[i % 3], 0, 0, 0)) + (part(b"acTL", struct.pack(">II", i + 1, 0)) if i % 2 else b"") + (part(b"tRNS", b"\0") if i % 3 == 2 else b"") + part(b"IEND", b"")


def _jpeg(i: int) -> bytes:
    tiff = (b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x112, 3, 1, i % 8 + 1)) if i % 2 else (b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 1) + struct.pack(">HHIHH", 0x112, 3, 1, i % 8 + 1, 0))
    exif = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 20 + i, 10 + i, 3) + bytes(9) + b"\xff\xd9"


def _webp(i: int) -> bytes:
    head = bytes([0x10 if i % 2 else 0, 0, 0, 0]) + (9 + i).to_bytes(3, "little") + (19 + i).to_bytes(3, "little")
    return mux.riff("WEBP", mux.chunk("VP8X", head), *(mux.chunk("ANMF", bytes(16)) for _ in range(i % 4)))


def _bmp(i: int) -> bytes:
    return b"BM" + bytes(16) + struct.pack("<iiHH", 10 + i, -(20 + i), 1, 32 if i % 2 else 24) + bytes(24)


def _stills(s, d):
    rows = [(r["n_nationkey"] * 4 + k, bytearray(make(r["n_nationkey"]))) for r in table(s, d, "nation").select("n_nationkey").collect() for k, make in enumerate((_png, _jpeg, _webp, _bmp))]  # 25 nations
    return stills.summaries(s.createDataFrame(rows, "path bigint, content binary"))


QUERIES["still_facts"] = _stills
ORACLES["still_facts"] = """with q as (select n_nationkey as i, k from nation, range(4) t(k)) select i * 4 + k as path, ['png', 'jpeg', 'webp', 'bmp'][k + 1] as format, 10 + i as width, 20 + i as height,
  case k when 0 then case when i % 2 = 1 then i + 1 else 1 end when 2 then greatest(1, i % 4) else 1 end as frames, case k when 0 then i % 3 > 0 when 1 then false else i % 2 = 1 end as has_alpha,
  case when k = 1 then i % 8 + 1 end as orientation, cast(null as varchar) as error from q"""
