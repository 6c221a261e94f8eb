"""Queries of the pointwise filters over all pixels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import pointwise as P
from ..plans.bridge import PX_SQL, pixels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

Y = "(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b)"


def _b(x: str) -> str:
    """Clamped and truncated."""
    return f"cast(trunc(least(greatest({x}, 0e0), 255e0)) as integer)"


def _rb(x: str) -> str:
    """Rounded half up, then clamped."""
    return f"cast(least(greatest(floor({x} + 0.5e0), 0e0), 255e0) as integer)"


def _seen(x: str, c: str) -> str:
    return f"case when a = 0 then {c} else {x} end"


def _add(name: str, apply, r: str, g: str, b: str, a: str | None = None) -> None:
    out = ["frame_idx", "x", "y", "r", "g", "b"] + (["a"] if a else [])
    QUERIES[name] = lambda spark, d: apply(pixels(spark, d)).select(*out)
    ORACLES[name] = f"with {PX_SQL} select frame_idx, x, y, {r} as r, {g} as g, {b} as b{f', {a} as a' if a else ''} from px"


def _all(name: str, apply, f) -> None:
    """``f`` makes the SQL of a channel from its name."""
    _add(name, apply, f("r"), f("g"), f("b"))


GRAYS = {
    "luma": Y, "rec601": "(r * 0.299e0 + g * 0.587e0 + b * 0.114e0)", "rec2020": "(0.2627e0 * r + 0.678e0 * g + 0.0593e0 * b)",
    "average": "((r + g + b) / 3e0)", "lightness": "((greatest(r, g, b) + least(r, g, b)) / 2e0)", "max": "(greatest(r, g, b) * 1e0)",
}
for _mode, _sql in GRAYS.items():
    _all("grayscale" if _mode == "luma" else f"grayscale_{_mode}", lambda px, m=_mode: P.grayscale(px, m), lambda c, s=_sql: _seen(_rb(s), c))

_SEPIA = {"r": (0.393, 0.769, 0.189), "g": (0.349, 0.686, 0.168), "b": (0.272, 0.534, 0.131)}
_all("sepia", lambda px: P.sepia(px, 0.8), lambda c: _b(f"{c} + (r * {_SEPIA[c][0]}e0 + g * {_SEPIA[c][1]}e0 + b * {_SEPIA[c][2]}e0 - {c}) * 0.8e0"))
_add("invert", lambda px: P.invert(px, True, True), "255 - r", "255 - g", "255 - b", "255 - a")
_all("posterize", lambda px: P.posterize(px, 4), lambda c: _rb(f"(floor({c} / 85e0 + 0.5e0) * 85e0)"))
_all("threshold", lambda px: P.threshold(px, 100), lambda c: _seen(f"case when {Y} >= 100 then 255 else 0 end", c))
_all("levels", lambda px: P.levels(px, 20, 230, 1.2, 5, 250), lambda c: _rb(f"(5e0 + pow(least(greatest(({c} - 20e0) / 210e0, 0e0), 1e0), {1 / 1.2!r}) * 245e0)"))
_gain = N.contrast_gain(0.2)
_all("eq", lambda px: P.eq(px, 0.06, 0.2), lambda c: _rb(f"((({c} + {0.06 * 255!r}::double) - 127.5e0) * {_gain!r}::double + 127.5e0)"))
_all("brightness", lambda px: P.eq(px, 0.1), lambda c: _rb(f"({c} + {0.1 * 255!r}::double)"))
_all("saturate", lambda px: P.saturate(px, 1.5), lambda c: _seen(_b(f"{Y} + ({c} - {Y}) * 1.5e0"), c))
_sat = "case when greatest(r, g, b) = 0 then 0e0 else (greatest(r, g, b) - least(r, g, b)) / cast(greatest(r, g, b) as double) end"
_all("vibrance", lambda px: P.vibrance(px, 0.5), lambda c: _seen(_b(f"{Y} + ({c} - {Y}) * (1e0 + 0.5e0 * (1e0 - ({_sat})))"), c))
_TEMP = {"r": 1 + 0.22 * 0.2, "g": 1 - 0.05 * 0.2, "b": 1 - 0.22 * 0.2}
_all("temperature", lambda px: P.temperature(px, 20), lambda c: _rb(f"({c} * {_TEMP[c]!r}::double)"))
_TINT = {"r": 43 * 0.35, "g": 58 * 0.35, "b": 85 * 0.35}
_all("tint", lambda px: P.tint(px, "#2b3a55"), lambda c: _b(f"{c} * {1 - 0.35!r}::double + {_TINT[c]!r}::double"))
_COS, _SIN = math.cos(math.radians(40)), math.sin(math.radians(40))
_I, _Q = "(0.596e0 * r - 0.275e0 * g - 0.321e0 * b)", "(0.212e0 * r - 0.523e0 * g + 0.311e0 * b)"
_I2, _Q2 = f"({_I} * {_COS!r}::double - {_Q} * {_SIN!r}::double)", f"({_I} * {_SIN!r}::double + {_Q} * {_COS!r}::double)"
_YIQ = {"r": f"+ {_I2} * 0.956e0 + {_Q2} * 0.621e0", "g": f"- {_I2} * 0.272e0 - {_Q2} * 0.647e0", "b": f"- {_I2} * 1.106e0 + {_Q2} * 1.703e0"}
_all("hue_rotate", lambda px: P.hue(px, 40), lambda c: _seen(_b(f"(0.299e0 * r + 0.587e0 * g + 0.114e0 * b) {_YIQ[c]}"), c))
_D = "((r - 185) * (r - 185) + (g - 40) * (g - 40) + (b - 145) * (b - 145))"
_add("chroma_key", lambda px: P.chroma_key(px, (185, 40, 145)), "r", "g", "b",
     f"case when {_D} <= 3600 then 0 when {_D} <= 6000 then {_b(f'a * ({_D} - 3600e0) / 2400e0')} else a end")
_add("premultiply", lambda px: P.premultiply(px, "#102030"), *(f"case when a = 255 then {c} else {_b(f'{c} * (a / 255e0) + {k} * (1e0 - a / 255e0)')} end" for c, k in zip("rgb", (16, 32, 48), strict=True)), "255")
_add("defringe", lambda px: P.defringe(px, 250), *(f"case when a <> 0 and a < 250 then {_b(f'{c} * (255e0 / a)')} else {c} end" for c in "rgb"), "case when a >= 250 then 255 else a end")
_add("alpha_threshold", lambda px: P.alpha_threshold(px, 100), "r", "g", "b", "case when a >= 100 then 255 else 0 end")
_CURVE = P.curve_lut(P.CURVES["film"])
_all("curves", lambda px: P.curves(px, preset="film"), lambda c: f"([{', '.join(map(str, _CURVE))}])[{c} + 1]")
_lin = lambda c: f"(case when {c} / 255e0 <= 0.04045e0 then {c} / 255e0 / 12.92e0 else pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end)"
_exp = lambda c: f"least(greatest({_lin(c)} * {2**0.5!r}::double, 0e0), 1e0)"
_all("exposure", lambda px: P.exposure(px, 0.5), lambda c: _rb(f"((case when {_exp(c)} <= 0.0031308e0 then {_exp(c)} * 12.92e0 else pow({_exp(c)}, {1 / 2.4!r}::double) * 1.055e0 - 0.055e0 end) * 255)"))
_add("css_filter", lambda px: P.css(px, "brightness(120%) invert(25%) opacity(0.5)"),
     *(_rb(f"({_rb(f'({c} * 1.2e0)')} + (255 - {_rb(f'({c} * 1.2e0)')} * 2) * 0.25e0)") for c in "rgb"), _b("a * 0.5e0"))
_add("fade", lambda px: P.fade(px, F.least(F.lit(1.0), F.col("frame_idx") / 20.0)), "r", "g", "b", _b("a * least(1e0, frame_idx / 20e0)"))


# each preset written out: its steps in order, (kind, numbers)
_PRESETS = {
    "none": [], "punch": [("eq", 0.01, 0.18), ("sat", 1.18)], "clean": [("eq", 0.02, 0.06), ("sat", 1.06)], "faded": [("eq", 0.05, -0.12), ("sat", 0.86)],
    "cinematic": [("eq", -0.02, 0.12), ("sat", 0.94), ("tint", 43, 58, 85, 0.1)], "mono": [("sat", 0)], "noir": [("eq", -0.04, 0.34), ("sat", 0)],
    "vintage": [("sepia", 0.35), ("temp", 12), ("eq", 0, -0.05), ("sat", 0.86)], "warm": [("temp", 18)], "cool": [("temp", -18)], "vivid": [("eq", 0, 0.12), ("sat", 1.4)],
    "pastel": [("eq", 0.08, -0.06), ("sat", 0.72)], "highkey": [("eq", 0.16, 0.05)], "lowkey": [("eq", -0.14, 0.16)],
}


def _tone_sql(steps: list[tuple]) -> str:
    made = "select frame_idx, x, y, r, g, b, a from px"
    for kind, *v in steps:
        if kind == "eq":
            part = {c: _rb(f"((({c} + {v[0] * 255!r}::double) - 127.5e0) * {math.tan((v[1] + 1) * math.pi / 4)!r}::double + 127.5e0)") for c in "rgb"}
        elif kind == "sat":
            part = {c: _seen(_b(f"{Y} + ({c} - {Y}) * {float(v[0])!r}::double"), c) for c in "rgb"}
        elif kind == "sepia":
            part = {c: _b(f"{c} + (r * {_SEPIA[c][0]}e0 + g * {_SEPIA[c][1]}e0 + b * {_SEPIA[c][2]}e0 - {c}) * {v[0]!r}::double") for c in "rgb"}
        elif kind == "temp":
            t = v[0] / 100
            part = {c: _rb(f"({c} * {k!r}::double)") for c, k in zip("rgb", (1 + 0.22 * t, 1 - 0.05 * abs(t), 1 - 0.22 * t), strict=True)}
        else:
            part = {c: _b(f"{c} * {1 - v[3]!r}::double + {k * v[3]!r}::double") for c, k in zip("rgb", v, strict=False)}
        made = f"select frame_idx, x, y, {', '.join(f'{e} as {c}' for c, e in part.items())}, a from ({made})"
    return made


QUERIES["tone_preset"] = lambda spark, d: reduce(
    DataFrame.unionByName, [P.tone(pixels(spark, d), t).select(F.lit(t).alias("tone"), "frame_idx", "x", "y", "r", "g", "b") for t in _PRESETS]
)
ORACLES["tone_preset"] = f"with {PX_SQL} " + " union all ".join(f"select '{t}' as tone, frame_idx, x, y, r, g, b from ({_tone_sql(steps)})" for t, steps in _PRESETS.items())


def _colors(px):
    h, s, v = N.hsl(F.col("r"), F.col("g"), F.col("b"))
    hv, sv, vv = N.hsv(F.col("r"), F.col("g"), F.col("b"))
    return px.select(
        "frame_idx", "x", "y", *(F.round(c, 6).alias(n) for c, n in ((h, "h"), (s, "s"), (v, "l"), (hv, "hv"), (sv, "sv"), (vv, "v"))),
        N.key555(F.col("r"), F.col("g"), F.col("b")).alias("k555"), N.pack_rgba(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("packed"),
        N.hex_color(F.col("r"), F.col("g"), F.col("b")).alias("hex"),
    )


_HUE = """case when greatest(r, g, b) = least(r, g, b) then 0e0
  when greatest(r, g, b) = r then ((g - b) / cast(greatest(r, g, b) - least(r, g, b) as double) + case when g < b then 6 else 0 end) / 6
  when greatest(r, g, b) = g then ((b - r) / cast(greatest(r, g, b) - least(r, g, b) as double) + 2) / 6
  else ((r - g) / cast(greatest(r, g, b) - least(r, g, b) as double) + 4) / 6 end"""
QUERIES["color_spaces"] = lambda spark, d: _colors(pixels(spark, d))
ORACLES["color_spaces"] = f"""with {PX_SQL}, m as (select *, greatest(r, g, b) / 255e0 as hi, least(r, g, b) / 255e0 as lo from px)
select frame_idx, x, y, round({_HUE}, 6) as h,
  round(case when hi = lo then 0e0 when (hi + lo) / 2 > 0.5e0 then (hi - lo) / (2e0 - hi - lo) else (hi - lo) / (hi + lo) end, 6) as s, round((hi + lo) / 2, 6) as l,
  round({_HUE}, 6) as hv, round(case when greatest(r, g, b) = 0 then 0e0 else (greatest(r, g, b) - least(r, g, b)) / cast(greatest(r, g, b) as double) end, 6) as sv,
  round(greatest(r, g, b) / 255e0, 6) as v, ((b >> 3) << 10) | ((g >> 3) << 5) | (r >> 3) as k555,
  r::bigint | (g::bigint << 8) | (b::bigint << 16) | (a::bigint << 24) as packed, printf('#%02x%02x%02x', r, g, b) as hex
from m"""


def _oklab(px):
    l, a, b = N.oklab(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    return px.groupBy("frame_idx").agg(F.round(F.avg(l), 6).alias("l"), F.round(F.avg(a), 6).alias("ok_a"), F.round(F.avg(b), 6).alias("ok_b"))


_lms = [f"cbrt({w[0]}e0 * {_lin('r')} + {w[1]}e0 * {_lin('g')} + {w[2]}e0 * {_lin('b')})" for w in N._LMS]
_lab = [f"avg({w[0]!r}::double * l1 + {w[1]!r}::double * m1 + {w[2]!r}::double * s1)" for w in N._LAB]
QUERIES["oklab_mean"] = lambda spark, d: _oklab(pixels(spark, d))
ORACLES["oklab_mean"] = f"""with {PX_SQL}, q as (select frame_idx, {_lms[0]} as l1, {_lms[1]} as m1, {_lms[2]} as s1 from px)
select frame_idx, round({_lab[0]}, 6) as l, round({_lab[1]}, 6) as ok_a, round({_lab[2]}, 6) as ok_b from q group by frame_idx"""
