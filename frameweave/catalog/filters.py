"""Every filter of the language, by its name: the registry's result against the SQL of what the filter does."""

from __future__ import annotations

from ..plans import filtergraph as FG
from ..plans.bridge import PX_SQL, SIDE, pixels
from . import files, pixels as points, space

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RGB = ["frame_idx", "x", "y", "r", "g", "b"]
RGBA = [*RGB, "a"]


def _filter(name: str, args: str, sql: str, columns: list[str] = RGB) -> None:
    chain = f"{name}={args}" if args else name
    QUERIES[f"filter_{name}"] = lambda s, d: FG.apply(FG.Clip(pixels(s, d), SIDE, SIDE), chain).px.select(*columns)
    ORACLES[f"filter_{name}"] = sql


for _name, _args, _key in (
    ("grayscale", "", "grayscale"), ("sepia", "0.8", "sepia"), ("posterize", "4", "posterize"), ("threshold", "100", "threshold"), ("levels", "inBlack=20:inWhite=230:gamma=1.2:outBlack=5:outWhite=250", "levels"),
    ("eq", "brightness=0.06:contrast=0.2", "eq"), ("brightness", "0.1", "brightness"), ("saturate", "1.5", "saturate"), ("vibrance", "0.5", "vibrance"), ("temperature", "20", "temperature"), ("hue", "40", "hue_rotate"),
    ("curves", "preset=film", "curves"), ("exposure", "0.5", "exposure"),
):
    _filter(_name, _args, points.ORACLES[_key])
for _name, _args, _key in (
    ("css", "brightness(120%) invert(25%) opacity(0.5)", "css_filter"), ("chromakey", "color=#b92891", "chroma_key"), ("premultiply", "color=#102030", "premultiply"), ("defringe", "250", "defringe"), ("alphaThreshold", "100", "alpha_threshold"),
):
    _filter(_name, _args, points.ORACLES[_key], RGBA)
for _name, _args, _key in (
    ("crop", "8:9:3:2", "crop"), ("flip", "h=true:v=false", "flip"), ("transpose", "", "transpose"), ("rotate", "90", "rotate90"), ("pixelate", "4", "pixelate"), ("chromaSubsample", "2", "chroma_subsample"),
    ("vignette", "amount=0.75:softness=0.5", "vignette"), ("boxblur", "radius=2:steps=1", "box_blur_1pass"), ("unsharp", "size=2:amount=1.5:max=1", "unsharp"), ("denoise", "strength=6", "denoise"), ("convolve", "gaussian", "gaussian"),
    ("sharpen", "", "convolve_sharpen"), ("emboss", "", "emboss"), ("edges", "", "convolve_edge"), ("autoLevels", "", "auto_levels"),
):
    _filter(_name, _args, space.ORACLES[_key])
for _name, _args, _key in (("rounded", "radius=4", "rounded_corners"), ("border", "width=2:color=#010203", "border"), ("autokey", "", "auto_key"), ("pad", "width=20:height=18:color=#090807", "pad")):
    _filter(_name, _args, space.ORACLES[_key], RGBA)
_filter("grain", "", files.ORACLES["grain"], RGBA)
_filter("floodkey", "tolerance=9000", files.ORACLES["flood_key"], RGBA)
_filter("invert", "", f"with {PX_SQL} select frame_idx, x, y, 255 - r as r, 255 - g as g, 255 - b as b, a from px", RGBA)
_filter("tone", "noir", f"with {PX_SQL} select frame_idx, x, y, r, g, b from ({points._tone_sql(points._PRESETS['noir'])})")
_filter("contrast", "0.2", f"with {PX_SQL} select frame_idx, x, y, r, g, b from ({points._tone_sql([('eq', 0, 0.2)])})")
_filter("aspect", "1:2", f"with {PX_SQL} select frame_idx, x - 4 as x, y, r, g, b from px where x between 4 and 11")
_filter("cropdetect", "", space.ORACLES["black_bars"].replace("y < 3 then 0 else cast(greatest(r, g, b) > 24 as integer)", "false then 0 else cast(greatest(r, g, b) > 24 as integer)"), ["frame_idx", "left", "top", "right", "bottom"])
# 16 x 16 into 24 x 12, contained: 12 x 12 by nearest pixels, six columns from the left
_filter("fit", "width=24:height=12:color=#010203", f"""with {PX_SQL}, g as (select frame_idx, cast(i % 24 as integer) as x, cast(i // 24 as integer) as y from (select distinct frame_idx from px), range(288) t(i))
select g.frame_idx, g.x, g.y, coalesce(r, 1) as r, coalesce(p.g, 2) as g, coalesce(b, 3) as b from g left join px p on p.frame_idx = g.frame_idx and g.x between 6 and 17 and p.x = (g.x - 6) * 16 // 12 and p.y = g.y * 16 // 12""")  # fmt: skip
# three passes of a blur of one pixel to either side


def _blurred(passes: int, base: str) -> str:
    """Means of three along x and then y, truncated after each, as many times."""
    out = base
    for _ in range(passes):
        for v in "xy":
            other = "y" if v == "x" else "x"
            out = "select frame_idx, x, y, " + ", ".join(
                f"cast((lag({c}, 1, {c}) over w + {c} + lead({c}, 1, {c}) over w) // 3 as integer) as {c}" for c in "rgb"
            ) + f" from ({out}) window w as (partition by frame_idx, {other} order by {v})"
    return out


_filter("blur", "1", f"with {PX_SQL} {space._FULL} select b.* from ({_blurred(3, 'select * from fp')}) b join px using (frame_idx, x, y)")
QUERIES["filter_names"] = lambda s, d: s.createDataFrame([(n,) for n in FG.filters()], "name string")
ORACLES["filter_names"] = "select * from (values " + ", ".join(f"('{n.removeprefix('filter_')}')" for n in (*QUERIES, "filter_scale") if n != "filter_names") + ") t(name)"
