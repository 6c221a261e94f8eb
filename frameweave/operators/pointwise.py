"""Colour and tone filters: each turns a pixel's channels into new ones, so Catalyst fuses whole chains into one project.

A filter takes a frame of pixels (columns ``r``, ``g``, ``b`` and, if alpha matters, ``a``) and returns it with these
columns replaced; all others pass through. Pixels with alpha 0 are left as they are where the filter says so.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import byte, clamp, col, contrast_gain, from_linear, luma601, luma709, luma2020, parse_color, round_half_up, rounded_byte, to_linear

def _seen(df: DataFrame, **channels: Column) -> DataFrame:
    """Replace channels where alpha isn't 0, if the frame has alpha."""
    if "a" in df.columns:
        channels = {k: F.when(F.col("a") == 0, F.col(k)).otherwise(v) for k, v in channels.items()}
    return df.withColumns(channels)


def _each(df: DataFrame, f) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in "rgb"})


def lut(values: list[int], x: Column) -> Column:
    """A 256-entry table as a literal array."""
    return F.element_at(F.array(*map(F.lit, values)), x + 1)


def curve_lut(points: list[tuple[float, float]]) -> list[int]:
    """Monotone cubic (Fritsch-Carlson) through control points, sampled at 0..255."""
    pts = sorted(points)
    if len(pts) == 1:
        return [int(max(0, min(255, math.floor(pts[0][1] + 0.5))))] * 256
    width = [(b[0] - a[0]) or 1e-6 for a, b in zip(pts, pts[1:], strict=False)]
    slope = [(b[1] - a[1]) / w for a, b, w in zip(pts, pts[1:], width, strict=False)]
    tangent = [slope[0]]
    for (w0, w1), (s0, s1) in zip(zip(width, width[1:], strict=False), zip(slope, slope[1:], strict=False), strict=True):
        u, v = 2 * w1 + w0, w1 + 2 * w0
        tangent.append(0.0 if s0 * s1 <= 0 else (u + v) * s0 * s1 / (v * s0 + u * s1))
    tangent.append(slope[-1])
    out = []
    for x in range(256):
        if x <= pts[0][0]:
            y = pts[0][1] + tangent[0] * (x - pts[0][0])
        elif x >= pts[-1][0]:
            y = pts[-1][1] + tangent[-1] * (x - pts[-1][0])
        else:
            k = max(i for i, p in enumerate(pts[:-1]) if p[0] <= x)
            t = (x - pts[k][0]) / width[k]
            blend = t * t * (3 - 2 * t)
            y = (1 - blend) * pts[k][1] + blend * pts[k + 1][1] + width[k] * t * (1 - t) * ((1 - t) * tangent[k] - t * tangent[k + 1])
        out.append(int(max(0, min(255, math.floor(y + 0.5)))))
    return out


def gamma_lut(gamma: float) -> list[int]:
    return [int(max(0, min(255, math.floor(255 * (i / 255) ** (1 / max(0.01, gamma)) + 0.5)))) for i in range(256)]


def compose_luts(*luts: list[int]) -> list[int]:
    """One table for several that are applied one after the other."""
    out = list(range(256))
    for table in luts:
        out = [table[v] for v in out]
    return out


def apply_lut(df: DataFrame, values: list[int], channels: str = "rgb") -> DataFrame:
    return df.withColumns({c: lut(values, F.col(c)) for c in channels})


def clear_alpha(df: DataFrame) -> DataFrame:
    """Everything transparent."""
    return df.withColumn("a", F.lit(0))


def detect_alpha(df: DataFrame, step: int = 1, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Whether any of every ``step``-th pixel of a row of frames is not opaque."""
    seen = df.where(F.col("x") % step == 0) if step > 1 else df
    return seen.groupBy(*keys).agg(F.bool_or(F.col("a") < 255).alias("has_alpha"))


#: Named curves and tones.
CURVES = {
    "rgb": [(0, 0), (255, 255)], "contrast": [(0, 0), (64, 48), (192, 208), (255, 255)], "soft": [(0, 12), (64, 60), (192, 196), (255, 244)],
    "film": [(0, 18), (48, 44), (208, 212), (255, 238)], "pop": [(0, 0), (96, 68), (160, 200), (255, 255)], "fade": [(0, 26), (255, 232)],
    "bleach": [(0, 34), (96, 92), (192, 204), (255, 255)], "night": [(0, 0), (64, 40), (160, 150), (224, 214), (255, 250)],
}
TONES = {
    "none": {}, "punch": {"contrast": 0.18, "saturation": 1.18, "brightness": 0.01}, "clean": {"brightness": 0.02, "contrast": 0.06, "saturation": 1.06},
    "faded": {"contrast": -0.12, "saturation": 0.86, "brightness": 0.05},
    "cinematic": {"contrast": 0.12, "saturation": 0.94, "tint": "#2b3a55", "tint_amount": 0.1, "brightness": -0.02},
    "mono": {"saturation": 0}, "noir": {"contrast": 0.34, "saturation": 0, "brightness": -0.04},
    "vintage": {"sepia": 0.35, "contrast": -0.05, "saturation": 0.86, "temperature": 12}, "warm": {"temperature": 18}, "cool": {"temperature": -18},
    "vivid": {"saturation": 1.4, "contrast": 0.12}, "pastel": {"saturation": 0.72, "brightness": 0.08, "contrast": -0.06},
    "highkey": {"brightness": 0.16, "contrast": 0.05}, "lowkey": {"brightness": -0.14, "contrast": 0.16},
}


def eq(df: DataFrame, brightness: float = 0.0, contrast: float = 0.0, gamma: float = 1.0, pivot: float = 0.5) -> DataFrame:
    if not brightness and not contrast and gamma == 1:
        return df
    mid = pivot * 255

    def f(v: Column) -> Column:
        v = v + F.lit(brightness * 255)
        if contrast:
            v = (v - F.lit(mid)) * F.lit(contrast_gain(contrast)) + F.lit(mid)
        if gamma != 1:
            v = F.when(v > 0, F.pow(v / 255, F.lit(1 / gamma)) * 255).otherwise(v)
        return rounded_byte(v)

    return _each(df, f)


def saturate(df: DataFrame, amount: float = 1.0) -> DataFrame:
    if amount == 1:
        return df
    y = luma709(F.col("r"), F.col("g"), F.col("b"))
    return _seen(df, **{c: byte(y + (F.col(c) - y) * F.lit(float(amount))) for c in "rgb"})


def hue(df: DataFrame, degrees: float = 0.0) -> DataFrame:
    if not degrees:
        return df
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    y = F.lit(0.299) * F.col("r") + F.lit(0.587) * F.col("g") + F.lit(0.114) * F.col("b")
    i = F.lit(0.596) * F.col("r") - F.lit(0.275) * F.col("g") - F.lit(0.321) * F.col("b")
    q = F.lit(0.212) * F.col("r") - F.lit(0.523) * F.col("g") + F.lit(0.311) * F.col("b")
    i2, q2 = i * cos - q * sin, i * sin + q * cos
    return _seen(df, r=byte(y + i2 * 0.956 + q2 * 0.621), g=byte(y - i2 * 0.272 - q2 * 0.647), b=byte(y - i2 * 1.106 + q2 * 1.703))


def levels(df: DataFrame, in_black: float = 0, in_white: float = 255, gamma: float = 1, out_black: float = 0, out_white: float = 255, channel: str | None = None) -> DataFrame:
    span = max(1.0, float(in_white - in_black))

    def f(v: Column) -> Column:
        t = clamp((v - F.lit(float(in_black))) / F.lit(span), 0.0, 1.0)
        t = F.pow(t, F.lit(1 / gamma if gamma > 0 else 1.0))
        return rounded_byte(F.lit(float(out_black)) + t * F.lit(float(out_white - out_black)))

    return _each(df, f) if channel is None else df.withColumn(channel, f(F.col(channel)))


def curves(df: DataFrame, points: list[tuple[float, float]] | None = None, preset: str = "contrast", channel: str | None = None) -> DataFrame:
    values = curve_lut(points or CURVES[preset])
    return _each(df, lambda v: lut(values, v)) if channel is None else df.withColumn(channel, lut(values, F.col(channel)))


def sepia(df: DataFrame, amount: float = 1.0) -> DataFrame:
    k = min(1.0, max(0.0, amount))
    rows = {"r": (0.393, 0.769, 0.189), "g": (0.349, 0.686, 0.168), "b": (0.272, 0.534, 0.131)}
    return df.withColumns({c: byte(F.col(c) + (F.col("r") * w[0] + F.col("g") * w[1] + F.col("b") * w[2] - F.col(c)) * F.lit(k)) for c, w in rows.items()})


GRAY_MODES = {
    "luma": luma709, "rec601": lambda r, g, b: r * 0.299 + g * 0.587 + b * 0.114, "rec2020": luma2020, "average": lambda r, g, b: (r + g + b) / 3.0,
    "lightness": lambda r, g, b: (F.greatest(r, g, b) + F.least(r, g, b)) / 2.0, "max": lambda r, g, b: F.greatest(r, g, b).cast("double"),
}


def grayscale(df: DataFrame, mode: str = "luma") -> DataFrame:
    v = rounded_byte(GRAY_MODES[mode](F.col("r"), F.col("g"), F.col("b")))
    return _seen(df, r=v, g=v, b=v)


def invert(df: DataFrame, rgb: bool = True, alpha: bool = False) -> DataFrame:
    names = ("rgb" if rgb else "") + ("a" if alpha else "")
    return df.withColumns({c: F.lit(255) - F.col(c) for c in names})


def posterize(df: DataFrame, levels: int = 4) -> DataFrame:
    step = 255 / (max(2, min(256, int(levels))) - 1)
    return _each(df, lambda v: rounded_byte(round_half_up(v / F.lit(step)) * F.lit(step)))


def threshold(df: DataFrame, t: float = 128, low: int = 0, high: int = 255) -> DataFrame:
    v = F.when(luma709(F.col("r"), F.col("g"), F.col("b")) >= float(t), high).otherwise(low)
    return _seen(df, r=v, g=v, b=v)


def exposure(df: DataFrame, stops: float = 1.0) -> DataFrame:
    """Linear light times 2 ** stops."""
    return _each(df, lambda v: from_linear(to_linear(v) * F.lit(2.0**stops)))


def temperature(df: DataFrame, amount: float = 20) -> DataFrame:
    t = max(-100, min(100, amount)) / 100
    gain = {"r": 1 + 0.22 * t, "g": 1 - 0.05 * abs(t), "b": 1 - 0.22 * t}
    return df.withColumns({c: rounded_byte(F.col(c) * F.lit(k)) for c, k in gain.items()})


def tint(df: DataFrame, color: str | tuple | None = None, amount: float = 0.35, gains: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """Towards a colour, or each channel times its gain."""
    if color is not None:
        to = parse_color(color)
        return df.withColumns({c: byte(F.col(c) * F.lit(1 - amount) + F.lit(to[k] * amount)) for k, c in enumerate("rgb")})
    return df.withColumns({c: rounded_byte(F.col(c) * F.lit(float(k))) for c, k in zip("rgb", gains, strict=True) if k != 1})


def vibrance(df: DataFrame, amount: float = 0.5) -> DataFrame:
    k = max(-1.0, min(1.0, amount))
    top, low = F.greatest(F.col("r"), F.col("g"), F.col("b")), F.least(F.col("r"), F.col("g"), F.col("b"))
    sat = F.when(top == 0, F.lit(0.0)).otherwise((top - low) / top)
    boost = F.lit(1.0) + F.lit(k) * (F.lit(1.0) - sat)
    y = luma709(F.col("r"), F.col("g"), F.col("b"))
    return _seen(df, **{c: byte(y + (F.col(c) - y) * boost) for c in "rgb"})


def chroma_key(df: DataFrame, color: str | tuple = "#00ff00", tolerance: float = 3600, feather: float = 2400, despill: float = 0.0, key: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """Alpha 0 within ``tolerance`` (squared distance) of the key colour, a ramp over ``feather`` beyond it."""
    kr, kg, kb = key or tuple(F.lit(v) for v in parse_color(color)[:3])
    dist = (F.col("r") - kr) * (F.col("r") - kr) + (F.col("g") - kg) * (F.col("g") - kg) + (F.col("b") - kb) * (F.col("b") - kb)
    alpha = F.when(dist <= tolerance, 0)
    if feather > 0:
        alpha = alpha.when(dist <= tolerance + feather, byte(F.col("a") * (dist - F.lit(float(tolerance))) / F.lit(float(feather))))
    out = {"a": alpha.otherwise(F.col("a"))}
    if despill:
        green = (kg > F.greatest(kr, kb)) & (dist > tolerance)
        out["g"] = F.when(green, byte(F.col("g") - (F.col("g") - F.greatest(F.col("r"), F.col("b"))) * F.lit(float(despill)))).otherwise(F.col("g"))
    return df.withColumns(out)


def premultiply(df: DataFrame, background: str | tuple | None = None) -> DataFrame:
    """Flatten alpha onto a colour, or black."""
    to = parse_color(background) if background is not None else (0, 0, 0, 255)
    f = F.col("a") / 255.0
    flat = {c: F.when(F.col("a") == 255, F.col(c)).otherwise(byte(F.col(c) * f + F.lit(to[k]) * (F.lit(1.0) - f))) for k, c in enumerate("rgb")}
    return df.withColumns(flat | {"a": F.lit(255)})


def defringe(df: DataFrame, threshold: int = 250) -> DataFrame:
    soft = (F.col("a") != 0) & (F.col("a") < threshold)
    out = {c: F.when(soft, byte(F.col(c) * (F.lit(255.0) / F.when(soft, F.col("a"))))).otherwise(F.col(c)) for c in "rgb"}
    return df.withColumns(out | ({"a": F.when(F.col("a") >= threshold, 255).otherwise(F.col("a"))} if threshold < 255 else {}))


def alpha_threshold(df: DataFrame, v: int = 128) -> DataFrame:
    return df.withColumn("a", F.when(F.col("a") >= v, 255).otherwise(0))


def fade(df: DataFrame, alpha: Column | float, color: str | tuple | None = None) -> DataFrame:
    """Times ``alpha`` towards a colour, or of the alpha channel where no colour is given."""
    k = clamp(col(alpha), 0.0, 1.0)
    if color is None:
        return df.withColumn("a", byte(F.col("a") * k))
    to = parse_color(color)
    return df.withColumns({c: byte(F.lit(float(to[i])) + (F.col(c) - F.lit(to[i])) * k) for i, c in enumerate("rgb")})


def tone(df: DataFrame, preset: str = "punch") -> DataFrame:
    p = TONES[preset]
    if "sepia" in p:
        df = sepia(df, p["sepia"])
    if "temperature" in p:
        df = temperature(df, p["temperature"])
    df = saturate(eq(df, p.get("brightness", 0.0), p.get("contrast", 0.0)), p.get("saturation", 1.0))
    return tint(df, p["tint"], p["tint_amount"]) if "tint" in p else df


def parse_css_filter(text: str) -> list[tuple[str, float]]:
    """CSS ``filter`` functions with their number; a percentage is a hundredth."""
    out = []
    for name, arg in re.findall(r"([a-z-]+)\(([^)]*)\)", text.lower()):
        found = re.match(r"-?[\d.]+", arg.strip())
        out.append((name, float(found[0]) / (100 if "%" in arg else 1) if found else 1.0))
    return out


def css(df: DataFrame, text: str) -> DataFrame:
    """CSS filters in a fixed order: brightness, contrast, saturate, grayscale, hue, invert, sepia, opacity (not blur)."""
    v = dict(parse_css_filter(text))
    if "brightness" in v:
        df = _each(df, lambda x: rounded_byte(x * F.lit(v["brightness"])))
    if "contrast" in v:
        df = _each(df, lambda x: rounded_byte((x - 128) * F.lit(v["contrast"]) + 128))
    df = saturate(df, v.get("saturate", 1.0))
    df = saturate(df, 1 - min(1.0, v.get("grayscale", 0.0)))
    df = hue(df, v.get("hue-rotate", 0.0))
    if "invert" in v:
        df = _each(df, lambda x: rounded_byte(x + (F.lit(255) - x * 2) * F.lit(min(1.0, v["invert"]))))
    if "sepia" in v:
        df = sepia(df, v["sepia"])
    return fade(df, min(1.0, v["opacity"])) if "opacity" in v else df


__all__ = ["luma601", "alpha_threshold", "chroma_key", "css", "curve_lut", "curves", "defringe", "eq", "exposure", "fade", "gamma_lut", "grayscale", "hue", "invert", "levels", "posterize", "premultiply", "saturate", "sepia", "temperature", "threshold", "tint", "tone", "vibrance"]
