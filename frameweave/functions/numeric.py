"""Numbers and colours as Column expressions. Channels are 0..255, kept as integers between operators."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def round_half_up(x: Num) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(col(x) + F.lit(0.5))


def clamp(x: Num, low: Num = 0, high: Num = 255) -> Column:
    return F.least(F.greatest(col(x), col(low)), col(high))


def byte(x: Num) -> Column:
    """Clamped to 0..255, then truncated."""
    return clamp(x).cast("int")


def rounded_byte(x: Num) -> Column:
    return clamp(round_half_up(x)).cast("int")


def lerp(a: Num, b: Num, t: Num) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def luma709(r: Num, g: Num, b: Num) -> Column:
    return F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b


def luma601(r: Num, g: Num, b: Num) -> Column:
    return (F.lit(299) * r + F.lit(587) * g + F.lit(114) * b) / F.lit(1000.0)


def luma2020(r: Num, g: Num, b: Num) -> Column:
    return F.lit(0.2627) * r + F.lit(0.678) * g + F.lit(0.0593) * b


def redmean_sq(r1: Num, g1: Num, b1: Num, r2: Num, g2: Num, b2: Num) -> Column:
    """Integer redmean distance, squared; 0 for equal colours."""
    r1, g1, b1, r2, g2, b2 = (col(v).cast("int") for v in (r1, g1, b1, r2, g2, b2))
    mean = F.shiftright(r1 + r2, 1)
    dr, dg, db = r1 - r2, g1 - g2, b1 - b2
    return F.shiftright((mean + 512) * dr * dr, 8) + dg * dg * 4 + F.shiftright((F.lit(767) - mean) * db * db, 8)


def pack_rgb(r: Num, g: Num, b: Num) -> Column:
    """0xRRGGBB."""
    return F.shiftleft(col(r), 16).bitwiseOR(F.shiftleft(col(g), 8)).bitwiseOR(col(b))


def unpack_rgb(key: Num) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(col(key), s).bitwiseAND(255) for s in (16, 8, 0))


def pack_rgba(r: Num, g: Num, b: Num, a: Num) -> Column:
    """0xAABBGGRR as a bigint."""
    parts = (F.shiftleft(col(v).cast("bigint"), s) for v, s in ((r, 0), (g, 8), (b, 16), (a, 24)))
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def unpack_rgba(p: Num) -> tuple[Column, Column, Column, Column]:
    return tuple(F.shiftrightunsigned(col(p).cast("bigint"), s).bitwiseAND(255).cast("int") for s in (0, 8, 16, 24))


def key555(r: Num, g: Num, b: Num) -> Column:
    parts = (F.shiftleft(F.shiftright(col(v), 3), s) for v, s in ((b, 10), (g, 5), (r, 0)))
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def rgb_of_555(key: Num) -> tuple[Column, Column, Column]:
    five = (F.shiftright(col(key), s).bitwiseAND(31) for s in (0, 5, 10))
    return tuple(F.shiftleft(v, 3).bitwiseOR(F.shiftright(v, 2)) for v in five)


def to_linear(v: Num) -> Column:
    """sRGB byte to linear light, 0..1."""
    x = col(v) / F.lit(255.0)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def from_linear(x: Num) -> Column:
    """Linear light 0..1 to an sRGB byte."""
    x = clamp(x, 0.0, 1.0)
    return rounded_byte(F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055) * 255)


# fixed values: the OKLab matrices
_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))


def oklab(r: Num, g: Num, b: Num) -> tuple[Column, Column, Column]:
    linear = [to_linear(v) for v in (r, g, b)]
    roots = [F.cbrt(sum((v * w for v, w in zip(linear, row, strict=True)), F.lit(0.0))) for row in _LMS]
    return tuple(sum((v * w for v, w in zip(roots, row, strict=True)), F.lit(0.0)) for row in _LAB)


def oklab_key(lightness: Num, a: Num, b: Num) -> Column:
    high = clamp(F.floor(col(lightness) * 31 + 0.5), 0, 31)
    mid, low = (clamp(F.floor((col(v) + 0.4) * 78.75 + 0.5), 0, 63) for v in (a, b))
    return F.shiftleft(high.cast("int"), 12).bitwiseOR(F.shiftleft(mid.cast("int"), 6)).bitwiseOR(low.cast("int"))


def _hue(r: Column, g: Column, b: Column, top: Column, span: Column) -> Column:
    sixths = F.when(top == r, (g - b) / span + F.when(g < b, 6).otherwise(0)).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.when(span == 0, F.lit(0.0)).otherwise(sixths / 6)


def hsl(r: Num, g: Num, b: Num) -> tuple[Column, Column, Column]:
    r, g, b = (col(v) / F.lit(255.0) for v in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span, light = top - low, (top + low) / 2
    s = F.when(span == 0, F.lit(0.0)).when(light > 0.5, span / (F.lit(2.0) - top - low)).otherwise(span / (top + low))
    return _hue(r, g, b, top, span), s, light


def hsv(r: Num, g: Num, b: Num) -> tuple[Column, Column, Column]:
    r, g, b = (col(v).cast("double") for v in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return _hue(r, g, b, top, top - low), F.when(top == 0, F.lit(0.0)).otherwise((top - low) / top), top / 255


def rgb_of_hsl(h: Num, s: Num, light: Num) -> tuple[Column, Column, Column]:
    h, s, light = col(h) - F.floor(col(h)), col(s), col(light)
    q = F.when(light < 0.5, light * (s + 1)).otherwise(light + s - light * s)
    p = light * 2 - q

    def part(shift: float) -> Column:
        t = h + shift
        t = t - F.floor(t)
        wave = F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (F.lit(2 / 3) - t) * 6).otherwise(p)
        return round_half_up(F.when(s == 0, light).otherwise(wave) * 255).cast("int")

    return part(1 / 3), part(0.0), part(-1 / 3)


def contrast_gain(c: float) -> float:
    return 1.0 if c == 0 else math.tan((c + 1) * math.pi / 4)


# --- sizes, times and text forms ---


def round_up(x: Num, m: Num) -> Column:
    """Smallest multiple of ``m`` that isn't below ``x``."""
    return (F.ceil(col(x) / col(m)) * col(m)).cast("bigint")


def fixed16(v: Num) -> Column:
    """16.16 fixed point."""
    return col(v) / F.lit(65536.0)


def _scaled(n: Num, units: list[str], digits: int) -> Column:
    n = col(n).cast("double")
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" " + units[0]))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(n >= 1024.0**k, F.format_string(f"%.{digits}f {unit}", n / 1024.0**k)).otherwise(out)
    return out


def format_bytes(n: Num, digits: int = 1) -> Column:
    return _scaled(n, ["B", "KB", "MB", "GB"], digits)


def bytes_to_human(n: Num) -> Column:
    """With binary units: one decimal up to 10 KiB, none up to a MiB, then two; ``?`` for what is no number."""
    n = col(n).cast("double")
    kib = F.when(n < 10240, F.format_string("%.1f KiB", n / 1024)).otherwise(F.format_string("%.0f KiB", n / 1024))
    known = F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).when(n < 1048576, kib).otherwise(F.format_string("%.2f MiB", n / 1048576))
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), "?").otherwise(known)


def parse_bytes(text: Column) -> Column:
    """Bytes that ``1.5MB``, ``20k`` or ``300`` stand for; null if none."""
    number = F.regexp_extract(F.lower(F.trim(text)), r"^([0-9]*\.?[0-9]+)\s*(k|m|g)?i?b?$", 1)
    unit = F.regexp_extract(F.lower(F.trim(text)), r"^([0-9]*\.?[0-9]+)\s*(k|m|g)?i?b?$", 2)
    factor = F.when(unit == "k", 1024).when(unit == "m", 1024**2).when(unit == "g", 1024**3).otherwise(1)
    return F.when(number != "", round_half_up(number.cast("double") * factor).cast("bigint"))


def parse_aspect(text: Column) -> Column:
    """``16:9``, ``4x3``, ``4/3`` or a number, as a double; null if none."""
    a = F.regexp_extract(F.trim(text), r"^([0-9.]+)\s*[:x/]\s*([0-9.]+)$", 1)
    b = F.regexp_extract(F.trim(text), r"^([0-9.]+)\s*[:x/]\s*([0-9.]+)$", 2)
    return F.when(a != "", F.try_to_number(a, F.lit("999999.999999")).cast("double") / F.try_to_number(b, F.lit("999999.999999")).cast("double")).otherwise(F.trim(text).try_cast("double"))


def hex_color(r: Num, g: Num, b: Num) -> Column:
    return F.format_string("#%02x%02x%02x", col(r), col(g), col(b))


def css_color(r: Num, g: Num, b: Num, a: Num = 255) -> Column:
    return F.when(col(a) >= 255, F.format_string("rgb(%d,%d,%d)", col(r), col(g), col(b))).otherwise(
        F.format_string("rgba(%d,%d,%d,%.3f)", col(r), col(g), col(b), col(a) / 255.0)
    )


#: Colour names.
NAMED_COLORS = {
    "black": (0, 0, 0, 255), "white": (255, 255, 255, 255), "red": (255, 0, 0, 255), "green": (0, 128, 0, 255), "lime": (0, 255, 0, 255),
    "blue": (0, 0, 255, 255), "yellow": (255, 255, 0, 255), "cyan": (0, 255, 255, 255), "magenta": (255, 0, 255, 255), "transparent": (0, 0, 0, 0),
    "gray": (128, 128, 128, 255), "grey": (128, 128, 128, 255), "silver": (192, 192, 192, 255), "maroon": (128, 0, 0, 255), "olive": (128, 128, 0, 255),
    "navy": (0, 0, 128, 255), "teal": (0, 128, 128, 255), "purple": (128, 0, 128, 255), "orange": (255, 165, 0, 255), "pink": (255, 192, 203, 255),
    "gold": (255, 215, 0, 255), "coral": (255, 127, 80, 255), "skyblue": (135, 206, 235, 255), "tomato": (255, 99, 71, 255), "indigo": (75, 0, 130, 255),
}


def parse_color(text: str | tuple | list | int, default: tuple[int, int, int, int] = (0, 0, 0, 255)) -> tuple[int, int, int, int]:
    """A literal colour: a name, ``#rgb[a]``, ``#rrggbb[aa]``, ``rgb[a](...)``, ``hsl[a](...)``, 0xRRGGBB or channels."""
    import colorsys
    import re

    if isinstance(text, int):
        return (text >> 16) & 255, (text >> 8) & 255, text & 255, 255
    if not isinstance(text, str):
        return (*(int(max(0, min(255, v))) for v in text), 255)[:4] if text else default
    s = text.strip().lower()
    if s in NAMED_COLORS:
        return NAMED_COLORS[s]
    if re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", s):
        digits = s[1:] if len(s) > 5 else "".join(c + c for c in s[1:])
        return tuple(bytes.fromhex((digits + "ff")[:8]))
    found = re.fullmatch(r"(rgb|hsl)a?\(([^)]+)\)", s)
    if not found:
        return default
    parts = [p for p in re.split(r"[\s,/]+", found[2]) if p]
    if len(parts) < 3:
        return default
    number = [float(p.rstrip("%deg") or 0) for p in parts]
    alpha = 255 if len(parts) < 4 else round(number[3] * (2.55 if "%" in parts[3] else 255))
    if found[1] == "rgb":
        rgb = [int(v) for v in number[:3]]
    else:
        rgb = [math.floor(v * 255 + 0.5) for v in colorsys.hls_to_rgb(number[0] % 360 / 360, min(1, max(0, number[2] / 100)), min(1, max(0, number[1] / 100)))]
    return tuple(max(0, min(255, v)) for v in (*rgb, alpha))


def fnv1a(data: Column, seed: int = 0x811C9DC5) -> Column:
    """FNV-1a, 32 bits, of a binary column, as a bigint. Seven bytes are read as one number, and what is left one by one."""

    def step(h: Column, c: Column) -> Column:
        return (h.bitwiseXOR(c) * 0x01000193).bitwiseAND(0xFFFFFFFF)

    def number(b: Column, at: Column, n: int) -> Column:
        return F.conv(F.hex(F.substring(b, at, F.lit(n))), 16, 10).cast("bigint")

    def seven(h: Column, w: Column) -> Column:
        for shift in range(48, -1, -8):
            h = step(h, F.shiftright(w, shift).bitwiseAND(255))
        return h

    def whole(b: Column) -> Column:
        n = F.octet_length(b)
        full, none = n - n % 7, F.array().cast("array<int>")
        words = F.transform(F.when(full > 0, F.sequence(F.lit(1), full, F.lit(7))).otherwise(none), lambda i: number(b, i, 7))
        rest = F.transform(F.when(n > full, F.sequence(full + 1, n)).otherwise(none), lambda i: number(b, i, 1))
        return F.aggregate(rest, F.aggregate(words, F.lit(seed).cast("bigint"), seven), step)

    # as a lambda's variable, so that an expression given as data is not computed again for each byte
    return F.when(data.isNotNull(), F.transform(F.array(data), whole)[0])


def crc32(data: Column) -> Column:
    """CRC-32 of a binary column, as a bigint."""
    return F.crc32(data)


def xxhash32(data: Column, seed: int = 0) -> Column:
    """The canonical xxHash32 of a binary column, as a bigint; Spark itself only has the one of 64 bits. Null stays null."""
    def run(column: pa.Array) -> pa.Array:
        import xxhash

        return pa.array([None if x is None else xxhash.xxh32(x, seed=seed).intdigest() for x in column.to_pylist()], type=pa.int64())

    return F.arrow_udf(run, "bigint")(data)


def frame_signature(rgba: Column, stride: int = 97) -> Column:
    """A signature of every ``stride``-th texel (four bytes) of a picture's bytes, in hex: equal pictures have equal ones; equal
    ones have to be compared whole."""
    n = F.floor((F.octet_length(rgba) + 3) / 4)
    taken = F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>")), lambda i: F.hex(F.substring(rgba, i * 4 + 1, F.lit(4))))
    return F.lower(F.lpad(F.hex(F.xxhash64(F.array_join(taken, ""), F.octet_length(rgba))), 16, "0"))
