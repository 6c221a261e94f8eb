"""Text and marks over frames. A font is a parameter: for each character its rows of bits, all of one size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import _tinted, blit, draw_arrow, draw_line, fill_circle, fill_rect, redact, stroke_rect

Font = dict[str, list[str]]  # rows of "#" and "."

#: Digits for counters and time stamps, three by five.
DIGITS: Font = {
    c: rows.split() for c, rows in {
        "0": "### #.# #.# #.# ###", "1": ".#. ##. .#. .#. ###", "2": "### ..# ### #.. ###", "3": "### ..# ### ..# ###", "4": "#.# #.# ### ..# ..#", "5": "### #.. ### ..# ###",
        "6": "### #.. ### #.# ###", "7": "### ..# ..# ..# ..#", "8": "### #.# ### #.# ###", "9": "### #.# ### ..# ###", ":": "... .#. ... .#. ...", ".": "... ... ... ... .#.", "/": "..# ..# .#. #.. #..",
    }.items()
}


def measure_text(text: str, font: Font = DIGITS, scale: int = 1, spacing: int = 1) -> tuple[int, int]:
    glyphs = [font[c] for c in text if c in font]
    if not glyphs:
        return 0, 0
    return scale * (sum(len(g[0]) for g in glyphs) + spacing * (len(glyphs) - 1)), scale * len(glyphs[0])


def _inked(text: str, x: int, y: int, font: Font, scale: int, spacing: int) -> Column:
    """Whether a pixel is inked: runs of each glyph's rows as ranges."""
    out, at = F.lit(False), x
    for c in text:
        glyph = font.get(c)
        if glyph is None:
            continue
        for k, row in enumerate(glyph):
            for i, bit in enumerate(row):
                if bit == "#":
                    out = out | (F.col("x").between(at + i * scale, at + (i + 1) * scale - 1) & F.col("y").between(y + k * scale, y + (k + 1) * scale - 1))
        at += (len(glyph[0]) + spacing) * scale
    return out


def draw_text(px: DataFrame, text: str, x: int, y: int, color: tuple[int, int, int] = (255, 255, 255), font: Font = DIGITS, scale: int = 1, spacing: int = 1, shadow: tuple[int, int, int] | None = None) -> DataFrame:
    if shadow is not None:
        px = draw_text(px, text, x + scale, y + scale, shadow, font, scale, spacing)
    return _tinted(px, F.when(_inked(text, x, y, font, scale, spacing), F.lit(1.0)).otherwise(F.lit(0.0)), color)


def progress(px: DataFrame, width: int, height: int, share: Column, size: int = 2, color: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """A bar at the lower edge, as long as the share of the clip that has passed."""
    on = (F.col("y") >= height - size) & (F.col("x") < share * width)
    return _tinted(px, F.when(on, F.lit(1.0)).otherwise(F.lit(0.0)), color)


def highlight(px: DataFrame, x: int, y: int, width: int, height: int, color: tuple[int, int, int] = (255, 255, 0), alpha: float = 0.3) -> DataFrame:
    return stroke_rect(fill_rect(px, x, y, width, height, color, alpha), x, y, width, height, 1, color)


#: Overlay types by name: functions of pixels.
OVERLAYS = {
    "text": draw_text, "counter": draw_text, "timestamp": draw_text, "caption": draw_text, "rect": fill_rect, "frame": stroke_rect, "ellipse": fill_circle, "line": draw_line, "arrow": draw_arrow,
    "highlight": highlight, "redact": redact, "progress": progress, "image": blit, "watermark": blit, "pip": blit,
}


def overlay(px: DataFrame, items: list[tuple[str, dict]]) -> DataFrame:
    """Overlays by name, one over the other."""
    for name, args in items:
        px = OVERLAYS[name](px, **args)
    return px


def stabilize(px: DataFrame, motion: DataFrame, weight: float = 0.65, inset: int = 1, width: int = 16, height: int = 16, clip: tuple[str, ...] = ()) -> DataFrame:
    """Each frame shifted against the smoothed sum of the motions before it, and cropped by ``inset``.

    A clip's motions, a row for each frame, are folded in order in one pass; pixels are joined with their frame's shift."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    keyed = motion.select(*clip, "frame_idx", "dx", "dy").withColumn("_clip", F.lit(0) if not clip else F.xxhash64(*clip))
    schema = T.StructType([*keyed.select(*clip, "frame_idx").schema.fields, T.StructField("_dx", T.IntegerType()), T.StructField("_dy", T.IntegerType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_idx")
        moved = np.cumsum(np.stack([table.column(c).to_numpy().astype(float) for c in ("dx", "dy")], axis=1), axis=0)
        smooth, shift = np.zeros(2), np.empty(moved.shape, dtype=np.int32)
        for i, at in enumerate(moved):
            smooth = smooth * weight + at * (1 - weight)
            shift[i] = np.floor(at - smooth + 0.5)
        return pa.table([*(table.column(c) for c in (*clip, "frame_idx")), pa.array(shift[:, 0]), pa.array(shift[:, 1])], names=[*clip, "frame_idx", "_dx", "_dy"])

    shift = keyed.groupBy(*(clip or ("_clip",))).applyInArrow(run, schema)
    j = px.join(shift, [*clip, "frame_idx"], "left").withColumns({"x": F.col("x") - F.coalesce("_dx", F.lit(0)), "y": F.col("y") - F.coalesce("_dy", F.lit(0))}).drop("_dx", "_dy")
    return j.where(F.col("x").between(inset, width - 1 - inset) & F.col("y").between(inset, height - 1 - inset)).withColumns({"x": F.col("x") - inset, "y": F.col("y") - inset})
