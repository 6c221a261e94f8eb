"""Geometry on pixel rows: coordinates are projected, filtered or grouped; frames never leave the cluster as arrays.

Every operator takes pixels with columns ``frame_idx`` (any keys of a frame can be named in ``keys``), ``x``, ``y`` and
channels, and the width and height where they matter. Averages are truncated, as bytes are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import byte, col, luma709, round_half_up

X, Y = "x", "y"


def _channels(df: DataFrame) -> list[str]:
    return [c for c in ("r", "g", "b", "a", "idx") if c in df.columns]


def crop(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = F.col(X).between(x, x + width - 1) & F.col(Y).between(y, y + height - 1)
    return df.where(inside).withColumns({X: F.col(X) - x, Y: F.col(Y) - y})


def trim_edges(df: DataFrame, width: int, height: int, left: int, top: int, right: int, bottom: int) -> DataFrame:
    return crop(df, left, top, width - left - right, height - top - bottom)


def flip(df: DataFrame, width: int, height: int, horizontal: bool = True, vertical: bool = False) -> DataFrame:
    return df.withColumns({X: F.lit(width - 1) - F.col(X) if horizontal else F.col(X), Y: F.lit(height - 1) - F.col(Y) if vertical else F.col(Y)})


def transpose(df: DataFrame) -> DataFrame:
    return df.withColumns({X: F.col(Y), Y: F.col(X)})


def rotate(df: DataFrame, width: int, height: int, degrees: int) -> DataFrame:
    """Quarter turns, clockwise. Other angles: ``kernels.rotate_any``."""
    turns = round(degrees / 90) % 4
    x, y = F.col(X), F.col(Y)
    to = {0: (x, y), 1: (F.lit(height - 1) - y, x), 2: (F.lit(width - 1) - x, F.lit(height - 1) - y), 3: (y, F.lit(width - 1) - x)}[turns]
    return df.withColumns({X: to[0], Y: to[1]})


def pad(df: DataFrame, width: int, height: int, to_width: int, to_height: int, color: tuple[int, int, int, int] = (0, 0, 0, 255), align: tuple[float, float] = (0.5, 0.5), mode: str = "solid", keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """A larger canvas: ``solid`` colour, nearest ``edge`` or ``mirror`` around the frame."""
    dx, dy = math.floor((to_width - width) * align[0]), math.floor((to_height - height) * align[1])
    if mode != "solid":
        def targets(c: str, d: int, n: int, m: int) -> Column:
            """Places of ``m`` that read the place ``c`` of ``n``."""
            v = F.col(c)

            def steps(first: Column, last: Column, step: int) -> Column:
                return F.when(v.between(0, n - 1) & (first <= last), F.sequence(first.cast("int"), F.greatest(first, last).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))

            if mode == "edge":
                return steps(F.greatest(F.when(v == 0, 0).otherwise(v + d), F.lit(0)), F.least(F.when(v == n - 1, m - 1).otherwise(v + d), F.lit(m - 1)), 1)
            return F.concat(*(steps(F.pmod(at + d, F.lit(2 * n)), F.lit(m - 1), 2 * n) for at in (v, F.lit(2 * n - 1) - v)))

        # each pixel goes to the places that read it, so no frame is joined with its canvas
        out = df.withColumn("_tx", F.explode(targets(X, dx, width, to_width))).withColumn("_ty", F.explode(targets(Y, dy, height, to_height)))
        return out.withColumns({X: F.col("_tx"), Y: F.col("_ty")}).drop("_tx", "_ty")
    moved = df.withColumns({X: F.col(X) + dx, Y: F.col(Y) + dy})
    filled = _grid(df, to_width, to_height, keys).join(moved, [*keys, X, Y], "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in zip("rgba", color, strict=True) if c in df.columns})


def _grid(df: DataFrame, width: int, height: int, keys: tuple[str, ...]) -> DataFrame:
    """All places of a canvas for each frame."""
    frames = df.select(*keys).distinct()
    spots = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))
    return frames.select(*keys, spots.alias("_p")).select(*keys, (F.col("_p") % width).cast("int").alias(X), F.floor(F.col("_p") / width).cast("int").alias(Y))


def scale_nearest(df: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Each source pixel is exploded to the places that read it, so no join is needed."""

    def targets(v: str, n: int, m: int) -> Column:
        # t reads floor(t * n / m): the run [ceil(v * m / n), ceil((v + 1) * m / n))
        first, stop = F.ceil(F.col(v) * m / n), F.ceil((F.col(v) + 1) * m / n)
        return F.when(stop > first, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<bigint>"))

    out = df.withColumn("_tx", F.explode(targets(X, width, to_width))).withColumn("_ty", F.explode(targets(Y, height, to_height)))
    return out.withColumns({X: F.col("_tx").cast("int"), Y: F.col("_ty").cast("int")}).drop("_tx", "_ty")


def scale_area(df: DataFrame, factor_x: int, factor_y: int, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Box mean over whole cells; colours weighted by alpha if there is one."""
    cell = [F.floor(F.col(X) / factor_x).cast("int").alias(X), F.floor(F.col(Y) / factor_y).cast("int").alias(Y)]
    if "a" not in df.columns:
        return df.groupBy(*keys, *cell).agg(*(round_half_up(F.avg(c)).cast("int").alias(c) for c in "rgb"))
    weight = F.sum("a")
    mean = {c: F.when(weight > 0, round_half_up(F.sum(F.col(c) * F.col("a")) / weight)).otherwise(0).cast("int") for c in "rgb"}
    return df.groupBy(*keys, *cell).agg(*(v.alias(c) for c, v in mean.items()), round_half_up(F.avg("a")).cast("int").alias("a"))


def downscale2x(df: DataFrame, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Mean of four, rounded half up; of cells that are whole."""
    cell = [F.floor(F.col(v) / 2).cast("int").alias(v) for v in (X, Y)]
    sums = df.groupBy(*keys, *cell).agg(*(F.sum(c).alias(c) for c in _channels(df)), F.count("*").alias("_n")).where("_n = 4").drop("_n")
    return sums.withColumns({c: F.shiftright(F.col(c) + 2, 2).cast("int") for c in _channels(df)})


def pixelate(df: DataFrame, block: int = 8, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, F.floor(F.col(X) / block), F.floor(F.col(Y) / block))
    return df.withColumns({c: F.floor(F.avg(c).over(w)).cast("int") for c in _channels(df) if c != "idx"})


def chroma_subsample(df: DataFrame, factor: int = 2, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Block means of colour under each pixel's own luma."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, F.floor(F.col(X) / factor), F.floor(F.col(Y) / factor))
    mean = df.withColumns({f"_{c}": F.floor(F.avg(c).over(w)) for c in "rgb"})
    own, block = luma709(F.col("r"), F.col("g"), F.col("b")), luma709(F.col("_r"), F.col("_g"), F.col("_b"))
    return mean.withColumns({c: byte(own + (F.col(f"_{c}") - block)) for c in "rgb"}).drop("_r", "_g", "_b")


def vignette(df: DataFrame, width: int, height: int, amount: float = 0.5, softness: float = 0.6, color: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Towards a colour with the distance from the centre."""
    cx, cy = width / 2, height / 2
    d = F.hypot((F.col(X) + 0.5 - cx) / cx, (F.col(Y) + 0.5 - cy) / cy) / math.sqrt(2)
    t = F.least(F.greatest((d - (1 - softness)) / softness, F.lit(0.0)), F.lit(1.0)) * amount
    return df.withColumns({c: byte(F.col(c) + (F.lit(float(color[k])) - F.col(c)) * t) for k, c in enumerate("rgb")})


def rounded_corners(df: DataFrame, width: int, height: int, radius: int = 12) -> DataFrame:
    """Alpha ramps down beyond quarter circles in the corners."""
    r = min(radius, width // 2, height // 2)
    cx = F.when(F.col(X) < r, r).when(F.col(X) >= width - r, width - 1 - r).otherwise(F.col(X))
    cy = F.when(F.col(Y) < r, r).when(F.col(Y) >= height - r, height - 1 - r).otherwise(F.col(Y))
    d2 = (F.col(X) - cx) * (F.col(X) - cx) + (F.col(Y) - cy) * (F.col(Y) - cy)
    k = F.least(F.greatest(F.lit(1.0) - (d2 - r * r) / F.lit(2.0 * r), F.lit(0.0)), F.lit(1.0))
    return df.withColumn("a", byte(F.col("a") * k))


def border(df: DataFrame, width: int, height: int, size: int = 2, color: tuple[int, int, int] = (255, 255, 255), gradient: tuple[int, int, int] | None = None) -> DataFrame:
    """A frame of one colour, or from one to another down the frame."""
    on = (F.col(X) < size) | (F.col(Y) < size) | (F.col(X) >= width - size) | (F.col(Y) >= height - size)
    t = F.col(Y) / F.lit(float(max(1, height - 1)))
    made = {c: F.lit(color[k]) if gradient is None else byte(F.lit(float(color[k])) + t * (gradient[k] - color[k])) for k, c in enumerate("rgb")}
    out = df.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, v in made.items()})
    return out.withColumn("a", F.when(on, 255).otherwise(F.col("a"))) if "a" in df.columns else out


def stack(a: DataFrame, b: DataFrame, width: int, height: int, vertical: bool = False, gap: int = 0) -> DataFrame:
    """Two frames of one size side by side, or one above the other."""
    moved = b.withColumn(Y if vertical else X, F.col(Y if vertical else X) + (height if vertical else width) + gap)
    return a.unionByName(moved)


def tile(df: DataFrame, width: int, height: int, columns: int, order: str = "row", rows: int = 1, frame: str = "frame_idx") -> DataFrame:
    """A contact sheet: each frame in a cell of the grid, by rows, columns or diagonals."""
    i = F.col(frame)
    if order == "column":
        cx, cy = F.floor(i / rows), i % rows
    elif order == "diagonal":
        cx, cy = i % columns, (F.floor(i / columns) + i) % F.greatest(F.lit(rows), F.lit(1))
    else:
        cx, cy = i % columns, F.floor(i / columns)
    return df.withColumns({X: (F.col(X) + cx * width).cast("int"), Y: (F.col(Y) + cy * height).cast("int")})


def mirror(df: DataFrame, width: int, height: int, axes: int = 4) -> DataFrame:
    """The left half, or the upper left quarter, mirrored over the whole frame."""
    half = df.where(F.col(X) < width // 2)
    both = half.unionByName(half.withColumn(X, F.lit(width - 1) - F.col(X)))
    if axes == 2:
        return both
    upper = both.where(F.col(Y) < height // 2)
    return upper.unionByName(upper.withColumn(Y, F.lit(height - 1) - F.col(Y)))


def compare(a: DataFrame, b: DataFrame, width: int, height: int, mode: str = "diff", gain: float = 4.0, at: float = 0.5, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """``diff``: amplified absolute difference; ``slider``: a left of ``at``, b right of it; ``sbs``, ``stack``."""
    if mode in ("sbs", "stack"):
        return stack(a, b, width, height, mode == "stack")
    j = a.alias("p").join(b.alias("q"), [*keys, X, Y])
    if mode == "slider":
        use = F.col(X) < at * width
        return j.select(*keys, X, Y, *(F.when(use, F.col(f"p.{c}")).otherwise(F.col(f"q.{c}")).alias(c) for c in "rgb"))
    return j.select(*keys, X, Y, *(byte(F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) * F.lit(float(gain))).alias(c) for c in "rgb"))


def blit(dst: DataFrame, src: DataFrame, x: int, y: int, opacity: float = 1.0, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """``src`` over ``dst`` at a place, by its alpha and ``opacity``."""
    moved = src.select(*keys, (F.col(X) + x).alias(X), (F.col(Y) + y).alias(Y), *(F.col(c).alias(f"_{c}") for c in "rgba"))
    j = dst.join(moved, [*keys, X, Y], "left")
    k = F.coalesce(F.col("_a") / 255.0 * opacity, F.lit(0.0))
    alpha = k + F.col("a") / 255.0 * (F.lit(1.0) - k)
    mixed = {c: F.when(k == 0, F.col(c)).otherwise(byte((F.col(f"_{c}") * k + F.col(c) * (F.col("a") / 255.0) * (F.lit(1.0) - k)) / alpha + 0.5)) for c in "rgb"}
    return j.withColumns(mixed | {"a": F.when(k == 0, F.col("a")).otherwise(byte(alpha * 255 + 0.5))}).drop("_r", "_g", "_b", "_a")


def fill_rect(df: DataFrame, x: int, y: int, width: int, height: int, color: tuple[int, int, int], alpha: float = 1.0) -> DataFrame:
    inside = F.col(X).between(x, x + width - 1) & F.col(Y).between(y, y + height - 1)
    return _tinted(df, F.when(inside, F.lit(float(alpha))).otherwise(F.lit(0.0)), color)


def stroke_rect(df: DataFrame, x: int, y: int, width: int, height: int, thickness: int, color: tuple[int, int, int], alpha: float = 1.0) -> DataFrame:
    outer = F.col(X).between(x, x + width - 1) & F.col(Y).between(y, y + height - 1)
    inner = F.col(X).between(x + thickness, x + width - 1 - thickness) & F.col(Y).between(y + thickness, y + height - 1 - thickness)
    return _tinted(df, F.when(outer & ~inner, F.lit(float(alpha))).otherwise(F.lit(0.0)), color)


def fill_circle(df: DataFrame, cx: float, cy: float, radius: float, color: tuple[int, int, int], alpha: float = 1.0) -> DataFrame:
    """A disc with a soft edge of one pixel."""
    d = F.hypot(F.col(X) - cx, F.col(Y) - cy)
    return _tinted(df, F.least(F.greatest(F.lit(radius + 0.5) - d, F.lit(0.0)), F.lit(1.0)) * alpha, color)


def draw_line(df: DataFrame, x0: float, y0: float, x1: float, y1: float, thickness: float, color: tuple[int, int, int], alpha: float = 1.0) -> DataFrame:
    """A stroke with round ends: by the distance of each pixel from the segment."""
    vx, vy = x1 - x0, y1 - y0
    n = vx * vx + vy * vy or 1e-9
    t = F.least(F.greatest(((F.col(X) - x0) * vx + (F.col(Y) - y0) * vy) / n, F.lit(0.0)), F.lit(1.0))
    d = F.hypot(F.col(X) - x0 - t * vx, F.col(Y) - y0 - t * vy)
    return _tinted(df, F.least(F.greatest(F.lit(thickness / 2 + 0.5) - d, F.lit(0.0)), F.lit(1.0)) * alpha, color)


def draw_arrow(df: DataFrame, x0: float, y0: float, x1: float, y1: float, thickness: float = 2, head: float = 6, color: tuple[int, int, int] = (255, 0, 0)) -> DataFrame:
    out = draw_line(df, x0, y0, x1, y1, thickness, color)
    turn = math.atan2(y1 - y0, x1 - x0)
    for side in (-1, 1):
        at = turn + math.pi - side * math.pi / 6
        out = draw_line(out, x1, y1, x1 + head * math.cos(at), y1 + head * math.sin(at), thickness, color)
    return out


def _tinted(df: DataFrame, k: Column, color: tuple[int, int, int]) -> DataFrame:
    out = df.withColumns({c: F.when(k > 0, byte(F.col(c) + (F.lit(float(color[i])) - F.col(c)) * k)).otherwise(F.col(c)) for i, c in enumerate("rgb")})
    return out.withColumn("a", F.when(k > 0, F.greatest(F.col("a"), byte(k * 255))).otherwise(F.col("a"))) if "a" in df.columns else out


def redact(df: DataFrame, x: int, y: int, width: int, height: int, mode: str = "pixelate", block: int = 4, color: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Hide a region: ``pixelate``, ``solid`` or ``darken``."""
    if mode == "solid":
        return fill_rect(df, x, y, width, height, color)
    if mode == "darken":
        return fill_rect(df, x, y, width, height, (0, 0, 0), 0.6)
    inside = F.col(X).between(x, x + width - 1) & F.col(Y).between(y, y + height - 1)
    return pixelate(df.where(inside), block).unionByName(df.where(~inside))


def black_bars(df: DataFrame, width: int, height: int, threshold: int = 24, tolerance: float = 0.02, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """``left``, ``top``, ``right``, ``bottom``: runs of dark columns and rows at the edges of each frame."""
    lit = (F.greatest("r", "g", "b") > threshold).cast("int")
    rows = df.groupBy(*keys, F.col(Y).alias("v")).agg(F.avg(lit).alias("share")).where(F.col("share") > tolerance)
    cols = df.groupBy(*keys, F.col(X).alias("v")).agg(F.avg(lit).alias("share")).where(F.col("share") > tolerance)
    edges = [part.groupBy(*keys).agg(F.min("v").alias(f"{n}0"), F.max("v").alias(f"{n}1")) for n, part in (("x", cols), ("y", rows))]
    both = df.select(*keys).distinct().join(edges[0], list(keys), "left").join(edges[1], list(keys), "left")
    made = {"left": F.coalesce("x0", F.lit(0)), "top": F.coalesce("y0", F.lit(0)), "right": F.coalesce(F.lit(width - 1) - F.col("x1"), F.lit(0)), "bottom": F.coalesce(F.lit(height - 1) - F.col("y1"), F.lit(0))}
    return both.select(*keys, *(v.cast("int").alias(c) for c, v in made.items()))


def watermark_anchor(df: DataFrame, width: int, height: int, step: int = 3, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """The corner quadrant whose luma varies least."""
    sampled = df.where((F.col(X) % step == 0) & (F.col(Y) % step == 0))
    name = F.concat(F.when(F.col(Y) < height // 2, "top").otherwise("bottom"), F.lit("-"), F.when(F.col(X) < width // 2, "left").otherwise("right"))
    by = sampled.groupBy(*keys, name.alias("anchor")).agg(F.round(F.var_pop(luma709(F.col("r"), F.col("g"), F.col("b"))), 6).alias("variance"))
    return by.groupBy(*keys).agg(F.min(F.struct("variance", "anchor")).alias("m")).select(*keys, "m.anchor", "m.variance")


def mean_luma(df: DataFrame, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(luma709(F.col("r"), F.col("g"), F.col("b"))), 6).alias("mean_luma"))


def ken_burns(df: DataFrame, width: int, height: int, zoom: float, cx: float = 0.5, cy: float = 0.5) -> DataFrame:
    """A window of 1 / zoom of the frame, scaled back to its size by nearest pixels."""
    w, h = max(1, round(width / zoom)), max(1, round(height / zoom))
    x, y = (min(n - m, max(0, round(c * n - m / 2))) for c, n, m in ((cx, width, w), (cy, height, h)))
    return scale_nearest(crop(df, x, y, w, h), w, h, width, height)


# --- plans: scalars only ---


def fit_plan(src_w: int, src_h: int, dst_w: int, dst_h: int, mode: str = "contain") -> dict[str, int]:
    """Scaled size and offset of a frame within a box."""
    kx, ky = dst_w / src_w, dst_h / src_h
    if mode == "fill":
        w, h = dst_w, dst_h
    else:
        k = {"contain": min(kx, ky), "cover": max(kx, ky), "width": kx, "height": ky}[mode]
        w, h = max(1, math.floor(src_w * k + 0.5)), max(1, math.floor(src_h * k + 0.5))
    return {"width": w, "height": h, "x": math.floor((dst_w - w) / 2), "y": math.floor((dst_h - h) / 2)}


def solve_size(src_w: int, src_h: int, want_w: int | None, want_h: int | None, most: int = 4096, multiple: int = 1) -> tuple[int, int]:
    """A size that keeps the aspect where one side is open, no side above ``most``, both multiples of ``multiple``."""
    w = float(want_w or 0) or (want_h * src_w / src_h if want_h and want_h > 0 else float(src_w))
    h = float(want_h or 0) if want_h and want_h > 0 else w * src_h / src_w
    if w < 0:
        w = h * src_w / src_h
    k = min(1.0, most / max(w, h))
    return tuple(max(multiple, math.floor(v * k / multiple + 0.5) * multiple) for v in (w, h))


def aspect_crop(width: int, height: int, aspect: float) -> tuple[int, int, int, int]:
    """Centred window (x, y, width, height) of the aspect."""
    w, h = (width, math.floor(width / aspect + 0.5)) if width / height < aspect else (math.floor(height * aspect + 0.5), height)
    return (width - w) // 2, (height - h) // 2, w, h


def scroll_offsets(length: int, view: int, frames: int, pingpong: bool = False) -> list[int]:
    """Where the view stands in each frame of a scroll."""
    span = max(0, length - view)
    if pingpong:
        half = max(1, (frames - 1) / 2)
        return [math.floor(span * (1 - abs(i - half) / half) + 0.5) for i in range(frames)]
    return [math.floor(span * i / max(1, frames - 1) + 0.5) for i in range(frames)]


#: Kernels that ``scale`` knows.
SCALE_KERNELS = ("nearest", "area", "bilinear", "cubic", "lanczos2", "lanczos3")
LAYOUTS = ("stack", "tile", "mosaic", "compare", "mirror", "scroll")


def layouts() -> list[str]:
    return list(LAYOUTS)


def scale(df: DataFrame, width: int, height: int, to_width: int, to_height: int, kernel: str = "area", keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Frames of another size. ``area`` averages cells that begin and end at whole pixels, and interpolates where a side grows."""
    if kernel not in SCALE_KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}; known: {', '.join(SCALE_KERNELS)}")
    if (width, height) == (to_width, to_height):
        return df
    if kernel == "nearest":
        return scale_nearest(df, width, height, to_width, to_height)
    if kernel == "area" and to_width < width and to_height < height:
        return scale_cells(df, width, height, to_width, to_height, keys)
    if kernel in ("area", "bilinear"):
        return scale_bilinear(df, width, height, to_width, to_height, keys)
    from .kernels import scale_smooth

    return scale_smooth(df, width, height, to_width, to_height, kernel, *keys)


def scale_cells(df: DataFrame, width: int, height: int, to_width: int, to_height: int, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Means over cells from ``floor(t * n / m)`` on, truncated, colours weighted by alpha; pixels are grouped, not joined."""

    def cell(v: str, n: int, m: int) -> Column:
        # the last t with floor(t * n / m) <= v
        return F.floor(((F.col(v) + 1) * m - 1) / n).cast("int")

    into = [cell(X, width, to_width).alias(X), cell(Y, height, to_height).alias(Y)]
    weight = F.sum("a") if "a" in df.columns else F.count("*")
    mean = {c: F.when(weight > 0, F.sum(F.col(c) * F.col("a") if "a" in df.columns else F.col(c)) / weight).otherwise(0) for c in "rgb"} | ({"a": F.avg("a")} if "a" in df.columns else {})
    return df.groupBy(*keys, *into).agg(*(F.floor(v).cast("int").alias(c) for c, v in mean.items()))


def scale_bilinear(df: DataFrame, width: int, height: int, to_width: int, to_height: int, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Between the four pixels around a place's centre, clamped at the edges, truncated, colours weighted by alpha. Each pixel is
    sent to the places that it has a share in and the shares are summed, so nothing is joined."""

    def shares(v: str, n: int, m: int) -> Column:
        # target t lies at (t + 0.5) * n / m - 0.5 among the source's pixels; before the first one it is the first
        first = F.floor((F.col(v) - 1) * m / n).cast("int") - 2
        near = F.sequence(F.greatest(first, F.lit(0)), F.least(F.ceil((F.col(v) + 2) * m / n).cast("int") + 1, F.lit(m - 1)))

        def share(t: Column) -> Column:
            at = F.greatest((t + 0.5) * (n / m) - 0.5, F.lit(0.0))
            low = F.least(F.floor(at), F.lit(n - 1)).cast("int")
            w = F.when(F.floor(at) > n - 1, F.lit(0.0)).otherwise(at - F.floor(at))
            own = F.when(low == F.col(v), F.lit(1.0) - w).otherwise(F.lit(0.0))
            return own + F.when(F.least(low + 1, F.lit(n - 1)) == F.col(v), w).otherwise(F.lit(0.0))

        return F.filter(F.transform(near, lambda t: F.struct(t.alias("t"), share(t).alias("w"))), lambda p: p["w"] > 0)

    sent = df.withColumn("_x", F.explode(shares(X, width, to_width))).withColumn("_y", F.explode(shares(Y, height, to_height)))
    w = F.col("_x.w") * F.col("_y.w")
    a = F.col("a") if "a" in df.columns else F.lit(255)
    sums = sent.groupBy(*keys, F.col("_x.t").alias(X), F.col("_y.t").alias(Y)).agg(*(F.sum(F.col(c) * a * w).alias(c) for c in "rgb"), F.sum(a * w).alias("_a"))
    # sums of shares may lie a hair below whole numbers
    out = {c: F.when(F.col("_a") > 0, byte(F.round(F.col(c) / F.col("_a"), 6))).otherwise(0) for c in "rgb"}
    return sums.withColumns(out).withColumn("a", byte(F.round("_a", 6))).drop("_a") if "a" in df.columns else sums.withColumns(out).drop("_a")


def mosaic(df: DataFrame, width: int, height: int, columns: int, rows: int, to_width: int, to_height: int, frame: str = "frame_idx", keys: tuple[str, ...] = ()) -> DataFrame:
    """Frames as equal cells of one canvas of a fixed size, row by row: each scaled to cover its cell, and cut about its middle.
    Frames beyond the last cell are left out."""
    cell_w, cell_h = math.floor(to_width / columns + 0.5), math.floor(to_height / rows + 0.5)
    k = max(cell_w / width, cell_h / height)
    w, h = math.floor(width * k + 0.5), math.floor(height * k + 0.5)
    covered = crop(scale(df, width, height, w, h, "area", (*keys, frame)), (w - cell_w + 1) // 2, (h - cell_h + 1) // 2, cell_w, cell_h)
    i = F.col(frame)
    placed = covered.where(i < columns * rows).withColumns({X: (F.col(X) + (i % columns) * cell_w).cast("int"), Y: (F.col(Y) + F.floor(i / columns) * cell_h).cast("int")})
    return placed.where((F.col(X) < to_width) & (F.col(Y) < to_height))


def scroll_frames(df: DataFrame, height: int, view: int, frames: int, pingpong: bool = False, frame: str = "frame_idx") -> DataFrame:
    """A tall picture as frames of a window of ``view`` rows that moves down over it (and back): ``slot`` and the window's pixels."""
    offsets = scroll_offsets(height, view, frames, pingpong)
    spots = F.explode(F.array(*(F.struct(F.lit(i).alias("slot"), F.lit(o).alias("at")) for i, o in enumerate(offsets))))
    out = df.withColumn("_s", spots).where(F.col(Y).between(F.col("_s.at"), F.col("_s.at") + view - 1))
    return out.withColumns({"slot": F.col("_s.slot"), Y: (F.col(Y) - F.col("_s.at")).cast("int")}).drop("_s")


def blit_rotated(dst: DataFrame, src: DataFrame, src_w: int, src_h: int, x: float, y: float, degrees: float, opacity: float = 1.0, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """``src`` over ``dst``, turned about its middle, which comes to lie at (x, y). Each of its pixels goes to the nearest place; of
    several at one place the last in its rows shows."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    cx, cy = src_w / 2, src_h / 2
    px = round_half_up(F.lit(x - cx * c + cy * s) + F.col(X) * c - F.col(Y) * s)
    py = round_half_up(F.lit(y - cx * s - cy * c) + F.col(X) * s + F.col(Y) * c)
    sent = src.where(F.col("a") > 0).select(*keys, px.cast("int").alias("_tx"), py.cast("int").alias("_ty"), F.struct(Y, X, "r", "g", "b", "a").alias("_p"))
    top = sent.groupBy(*keys, F.col("_tx").alias(X), F.col("_ty").alias(Y)).agg(F.max("_p").alias("_p"))
    j = dst.join(top, [*keys, X, Y], "left")
    k = F.coalesce(F.col("_p.a") / 255.0 * opacity, F.lit(0.0))
    mixed = {ch: F.when(k > 0, byte(F.col(f"_p.{ch}") * k + F.col(ch) * (F.lit(1.0) - k))).otherwise(F.col(ch)) for ch in "rgb"}
    return j.withColumns(mixed | {"a": F.when(k > 0, byte(k * 255 + F.col("a") * (F.lit(1.0) - k))).otherwise(F.col("a"))}).drop("_p")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "F", "math", "X", "Y", "col")]
