"""Filters that look at neighbours: pixels are exchanged once, by frame, and each frame is one Arrow group. Edges are clamped."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Named kernels.
KERNELS = {
    "identity": [0, 0, 0, 0, 1, 0, 0, 0, 0], "sharpen": [0, -1, 0, -1, 5, -1, 0, -1, 0], "sharpenSoft": [-1, -1, -1, -1, 9, -1, -1, -1, -1],
    "unsharpKernel": [0, -1, 0, -1, 5, -1, 0, -1, 0], "emboss": [-2, -1, 0, -1, 1, 1, 0, 1, 2], "edge": [-1, -1, -1, -1, 8, -1, -1, -1, -1],
    "edgeLight": [0, 1, 0, 1, -4, 1, 0, 1, 0], "laplacian": [0, 1, 0, 1, -4, 1, 0, 1, 0], "sobelX": [-1, 0, 1, -2, 0, 2, -1, 0, 1],
    "sobelY": [-1, -2, -1, 0, 0, 0, 1, 2, 1], "prewittX": [-1, 0, 1, -1, 0, 1, -1, 0, 1], "findEdges": [-1, -1, -1, -1, 8, -1, -1, -1, -1],
    "box": [1] * 9, "gaussian": [1, 2, 1, 2, 4, 2, 1, 2, 1], "motionBlurH": [1] * 9,
    "gaussian5": [1, 4, 6, 4, 1, 4, 16, 24, 16, 4, 6, 24, 36, 24, 6, 4, 16, 24, 16, 4, 1, 4, 6, 4, 1],
}


def per_picture(df: DataFrame, width: int, height: int, f: Callable[[np.ndarray], np.ndarray], keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """``df`` with its colours replaced by what ``f`` makes of each frame's picture (height, width, 3), of integers.

    Pixels are exchanged once, by frame, and a frame is worked on with array operations in one Arrow group. Places that a
    frame lacks are 0 to their neighbours and stay away; rows and other columns are kept as they are.
    """
    schema = T.StructType([T.StructField(c.name, T.IntegerType()) if c.name in ("r", "g", "b") else c for c in df.schema.fields])

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy().astype(np.int64) for c in "xy")
        picture = np.zeros((height, width, 3), dtype=np.int64)
        picture[y, x] = np.stack([table.column(c).to_numpy() for c in "rgb"], axis=1)
        made = f(picture)
        for k, c in enumerate("rgb"):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(made[y, x, k].astype(np.int32)))
        return table

    return df.groupBy(*keys).applyInArrow(run, schema)


def _around(picture: np.ndarray, reach: int) -> np.ndarray:
    """The picture with ``reach`` more pixels on each side, like those at the edge."""
    return np.pad(picture, ((reach, reach), (reach, reach), (0, 0)), mode="edge")


def convolve(df: DataFrame, width: int, height: int, kernel: str | list[float] = "sharpen", div: float | None = None, bias: float = 0, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """3 x 3 or 5 x 5. The divisor is the kernel's sum, or 1 if that isn't positive."""
    k = KERNELS[kernel] if isinstance(kernel, str) else list(kernel)
    reach = 2 if len(k) == 25 else 1
    d = float(div or max(1, sum(k)))
    side = 2 * reach + 1

    def f(p: np.ndarray) -> np.ndarray:
        wide = _around(p, reach)
        total = sum(w * wide[i // side : i // side + height, i % side : i % side + width] for i, w in enumerate(k) if w)
        return np.clip(np.floor(total / d + bias + 0.5), 0, 255)

    return per_picture(df, width, height, f, keys)


def denoise(df: DataFrame, width: int, height: int, strength: int = 6, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Mean of the 3 x 3 neighbours whose colour is near; the pixel itself counts three times. Truncated."""

    def f(p: np.ndarray) -> np.ndarray:
        wide = _around(p, 1)
        total, weight = np.zeros_like(p), np.zeros((height, width, 1), dtype=np.int64)
        for dy in range(3):
            for dx in range(3):
                q = wide[dy : dy + height, dx : dx + width]
                near = (((q - p) ** 2).sum(axis=2, keepdims=True) <= strength * strength * 192) * (3 if dx == dy == 1 else 1)
                total += q * near
                weight += near
        return total // weight

    return per_picture(df, width, height, f, keys)


def _box(p: np.ndarray, radius: int, passes: int = 1) -> np.ndarray:
    for _ in range(passes):
        for axis in (1, 0):
            wide = np.pad(p, [(radius, radius) if i == axis else (0, 0) for i in range(3)], mode="edge")
            run = np.cumsum(wide, axis=axis)
            first = np.zeros_like(np.take(run, [0], axis=axis))
            upto = np.concatenate((first, run), axis=axis)
            n = p.shape[axis]
            p = (np.take(upto, range(2 * radius + 1, 2 * radius + 1 + n), axis=axis) - np.take(upto, range(n), axis=axis)) // (2 * radius + 1)
    return p


def box_blur(df: DataFrame, width: int, height: int, radius: int = 2, passes: int = 1, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Running means along x and then y, edges clamped, truncated after each."""
    return per_picture(df, width, height, lambda p: _box(p, radius, passes), keys)


def unsharp(df: DataFrame, width: int, height: int, amount: float = 1.0, radius: int = 2, threshold: int = 1, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    def f(p: np.ndarray) -> np.ndarray:
        off = p - _box(p, radius)
        return np.where(np.abs(off) > threshold, np.trunc(np.clip(p + off * float(amount), 0, 255)), p)

    return per_picture(df, width, height, f, keys)


def auto_levels(df: DataFrame, clip: float = 0.005, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Stretch the luma histogram between its clipped tails; frames that span less than four levels stay."""
    from pyspark.sql import Window

    from ..functions.numeric import luma709, rounded_byte

    opaque = df.where("a >= 8") if "a" in df.columns else df
    hist = opaque.groupBy(*keys, F.floor(luma709(F.col("r"), F.col("g"), F.col("b"))).cast("int").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    up = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    down = w.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.select(*keys, "v", F.sum("n").over(up).alias("below"), F.sum("n").over(down).alias("above"), (F.sum("n").over(w) * F.lit(clip)).alias("limit"))
    edges = cum.groupBy(*keys).agg(F.min(F.when(F.col("below") >= F.col("limit"), F.col("v"))).alias("lo"), F.max(F.when(F.col("above") >= F.col("limit"), F.col("v"))).alias("hi"))
    # one row for each frame: Spark sees its size and picks the join
    j = df.join(edges, list(keys), "left")
    made = {c: F.when(F.col("hi") - F.col("lo") >= 4, rounded_byte((F.col(c) - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")))).otherwise(F.col(c)) for c in "rgb"}
    return j.withColumns(made).drop("lo", "hi")


def auto_key(df: DataFrame, width: int, height: int, tolerance: float = 3600, feather: float = 2400, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Chroma key with the mean colour of the corners that a frame has."""
    from .pointwise import chroma_key

    corner = F.col("x").isin(0, width - 1) & F.col("y").isin(0, height - 1)
    mean = df.where(corner).groupBy(*keys).agg(*(F.floor(F.avg(c)).cast("int").alias(f"_{c}") for c in "rgb"))
    j = df.join(mean, list(keys), "left")
    return chroma_key(j, tolerance=tolerance, feather=feather, key=(F.col("_r"), F.col("_g"), F.col("_b"))).drop("_r", "_g", "_b")
