"""Steps that go through a frame in order or need all of it: frames are assembled to rows, worked on in Arrow groups, and exploded."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def per_frame(px: DataFrame, width: int, height: int, f: Callable[[np.ndarray], np.ndarray], key: str = "frame_idx") -> DataFrame:
    """``f`` maps a picture (height, width, 4) to one of any size. Places that a frame lacks are transparent and stay away."""
    schema = T.StructType.fromDDL(f"{key} bigint, x int, y int, r int, g int, b int, a int")

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy().astype(int) for c in "xy")
        picture = np.zeros((height, width, 4), dtype=np.uint8)
        have = np.zeros((height, width), dtype=bool)
        picture[y, x] = np.stack([table.column(c).to_numpy() for c in "rgba"], axis=1)
        have[y, x] = True
        made = f(picture.copy())
        keep = have if made.shape[:2] == have.shape else made[..., 3] > 0
        yy, xx = np.nonzero(keep)
        columns = [pa.array(np.full(len(xx), table.column(key)[0].as_py()), type=pa.int64()), pa.array(xx.astype(np.int32)), pa.array(yy.astype(np.int32)), *(pa.array(made[yy, xx, k].astype(np.int32)) for k in range(4))]
        return pa.table(columns, names=schema.fieldNames())

    return px.select(key, "x", "y", "r", "g", "b", "a").groupBy(key).applyInArrow(run, schema)


def _noise(n: int, seed: int) -> np.ndarray:
    """The first ``n`` numbers of a linear congruential generator (32 bits) in -0.5 to 0.5."""
    out, s = np.empty(n), (seed & 0xFFFFFFFF) or 1
    for i in range(n):
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = (s >> 8) / 16777216 - 0.5
    return out


def grain(px: DataFrame, width: int, height: int, amount: float = 12, color: bool = False, seed: int = 1, key: str = "frame_idx") -> DataFrame:
    def f(p: np.ndarray) -> np.ndarray:
        seen = p[..., 3] > 0
        n = int(seen.sum())
        noise = _noise(n * (3 if color else 1), seed).reshape(n, -1) * 2 * amount
        p[seen, :3] = np.clip(p[seen, :3] + noise, 0, 255).astype(np.uint8)
        return p

    return per_frame(px, width, height, f, key)


def flood_key(px: DataFrame, width: int, height: int, tolerance: int = 2600, key: str = "frame_idx") -> DataFrame:
    """What is like the first pixel and connected to the border becomes transparent."""

    def f(p: np.ndarray) -> np.ndarray:
        like = ((p[..., :3].astype(int) - p[0, 0, :3].astype(int)) ** 2).sum(axis=2) <= tolerance
        reached = np.zeros_like(like)
        reached[[0, -1]] = like[[0, -1]]
        reached[:, [0, -1]] |= like[:, [0, -1]]
        while True:
            grown = reached.copy()
            grown[1:] |= reached[:-1]
            grown[:-1] |= reached[1:]
            grown[:, 1:] |= reached[:, :-1]
            grown[:, :-1] |= reached[:, 1:]
            grown &= like
            if (grown == reached).all():
                p[reached, 3] = 0
                return p
            reached = grown

    return per_frame(px, width, height, f, key)


def _sample(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples, colours weighted by alpha; beyond the edge all is transparent."""
    h, w, _ = p.shape
    q = p.astype(float)
    q[..., :3] *= q[..., 3:] / 255
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((*x.shape, 4))
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            inside = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            k = np.abs(1 - dx - (x - x0)) * np.abs(1 - dy - (y - y0)) * inside
            out += k[..., None] * q[yi.clip(0, h - 1), xi.clip(0, w - 1)]
    alpha = out[..., 3:]
    out[..., :3] = np.where(alpha > 0, out[..., :3] * 255 / np.maximum(alpha, 1e-9), 0)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def rotate_any(px: DataFrame, width: int, height: int, degrees: float, expand: bool = True, key: str = "frame_idx") -> DataFrame:
    """Any angle, clockwise, about the centre."""
    turn = np.radians(degrees)
    c, s = np.cos(turn), np.sin(turn)
    w = int(np.ceil(abs(width * c) + abs(height * s) - 1e-9)) if expand else width
    h = int(np.ceil(abs(width * s) + abs(height * c) - 1e-9)) if expand else height

    def f(p: np.ndarray) -> np.ndarray:
        yy, xx = np.mgrid[0:h, 0:w]
        dx, dy = xx - (w - 1) / 2, yy - (h - 1) / 2
        return _sample(p, c * dx + s * dy + (width - 1) / 2, -s * dx + c * dy + (height - 1) / 2)

    return per_frame(px, width, height, f, key)


def scale_smooth(px: DataFrame, width: int, height: int, to_width: int, to_height: int, kernel: str = "bilinear", key: str = "frame_idx") -> DataFrame:
    """``bilinear``, ``cubic`` (Catmull-Rom), ``lanczos2`` or ``lanczos3``: separable weights, wider where it shrinks."""

    def weights(n: int, m: int) -> np.ndarray:
        reach = {"bilinear": 1, "cubic": 2, "lanczos2": 2, "lanczos3": 3}[kernel]
        k = max(1.0, n / m)
        d = (np.arange(n)[None, :] + 0.5 - (np.arange(m)[:, None] + 0.5) * n / m) / k
        a = np.abs(d)
        if kernel == "bilinear":
            out = np.maximum(1 - a, 0)
        elif kernel == "cubic":
            out = np.where(a < 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0))
        else:
            out = np.where(a < reach, np.sinc(d) * np.sinc(d / reach), 0)
        return out / out.sum(axis=1, keepdims=True)

    wx, wy = weights(width, to_width), weights(height, to_height)

    def f(p: np.ndarray) -> np.ndarray:
        q = p.astype(float)
        q[..., :3] *= q[..., 3:] / 255
        out = np.einsum("yh,hwc,xw->yxc", wy, q, wx)
        out[..., :3] = np.where(out[..., 3:] > 0, out[..., :3] * 255 / np.maximum(out[..., 3:], 1e-9), 0)
        return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)

    return per_frame(px, width, height, f, key)
