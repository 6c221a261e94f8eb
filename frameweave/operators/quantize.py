"""Palette quantizers over weighted histograms, and error diffusion.

A histogram is small next to its pixels: each clip's is gathered in one Arrow group (at most 2 ** 24 colours, by far fewer in
practice) and split or clustered there with array operations; clips run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Palette = np.ndarray  # (n, 3) of float


def _distance(colors: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Redmean distances (squared), a row for each colour."""
    c, p = colors[:, None, :].astype(np.int64), np.rint(palette)[None, :, :].astype(np.int64)
    mean = (c[..., 0] + p[..., 0]) >> 1
    d = c - p
    return (((512 + mean) * d[..., 0] ** 2) >> 8) + 4 * d[..., 1] ** 2 + (((767 - mean) * d[..., 2] ** 2) >> 8)


def assign(colors: np.ndarray, palette: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the first of equal ones) and its distance, in blocks of bounded size."""
    at, best = np.zeros(len(colors), dtype=np.int64), np.zeros(len(colors), dtype=np.int64)
    for i in range(0, len(colors), 8192):
        d = _distance(colors[i : i + 8192], palette)
        at[i : i + 8192] = d.argmin(axis=1)
        best[i : i + 8192] = d.min(axis=1)
    return at, best


def _split(colors: np.ndarray, weights: np.ndarray, n: int, cut: Callable, worth: Callable) -> np.ndarray:
    """Split the box that is most worth it until there are ``n``; the weighted means of the boxes."""
    boxes = [np.arange(len(colors))]
    values = [worth(colors, weights)]
    while len(boxes) < n:
        k = int(np.argmax(values))
        if values[k] <= 0:
            break
        box = boxes[k]
        low, high = cut(colors[box], weights[box])
        boxes[k : k + 1] = [box[low], box[high]]
        values[k : k + 1] = [worth(colors[b], weights[b]) if len(b) > 1 else 0.0 for b in boxes[k : k + 2]]
    return np.array([np.average(colors[b], axis=0, weights=weights[b]) for b in boxes])


def median_cut(colors: np.ndarray, weights: np.ndarray, n: int) -> Palette:
    def cut(c: np.ndarray, w: np.ndarray):
        axis = int(np.argmax(np.ptp(c, axis=0)))
        order = np.argsort(c[:, axis], kind="stable")
        half = int(np.clip(np.searchsorted(np.cumsum(w[order]), w.sum() / 2), 0, len(c) - 2)) + 1
        return order[:half], order[half:]

    return _split(colors, weights, n, cut, lambda c, w: float(np.ptp(c, axis=0).max() * np.sqrt(w.sum())))


#: Levels of a channel on the grid of moments.
LEVELS = 32


def wu(colors: np.ndarray, weights: np.ndarray, n: int) -> Palette:
    """Greedy splits of boxes on a grid of 32 levels for each channel, each time of the box and at the level that lower the
    variance most. Sums over boxes come from cumulative moments of the grid, so no colour is looked at twice."""
    cell = tuple((colors.astype(np.int64) >> 3).T)
    moments = np.zeros((4, LEVELS + 1, LEVELS + 1, LEVELS + 1))  # weight, and weighted sums of the channels
    for k, v in enumerate((weights, *(weights * colors[:, c] for c in range(3)))):
        np.add.at(moments[k], tuple(c + 1 for c in cell), v)
    for axis in (1, 2, 3):
        moments = np.cumsum(moments, axis=axis)

    def sums(low: list[int], high: list[int], axis: int | None = None) -> np.ndarray:
        """Moments of a box; with ``axis``, of its parts below each of its levels but the first, a column each."""
        span = [np.array([a, b]) for a, b in zip(low, high, strict=True)]
        if axis is not None:
            span[axis] = np.arange(low[axis], high[axis])
        m = moments[:, span[0][:, None, None], span[1][None, :, None], span[2][None, None, :]]
        for k in (3, 2, 1):
            m = (np.take(m, range(1, m.shape[k]), axis=k) - np.take(m, [0], axis=k)) if k - 1 == axis else np.diff(m, axis=k)
        return m.reshape(4, -1) if axis is not None else m.reshape(4)

    def spread(m: np.ndarray) -> np.ndarray:
        return np.where(m[0] > 0, (m[1:] ** 2).sum(axis=0) / np.maximum(m[0], 1e-12), 0.0)

    def best(low: list[int], high: list[int]) -> tuple[float, int, int]:
        whole, found = sums(low, high), (0.0, 0, 0)
        for axis in range(3):
            if high[axis] - low[axis] < 2:
                continue
            part = sums(low, high, axis)
            rest = whole[:, None] - part
            gain = np.where((part[0] > 0) & (rest[0] > 1e-9), spread(part) + spread(rest) - spread(whole[:, None]), 0.0)
            k = int(gain.argmax())
            if gain[k] > found[0] + 1e-9:
                found = (float(gain[k]), axis, low[axis] + 1 + k)
        return found

    boxes = [([0, 0, 0], [LEVELS] * 3)]
    gains = [best(*boxes[0])]
    while len(boxes) < n:
        k = max(range(len(boxes)), key=lambda i: gains[i][0])
        gain, axis, at = gains[k]
        if gain <= 0:
            break
        low, high = boxes[k]
        one, two = list(high), list(low)
        one[axis] = two[axis] = at
        boxes[k : k + 1] = [(low, one), (two, high)]
        gains[k : k + 1] = [best(low, one), best(two, high)]
    total = np.array([sums(low, high) for low, high in boxes])
    total = total[total[:, 0] > 0]
    return total[:, 1:] / total[:, :1]


def octree(colors: np.ndarray, weights: np.ndarray, n: int) -> Palette:
    """Interleaved bits of the channels; the lightest leaves of the deepest level are merged into their parents."""
    c = colors.astype(np.int64)
    path = np.zeros(len(c), dtype=np.int64)
    for bit in range(7, -1, -1):
        path = path << 3 | ((c[:, 0] >> bit & 1) << 2 | (c[:, 1] >> bit & 1) << 1 | (c[:, 2] >> bit & 1))
    leaves = {(8, int(p)): (np.append(k * w, w)) for p, k, w in zip(path, colors.astype(float), weights, strict=True)}
    for level in range(8, 0, -1):
        parents: dict[int, list] = {}
        for depth, p in leaves:
            if depth == level:
                parents.setdefault(p >> 3, []).append(p)
        for parent in sorted(parents, key=lambda q: (sum(leaves[level, p][3] for p in parents[q]), q)):
            if len(leaves) <= n:
                return np.array([v[:3] / v[3] for _, v in sorted(leaves.items())])
            leaves[level - 1, parent] = sum(leaves.pop((level, p)) for p in parents[parent])
    return np.array([v[:3] / v[3] for _, v in sorted(leaves.items())])


def polish(colors: np.ndarray, weights: np.ndarray, palette: Palette, rounds: int = 3, stop: float = 5e-4) -> Palette:
    """Lloyd rounds; an entry that nothing is near to takes the colour that is served worst."""
    last = np.inf
    for _ in range(rounds):
        at, d = assign(colors, palette)
        error = float((d * weights).sum())
        if last - error < stop * max(last, 1e-9) and np.isfinite(last):
            break
        last = error
        mass = np.bincount(at, weights, len(palette))
        palette = np.stack([np.bincount(at, weights * colors[:, k], len(palette)) for k in range(3)], axis=1) / np.maximum(mass, 1e-12)[:, None]
        worst = np.argsort(-(d * weights), kind="stable")
        for k, i in enumerate(np.flatnonzero(mass == 0)):
            palette[i] = colors[worst[min(k, len(worst) - 1)]]
    return palette


def spread_seeds(colors: np.ndarray, weights: np.ndarray, n: int, seed: int = 1) -> Palette:
    """Colours drawn one after the other, each by its weight times its distance from those before it (k-means++)."""
    rng = np.random.default_rng(seed)
    far = np.full(len(colors), np.inf)
    chosen = [int(np.argmax(weights))]
    while len(chosen) < min(n, len(colors)):
        far = np.minimum(far, _distance(colors, colors[chosen[-1:]])[:, 0])
        odds = far * weights
        if odds.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(colors), p=odds / odds.sum())))
    return colors[chosen].astype(float)


def kmeans(colors: np.ndarray, weights: np.ndarray, n: int) -> Palette:
    """Lloyd rounds from two beginnings, boxes and spread seeds; the palette with the smaller error."""
    made = [polish(colors, weights, start(colors, weights, n), 12) for start in (median_cut, spread_seeds)]
    return min(made, key=lambda p: float((assign(colors, p)[1] * weights).sum()))


def nearest_colors(palette: Palette, colors: np.ndarray) -> Palette:
    """For each entry the colour nearest to it (the first of equal ones), in blocks of bounded size, however many there are."""
    entries = np.clip(np.rint(palette), 0, 255)
    at, best = np.zeros(len(entries), dtype=np.int64), np.full(len(entries), np.iinfo(np.int64).max)
    for i in range(0, len(colors), 8192):
        d = _distance(colors[i : i + 8192], entries)
        k = d.argmin(axis=0)
        better = d[k, np.arange(len(entries))] < best
        at[better], best[better] = i + k[better], d[k, np.arange(len(entries))][better]
    return colors[at].astype(float)


def imagequant(colors: np.ndarray, weights: np.ndarray, n: int) -> Palette:
    """Clusters, then real colours: each entry becomes the colour nearest to it, and unused ones go."""
    palette = polish(colors, weights, wu(colors, weights, n), 8)
    palette = nearest_colors(palette, colors)
    used = np.unique(assign(colors, palette)[0])
    return palette[used]


QUANTIZERS: dict[str, Callable[[np.ndarray, np.ndarray, int], Palette]] = {"median-cut": median_cut, "wu": wu, "octree": octree, "kmeans": kmeans, "imagequant": imagequant}


def _fixed(name: str | None) -> Callable[[np.ndarray, np.ndarray, int], Palette]:
    """A palette that doesn't look at the colours, by luma."""

    def made(colors: np.ndarray, weights: np.ndarray, n: int) -> Palette:
        from .palettes import named_palette

        palette = np.array(named_palette(name or "websafe", n), dtype=float)[:256]
        return palette[np.argsort(palette @ [0.2126, 0.7152, 0.0722], kind="stable")]

    return made


#: Palettes that are what they are, whatever the picture.
FIXED = {"fixed": _fixed(None), "websafe": _fixed("websafe"), "grayscale": _fixed("grayscale"), "mono": _fixed("mono"), "mono2": _fixed("mono")}
QUANTIZERS |= FIXED


def register(name: str, quantizer: Callable[[np.ndarray, np.ndarray, int], Palette]) -> None:
    """A quantizer of one's own: (colours, weights, n) to a palette."""
    QUANTIZERS[name] = quantizer


def top_up(colors: np.ndarray, weights: np.ndarray, palette: Palette, n: int, least: int = 4) -> Palette:
    """Fill open entries with the heaviest colours that aren't near to any there is."""
    out = list(palette)
    for i in np.argsort(-weights, kind="stable"):
        if len(out) >= n:
            break
        if _distance(colors[i : i + 1], np.array(out)).min() > least:
            out.append(colors[i].astype(float))
    return np.array(out)


def quantize(colors: np.ndarray, weights: np.ndarray, n: int, method: str = "median-cut") -> tuple[np.ndarray, float]:
    """Palette (integers, distinct, the most used first) and its root mean error by channel."""
    palette = np.rint(QUANTIZERS[method](colors.astype(float), weights.astype(float), n)).clip(0, 255)
    if method in FIXED:
        _, d = assign(colors, palette)
        return palette.astype(int), float(np.sqrt((d * weights).sum() / weights.sum() / 3))
    palette = top_up(colors, weights, np.array(list(dict.fromkeys(map(tuple, palette)))), n)
    if method not in ("kmeans", "imagequant"):
        palette = np.rint(polish(colors.astype(float), weights.astype(float), palette)).clip(0, 255)
    palette = np.array(list(dict.fromkeys(map(tuple, palette))))
    at, d = assign(colors, palette)
    order = np.argsort(-np.bincount(at, minlength=len(palette)), kind="stable")
    return palette[order].astype(int), float(np.sqrt((d * weights).sum() / weights.sum() / 3))


def quantize_clips(hist: DataFrame, n: int = 16, method: str = "median-cut", key: str = "clip_id") -> DataFrame:
    """Palette rows (``key``, ``idx``, ``pr``, ``pg``, ``pb``, ``rmse``) of each clip's histogram (``key``, ``key24``, ``weight``)."""

    def run(table: pa.Table) -> pa.Table:
        rgb = np.array(table.column("key24").to_numpy(), dtype=np.int64)
        order = np.argsort(rgb, kind="stable")
        rgb, weights = rgb[order], np.array(table.column("weight").to_numpy(), dtype=float)[order]
        palette, rmse = quantize(np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=1), weights, n, method)
        k = len(palette)
        return pa.table([pa.array([table.column(key)[0].as_py()] * k, type=pa.int64()), *(pa.array(v.astype(np.int32)) for v in (np.arange(k), *palette.T)), pa.array([round(rmse, 6)] * k)], names=[key, "idx", "pr", "pg", "pb", "rmse"])

    return hist.groupBy(key).applyInArrow(run, f"{key} bigint, idx int, pr int, pg int, pb int, rmse double")


#: Error-diffusion kernels, (dx, dy, parts) over a divisor.
DIFFUSION: dict[str, tuple[int, list[tuple[int, int, int]]]] = {
    "floyd-steinberg": (16, [(1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)]),
    "floyd-steinberg-lite": (4, [(1, 0, 2), (0, 1, 1), (1, 1, 1)]),
    "atkinson": (8, [(1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (0, 2, 1)]),
    "jarvis-justice-ninke": (48, [(1, 0, 7), (2, 0, 5), (-2, 1, 3), (-1, 1, 7), (0, 1, 5), (1, 1, 3), (2, 1, 1), (-2, 2, 2), (-1, 2, 4), (0, 2, 2)]),
    "stucki": (42, [(1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2), (-2, 2, 1), (-1, 2, 2), (0, 2, 4), (1, 2, 2), (2, 2, 1)]),
    "burkes": (32, [(1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2)]),
    "sierra": (32, [(1, 0, 5), (2, 0, 3), (-2, 1, 2), (-1, 1, 4), (0, 1, 5), (1, 1, 4), (2, 1, 2), (-1, 2, 2), (0, 2, 3), (1, 2, 2)]),
    "sierra-2row": (16, [(1, 0, 4), (2, 0, 1), (-2, 1, 1), (-1, 1, 2), (0, 1, 4), (1, 1, 2), (2, 1, 1)]),
    "sierra-lite": (4, [(1, 0, 2), (-1, 1, 1), (0, 1, 1)]),
    "one-dimensional": (1, [(1, 0, 1)]), "two-dimensional": (2, [(1, 0, 1), (0, 1, 1)]), "filter-lite": (4, [(1, 0, 2), (-1, 1, 1), (0, 1, 1)]),
    "slerr": (2, [(1, 0, 1), (0, 1, 1)]), "false-floyd": (2, [(1, 0, 1), (0, 1, 1)]), "favg": (65, [(1, 0, 15), (2, 0, 12), (-1, 1, 15), (0, 1, 8)]),
}
ALIASES = {"fs": "floyd-steinberg", "floyd": "floyd-steinberg", "jarvis": "jarvis-justice-ninke", "jjn": "jarvis-justice-ninke", "sierra2": "sierra-2row", "two-row": "sierra-2row", "sierra3": "sierra", "mac-atkinson": "atkinson"}


def diffuse(rgb: np.ndarray, palette: np.ndarray, kernel: str = "floyd-steinberg", serpentine: bool = True) -> np.ndarray:
    """Indexes (h, w) of a picture (h, w, 3), or of several of one size (n, h, w, 3); what a pixel misses is handed to those
    after it. Pictures are worked on in step: each place is one operation on all of them."""
    div, taps = DIFFUSION[ALIASES.get(kernel, kernel)]
    work = (rgb if rgb.ndim == 4 else rgb[None]).astype(float)
    n, h, w, _ = work.shape
    out = np.zeros((n, h, w), dtype=np.uint8)
    for y in range(h):
        back = serpentine and y % 2
        for x in range(w - 1, -1, -1) if back else range(w):
            want = work[:, y, x].clip(0, 255)
            i = _distance(np.rint(want), palette).argmin(axis=1)
            out[:, y, x] = i
            miss = want - palette[i]
            for dx, dy, part in taps:
                tx, ty = x - dx if back else x + dx, y + dy
                if 0 <= tx < w and ty < h:
                    work[:, ty, tx] += miss * part / div
    return out if rgb.ndim == 4 else out[0]


def diffuse_frames(frames: DataFrame, palette: list[tuple[int, int, int]], kernel: str = "floyd-steinberg", keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """``indices`` of each frame (``width``, ``height``, ``rgb`` binary), frame by frame in Arrow batches."""
    colors = np.array(palette, dtype=float)
    names = list(keys)
    fields = ", ".join(f"{k} bigint" for k in names)

    def run(batches):
        for b in batches:
            raw, sizes = b.column("rgb").to_pylist(), list(zip(b.column("height").to_pylist(), b.column("width").to_pylist(), strict=True))
            made: list[bytes] = [b""] * len(raw)
            for h, w in set(sizes):
                own = [i for i, size in enumerate(sizes) if size == (h, w)]
                for k in range(0, len(own), most := max(1, (4 << 20) // max(1, 3 * h * w))):
                    some = own[k : k + most]
                    indexes = diffuse(np.stack([np.frombuffer(raw[i], dtype=np.uint8).reshape(h, w, 3) for i in some]), colors, kernel)
                    for i, picture in zip(some, indexes, strict=True):
                        made[i] = picture.tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(k).cast(pa.int64()) for k in names), b.column("width").cast(pa.int32()), b.column("height").cast(pa.int32()), pa.array(made, type=pa.binary())], names=[*names, "width", "height", "indices"])

    return frames.mapInArrow(run, f"{fields}, width int, height int, indices binary")
