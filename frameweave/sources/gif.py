"""GIF files: parsing, compositing, writing and optimizing, file by file in Arrow batches, and a Spark data source.

Files are parsed tolerantly: what is cut off or broken adds a warning and what came before is kept. Rows: ``clips`` (a file)
and ``frames`` (an image of it, as palette indexes).
"""

from __future__ import annotations

import struct
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import lzw

KEEP, LEAVE, BACKGROUND, PREVIOUS = 0, 1, 2, 3
Color = tuple[int, int, int]


@dataclass
class Frame:
    x: int
    y: int
    width: int
    height: int
    indices: bytes
    palette: list[Color] | None = None  # None: the file's
    delay_cs: int = 10
    disposal: int = LEAVE
    transparent: int | None = None
    interlaced: bool = False
    lzw_bytes: int = 0


@dataclass
class Gif:
    width: int
    height: int
    palette: list[Color] | None = None
    frames: list[Frame] = field(default_factory=list)
    loop: int | None = None
    background: int = 0
    version: str = "89a"
    comments: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    truncated: bool = False


class GifError(ValueError):
    """Bytes that are no GIF, or a frame that can't be written."""


def interlaced_rows(height: int) -> list[int]:
    """Rows in the order in which an interlaced frame stores them."""
    return [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]


def peek(data: bytes) -> dict:
    """Header facts: version, size, whether there is a file palette and of how many colours."""
    if data[:3] != b"GIF" or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, background, aspect = struct.unpack_from("<HHBBB", data, 6)
    return {"version": data[3:6].decode("latin-1"), "width": width, "height": height, "colors": 2 << (flags & 7) if flags & 0x80 else 0, "background": background, "aspect": aspect}


def parse(data: bytes, pixels: bool = True, most: int | None = None) -> Gif:
    """``pixels``: decode the images; ``most``: frames to read."""
    head = peek(data)
    out = Gif(head["width"], head["height"], background=head["background"], version=head["version"])
    at = 13

    def colors(n: int) -> list[Color]:
        nonlocal at
        got = [tuple(data[i : i + 3]) for i in range(at, min(at + 3 * n, len(data) - 2), 3)]
        at += 3 * n
        return got

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        if at >= len(data):
            out.truncated = True
        at += 1
        return b"".join(parts)

    if head["colors"]:
        out.palette = colors(head["colors"])
    control = None
    while at < len(data):
        mark = data[at]
        at += 1
        if mark == 0x3B:
            return out
        if mark == 0x21 and at < len(data):
            kind = data[at]
            at += 1
            body = blocks()
            if kind == 0xF9 and len(body) >= 4:
                control = body
            elif kind == 0xFE:
                out.comments.append(body.decode("utf-8", "replace"))
            elif kind == 0xFF and body[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 14:
                out.loop = struct.unpack_from("<H", body, 12)[0]
        elif mark == 0x2C and at + 9 <= len(data):
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            own = colors(2 << (flags & 7)) if flags & 0x80 else None
            if at >= len(data):
                break
            size = data[at]
            at += 1
            body = blocks()
            f = Frame(x, y, w, h, b"", own, interlaced=bool(flags & 0x40), lzw_bytes=len(body))
            if control:
                f.disposal = control[0] >> 2 & 7
                f.delay_cs = struct.unpack_from("<H", control, 1)[0]
                f.transparent = control[3] if control[0] & 1 else None
            control = None
            if pixels:
                got, whole = lzw.decode(body, size, w * h) if 1 <= size <= 8 else (b"", False)
                if not whole or len(got) < w * h:
                    out.warnings.append(f"frame {len(out.frames)}: {len(got)} of {w * h} pixels")
                    got = got.ljust(w * h, bytes([f.transparent or 0]))
                if f.interlaced:
                    rows = [b""] * h
                    for k, row in enumerate(interlaced_rows(h)):
                        rows[row] = got[k * w : (k + 1) * w]
                    got = b"".join(rows)
                f.indices = got
            out.frames.append(f)
            if most and len(out.frames) >= most:
                return out
        elif mark:
            out.warnings.append(f"unknown block {mark:#x}")
    out.truncated = True
    return out


def _slots(n: int) -> int:
    bits = 1
    while 1 << bits < min(256, max(2, n)):
        bits += 1
    return bits


def _table(palette: list[Color]) -> bytes:
    return b"".join(bytes(c) for c in palette[:256]).ljust(3 << _slots(len(palette)), b"\0")


def code_size(colors: int) -> int:
    return max(2, _slots(colors))


def write(gif: Gif, clear_interval: int = 0) -> bytes:
    out = bytearray(b"GIF89a" + struct.pack("<HH", gif.width, gif.height))
    out += bytes([(0x80 | 0x70 | (_slots(len(gif.palette)) - 1)) if gif.palette else 0x70, gif.background if gif.palette else 0, 0])
    if gif.palette:
        out += _table(gif.palette)
    if gif.loop is not None:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", gif.loop) + b"\0"
    for text in gif.comments:
        out += b"\x21\xfe" + lzw.frame_blocks(text.encode())
    for f in gif.frames:
        if f.x + f.width > gif.width or f.y + f.height > gif.height or len(f.indices) != f.width * f.height:
            raise GifError("a frame doesn't fit its canvas or its own size")
        palette = f.palette or gif.palette
        if not palette:
            raise GifError("a frame without a palette")
        out += b"\x21\xf9\x04" + bytes([(f.disposal & 7) << 2 | (f.transparent is not None)]) + struct.pack("<H", max(0, min(65535, f.delay_cs))) + bytes([f.transparent or 0, 0])
        flags = (0x80 | (_slots(len(f.palette)) - 1) if f.palette else 0) | (0x40 if f.interlaced else 0)
        out += b"\x2c" + struct.pack("<HHHHB", f.x, f.y, f.width, f.height, flags)
        if f.palette:
            out += _table(f.palette)
        rows = f.indices
        if f.interlaced:
            rows = b"".join(f.indices[y * f.width : (y + 1) * f.width] for y in interlaced_rows(f.height))
        size = code_size(max(len(palette), max(rows, default=0) + 1))
        out += bytes([size]) + lzw.frame_blocks(lzw.encode(rows, size, clear_interval))
    return bytes(out + b"\x3b")


def compose(gif: Gif) -> Iterator[tuple[bytes, int, int]]:
    """RGBA of the canvas as shown by each frame, its start and its duration in milliseconds."""
    import numpy as np

    canvas = np.zeros((gif.height, gif.width, 4), dtype=np.uint8)
    now = 0
    for f in gif.frames:
        before = canvas.copy() if f.disposal == PREVIOUS else None
        palette = np.array(f.palette or gif.palette or [(0, 0, 0)], dtype=np.uint8)
        idx = np.frombuffer(f.indices, dtype=np.uint8).reshape(f.height, f.width)
        h, w = min(f.height, max(0, gif.height - f.y)), min(f.width, max(0, gif.width - f.x))
        idx = idx[:h, :w]
        shown = idx < len(palette)
        if f.transparent is not None:
            shown &= idx != f.transparent
        area = canvas[f.y : f.y + h, f.x : f.x + w]
        area[shown] = np.concatenate((palette[idx[shown]], np.full((int(shown.sum()), 1), 255, dtype=np.uint8)), axis=1)
        yield canvas.tobytes(), now, f.delay_cs * 10
        now += f.delay_cs * 10
        if f.disposal == BACKGROUND:
            area[:] = 0
        elif before is not None:
            canvas = before


#: What ``optimize`` does, unless it is told not to; ``requantize`` only if colours are given.
TECHNIQUES = ("dedupe", "sub_frames", "transparent_unchanged", "compact_palettes", "clear_tune", "delay_quantize", "requantize", "strip_comments")


def requantized(pictures: list, colors: int, method: str = "median-cut") -> list:
    """Pictures (h, w, 4) with at most ``colors`` colours in all, those that ``method`` chooses for them together."""
    import numpy as np

    from ..operators import quantize as Q

    seen, weights = np.unique(np.concatenate([p[p[..., 3] > 0][:, :3] for p in pictures]), axis=0, return_counts=True)
    if len(seen) <= colors:
        return pictures
    palette, _ = Q.quantize(seen.astype(int), weights.astype(float), colors, method)
    near = palette[Q.assign(seen.astype(int), palette)[0]].astype(np.uint8)
    number = lambda c: c[:, 0].astype(np.int64) << 16 | c[:, 1].astype(np.int64) << 8 | c[:, 2]
    known = number(seen)  # ascending, as np.unique sorts rows
    out = []
    for p in pictures:
        q, on = p.copy(), p[..., 3] > 0
        q[on, :3] = near[np.searchsorted(known, number(p[on][:, :3]))]
        out.append(q)
    return out


def compact_in_rect(indices: bytes, palette: list[Color], width: int, rect: tuple[int, int, int, int]) -> tuple[bytes, list[Color]]:
    """The palette's entries that are used inside ``rect`` (x, y, width, height), in order, and its pixels' new indexes."""
    x, y, w, h = rect
    part = b"".join(indices[r * width + x : r * width + x + w] for r in range(y, y + h))
    used = sorted(set(part))
    return part.translate(bytes(used.index(i) if i in used else 0 for i in range(256))), [palette[i] for i in used]


def optimize(data: bytes, without: tuple[str, ...] = (), colors: int | None = None, method: str = "median-cut", max_delta: int = 0) -> bytes:
    """A file that shows the same pictures for the same times, in fewer bytes if possible.

    Composited pictures are compared with the one before: equal ones add their time to it, others are cut to the rectangle that
    changes, with what stays the same inside it made transparent where a palette entry is free. Palettes become one for the file
    if all colours fit, else each frame has its own; a picture of which more than 255 colours change at once keeps the frames of
    the source. Pictures in which something becomes transparent again start from a cleared canvas. Comments go, and the
    interval after which codes start anew is tuned.

    ``without``: names of ``TECHNIQUES`` that are left out. With ``colors`` pictures are first reduced to so many;
    ``max_delta``: differences of a channel that don't count as a change. Both make the result an approximation.
    """
    import numpy as np

    unknown = set(without) - set(TECHNIQUES)
    if unknown:
        raise GifError(f"unknown techniques: {', '.join(sorted(unknown))}")
    does = lambda name: name not in without
    gif = parse(data)
    shots = [(np.frombuffer(rgba, dtype=np.uint8).reshape(gif.height, gif.width, 4), duration // 10) for rgba, _, duration in compose(gif)]
    if not shots:
        return data
    if colors is not None and does("requantize"):
        shots = list(zip(requantized([p for p, _ in shots], max(2, min(255, colors)), method), [d for _, d in shots], strict=True))
    if does("delay_quantize"):
        shots = [(p, max(2, d)) for p, d in shots] if all(d >= 2 for _, d in shots) else shots  # times are whole already

    def differs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (np.abs(p.astype(int) - q.astype(int)) > max_delta).any(axis=2) | ((p[..., 3] > 0) != (q[..., 3] > 0))

    kept: list[tuple] = []
    for picture, delay in shots:
        if does("dedupe") and kept and not differs(kept[-1][0], picture).any() and kept[-1][1] + delay <= 65535:
            kept[-1] = (kept[-1][0], kept[-1][1] + delay)
        else:
            kept.append((picture, delay))
    shared = sorted({tuple(int(v) for v in c) for p, _ in kept for c in np.unique(p[p[..., 3] > 0][:, :3], axis=0)})
    one = len(shared) <= 255
    if one and not does("compact_palettes") and gif.palette and set(shared) <= set(gif.palette) and len(set(gif.palette)) <= 255:
        shared = list(dict.fromkeys(gif.palette))
    out = Gif(gif.width, gif.height, (shared or [(0, 0, 0)]) if one else None, loop=gif.loop, comments=[] if does("strip_comments") else gif.comments)
    shown = np.zeros((gif.height, gif.width, 4), dtype=np.uint8)
    for picture, delay in kept:
        cleared = bool(((shown[..., 3] > 0) & (picture[..., 3] == 0)).any())
        if cleared and out.frames:
            last = out.frames[-1]
            out.frames[-1] = _whole_canvas(last, gif.width, gif.height, len(last.palette or out.palette), BACKGROUND)
            shown = np.zeros_like(shown)
        changed = differs(picture, shown)
        if not changed.any():
            changed[0, 0] = True
        y0, y1, x0, x1 = 0, gif.height, 0, gif.width
        if does("sub_frames"):
            ys, xs = np.flatnonzero(changed.any(axis=1)), np.flatnonzero(changed.any(axis=0))
            y0, y1, x0, x1 = int(ys[0]), int(ys[-1]) + 1, int(xs[0]), int(xs[-1]) + 1
        part = picture[y0:y1, x0:x1]
        diff = changed[y0:y1, x0:x1] if does("transparent_unchanged") else part[..., 3] > 0
        palette = out.palette if one else sorted({tuple(int(v) for v in c) for c in np.unique(part[diff][:, :3], axis=0)})
        if len(palette) > 255:
            return _rewritten(data, gif, does)
        number = {c: i for i, c in enumerate(palette)}
        clear = len(palette)
        idx = np.full(diff.shape, clear, dtype=np.uint8)
        opaque = diff & (part[..., 3] > 0)
        idx[opaque] = [number[tuple(c)] for c in part[opaque][:, :3].tolist()]
        stay = (idx == clear).any()
        own = None if one else palette
        out.frames.append(Frame(x0, y0, x1 - x0, y1 - y0, idx.tobytes(), own, delay, LEAVE, clear if stay else None))
        if max_delta:
            shown = shown.copy()
            shown[y0:y1, x0:x1][diff] = part[diff]
        else:
            shown = picture
    if one:
        out.palette = out.palette + [(0, 0, 0)] if any(f.transparent is not None for f in out.frames) else out.palette
    else:
        for f in out.frames:
            f.palette = f.palette + [(0, 0, 0)] if f.transparent is not None else f.palette
    return _smallest(data, out, does, colors is None and not max_delta)


def _smallest(data: bytes, out: Gif, does, exact: bool) -> bytes:
    """The file as written, with the best interval of clear codes, or the source if that isn't smaller."""
    made = min((write(out, t) for t in ((0, 1024, 3072) if does("clear_tune") else (0,))), key=len)
    return data if exact and len(data) <= len(made) else made


def _rewritten(data: bytes, gif: Gif, does) -> bytes:
    """The source's own frames, written anew."""
    return _smallest(data, Gif(gif.width, gif.height, gif.palette, gif.frames, gif.loop, gif.background, comments=[] if does("strip_comments") else gif.comments), does, True)


def _whole_canvas(f: Frame, width: int, height: int, clear: int, disposal: int) -> Frame:
    """The same picture as a frame of the whole canvas, which is disposed of."""
    rows = []
    for y in range(height):
        inside = f.y <= y < f.y + f.height
        own = f.indices[(y - f.y) * f.width : (y - f.y + 1) * f.width] if inside else b""
        rows.append((bytes([clear]) * f.x + own).ljust(width, bytes([clear])) if inside else bytes([clear]) * width)
    return Frame(0, 0, width, height, b"".join(rows), f.palette, f.delay_cs, disposal, clear)


def verify(a: bytes, b: bytes, tolerance: int = 0) -> dict:
    """Whether two files show the same at every instant: worst difference of a channel, pixels that differ by more than
    ``tolerance``, durations."""
    import numpy as np

    sides = []
    for data in (a, b):
        shown = list(compose(parse(data)))
        sides.append(([np.frombuffer(r, dtype=np.uint8).astype(int) for r, _, _ in shown], [t for _, t, _ in shown], sum(d for *_, d in shown)))
    worst = bad = 0
    for t in sorted(set(sides[0][1]) | set(sides[1][1])):
        p, q = (s[0][max(i for i, start in enumerate(s[1]) if start <= t)] for s in sides)
        gap = np.abs(p - q).reshape(-1, 4).max(axis=1)
        worst, bad = max(worst, int(gap.max(initial=0))), bad + int((gap > tolerance).sum())
    return {"worst": worst, "bad_pixels": bad, "same_duration": sides[0][2] == sides[1][2], "ok": bad == 0 and sides[0][2] == sides[1][2]}


def analyze(data: bytes) -> dict:
    gif = parse(data)
    used = {(None if f.palette is None else k, i) for k, f in enumerate(gif.frames) for i in set(f.indices)}
    slots = sum(len(f.palette) for f in gif.frames if f.palette) + len(gif.palette or ())
    full = sum(f.width == gif.width and f.height == gif.height for f in gif.frames)
    return {
        "frames": len(gif.frames), "used": len(used), "wasted": max(0, slots - len(used)), "full_canvas": full, "local_palettes": sum(f.palette is not None for f in gif.frames),
        "lzw_bytes": sum(f.lzw_bytes for f in gif.frames), "duration_ms": sum(f.delay_cs for f in gif.frames) * 10, "may_help": len(used) < 0.9 * slots or full > len(gif.frames) / 2,
    }


def encode_clips(frames: DataFrame, width: int, height: int, palette: list[Color], key: str = "clip_id", loop: int | None = 0) -> DataFrame:
    """A GIF for each clip of whole index frames (``key``, ``frame_idx``, ``indices`` binary, ``delay_cs``)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["frame_idx"])
        gif = Gif(width, height, palette, [Frame(0, 0, width, height, r["indices"], delay_cs=r["delay_cs"]) for r in rows], loop)
        return pa.table([pa.array([rows[0][key]], type=pa.int64()), pa.array([write(gif)], type=pa.binary())], names=[key, "bytes"])

    return frames.groupBy(key).applyInArrow(run, f"{key} bigint, bytes binary")


# --- data source ---

CLIP_SCHEMA = "path string, frame_idx int, x int, y int, width int, height int, delay_cs int, disposal int, transparent int, colors int, indices binary"


#: Bytes of files that a partition reads, unless one file is larger.
PARTITION_BYTES = 16 << 20


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


def _system(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = urllib.parse.unquote(urllib.parse.urlparse(path).path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class GifReader(DataSourceReader):
    """Files of any file system that pyarrow knows, several small ones to a partition; pixels are decoded only if ``indices`` is
    asked for. Files in stores that only Spark reads: ``frames_of`` over a ``binaryFile`` table."""

    def __init__(self, path: str, wanted: list[str]) -> None:
        self.path, self.wanted = path, wanted

    def partitions(self):
        from pyarrow import fs

        system, top = _system(self.path)
        info = system.get_file_info(top)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        groups: list[list[str]] = []
        held = PARTITION_BYTES
        for f in sorted((f for f in found if f.is_file and f.path.lower().endswith(".gif")), key=lambda f: f.path):
            if held + f.size > PARTITION_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(scheme + f.path)
            held += f.size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.names:
            system, path = _system(name)
            with system.open_input_file(path) as f:
                for row in _rows(name, f.read(), "indices" in self.wanted):
                    yield tuple(row[n] for n in self.wanted)


def _rows(path: str, data: bytes, pixels: bool = True) -> Iterator[dict]:
    gif = parse(data, pixels=pixels)
    for i, f in enumerate(gif.frames):
        yield {
            "path": path, "frame_idx": i, "x": f.x, "y": f.y, "width": f.width, "height": f.height, "delay_cs": f.delay_cs, "disposal": f.disposal,
            "transparent": f.transparent, "colors": len(f.palette or gif.palette or ()), "indices": f.indices,
        }


def frames_of(files: DataFrame, data: str = "content", key: str = "path") -> DataFrame:
    """A row for each image of each file in a column of bytes; bytes that are no GIF give none."""
    names = [c.split()[0] for c in CLIP_SCHEMA.split(", ")]
    kinds = {"path": pa.string(), "indices": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(key).to_pylist(), b.column(data).to_pylist(), strict=True):
                try:
                    rows = list(_rows(str(path), raw or b""))
                except GifError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=kinds.get(n, pa.int32())) for n in names], names=names)

    return files.select(key, data).mapInArrow(run, CLIP_SCHEMA)


class GifSource(DataSource):
    """``spark.read.format("gif").load(path)``: a row for each image of each file."""

    @classmethod
    def name(cls) -> str:
        return "gif"

    def schema(self) -> str:
        return CLIP_SCHEMA

    def reader(self, schema) -> GifReader:
        return GifReader(self.options["path"], schema.fieldNames())
