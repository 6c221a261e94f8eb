"""Containers: what a file is by its first bytes, and the sample tables of MP4, WebM, AVI and raw H.264 files.

``identify`` is an expression over a binary column (of Spark's ``binaryFile`` source, for one). Parsers work on one file's
bytes; ``tables`` runs them over a column in Arrow batches and yields a row for each sample. What is broken ends a parse
without losing what came before (``partial``).
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import SLICE, Columns, give_back, many_tasks, one_at_a_time, sums

#: Magic bytes (hex), where they stand, format, MIME type, confidence.
MAGIC = [
    (4, "66747970", "mp4", "video/mp4", 0.99), (0, "1A45DFA3", "webm", "video/webm", 0.99), (0, "464C56", "flv", "video/x-flv", 0.9), (0, "4F676753", "ogg", "video/ogg", 0.95),
    (0, "474946383761", "gif", "image/gif", 1.0), (0, "474946383961", "gif", "image/gif", 1.0), (0, "89504E470D0A1A0A", "png", "image/png", 1.0), (0, "FFD8", "jpeg", "image/jpeg", 1.0),
    (0, "424D", "bmp", "image/bmp", 0.95), (0, "49492A00", "tiff", "image/tiff", 0.95), (0, "4D4D002A", "tiff", "image/tiff", 0.95), (0, "00000100", "ico", "image/x-icon", 0.9),
    (0, "664C6143", "flac", "audio/flac", 0.95), (0, "494433", "mp3", "audio/mpeg", 0.9), (0, "25504446", "pdf", "application/pdf", 1.0), (0, "504B0304", "zip", "application/zip", 0.98),
    (0, "234558544D3355", "m3u8", "application/vnd.apple.mpegurl", 1.0), (0, "00000001", "h264-annexb", "video/mp4", 0.7),
]
RIFF = {"41564920": ("avi", "video/x-msvideo", 0.95), "57454250": ("webp", "image/webp", 0.98)}
EXTENSIONS = {"mp4": ("mp4", "m4v", "mov"), "webm": ("webm", "mkv"), "avi": ("avi",), "gif": ("gif",), "png": ("png", "apng"), "jpeg": ("jpg", "jpeg"), "bmp": ("bmp",), "svg": ("svg",)}


def identify(data: Column, name: Column | None = None) -> Column:
    """``struct(format, mime, confidence)``; by the name's extension where no magic fits; null if neither says."""

    def made(fmt: str, mime: str | None, conf: float) -> Column:
        return F.struct(F.lit(fmt).alias("format"), F.lit(mime).cast("string").alias("mime"), F.lit(conf).alias("confidence"))

    def at(o: int, digits: str) -> Column:
        return F.hex(F.substring(data, o + 1, len(digits) // 2)) == digits

    out = None
    for tag, what in RIFF.items():
        cond = at(0, "52494646") & at(8, tag)
        out = F.when(cond, made(*what)) if out is None else out.when(cond, made(*what))
    out = out.when(at(0, "52494646"), made("riff", "application/octet-stream", 0.6))
    for o, digits, fmt, mime, conf in MAGIC:
        out = out.when(at(o, digits), made(fmt, mime, conf))
    head = F.lower(F.decode(F.substring(data, 1, 512), "ISO-8859-1"))
    out = out.when(head.rlike(r"^\s*(<\?xml[\s\S]{0,400}?)?<svg"), made("svg", "image/svg+xml", 0.95))
    if name is not None:
        ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{2,5})($|[?#])", 1))
        for fmt, known in EXTENSIONS.items():
            out = out.when(ext.isin(*known), made(fmt, None, 0.4))
    return out


class DemuxError(ValueError):
    """Bytes that are not what the parser is for."""


# --- ISO base media ---


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of each box; the last may be cut off."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        stop = end if size == 0 else at + size
        if stop < body:
            return
        yield kind, body, min(stop, end)
        at = stop


def _cut(data: bytes) -> bool:
    """Whether the last box of a file has less than it says."""
    at = 0
    while at + 8 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        if size == 1 and at + 16 <= len(data):
            size = struct.unpack_from(">Q", data, at + 8)[0]
        if size < 8:
            return False  # up to the end
        at += size
    return at > len(data)


def _child(data: bytes, span: tuple[int, int] | None, *path: bytes) -> tuple[int, int] | None:
    for name in path:
        span = next(((a, b) for k, a, b in _boxes(data, *span) if k == name), None) if span else None
    return span


#: Brands by which a file is one of ISO base media's kin.
MP4_CONTAINERS = ("mp4", "m4v", "mov", "qt", "isom", "iso2", "mp41", "mp42", "avc1", "dash", "M4V", "3gp")


def parse_mp4(data: bytes) -> dict:
    """``tracks``: kind, codec, size, timescale and ``samples`` (offset, size, dts, cts, pts, duration, key; ``Columns``) of each; ``brands``,
    ``duration_ms``, ``rotation``, ``fast_start`` (tables stand before what they point to), ``encrypted``, ``fragments``."""
    every = list(_boxes(data, 0, len(data)))
    top = {k: (a, b) for k, a, b in reversed(every)}
    if b"ftyp" not in top and b"moov" not in top:
        raise DemuxError("no ISO base media file")
    names = data[slice(*top[b"ftyp"])] if b"ftyp" in top else b""
    order = [k for k, *_ in every]
    out: dict = {
        "brand": names[:4].decode("latin-1"), "brands": [names[i : i + 4].decode("latin-1").strip() for i in range(8, len(names) - 3, 4)], "tracks": [], "partial": b"moov" not in top or _cut(data),
        "fragments": order.count(b"moof"), "duration_ms": 0.0, "rotation": 0, "encrypted": b"pssh" in top,
        "fast_start": b"moov" in order and (b"mdat" not in order or order.index(b"moov") < order.index(b"mdat")),
    }
    for kind, a, b in _boxes(data, *top.get(b"moov", (0, 0))):
        if kind == b"trak":
            try:
                out["tracks"].append(_track(data, (a, b)))
            except (struct.error, DemuxError):
                out["partial"] = True
        elif kind == b"mvhd" and b - a >= 20:
            scale, n = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 and b - a >= 32 else struct.unpack_from(">II", data, a + 12)
            out["duration_ms"] = n * 1000 / max(1, scale)
        out["encrypted"] |= kind == b"pssh"
    out["encrypted"] |= any(t["encrypted"] for t in out["tracks"])
    shown = next((t for t in out["tracks"] if t["kind"] == "video"), None)
    out["rotation"] = shown["rotation"] if shown else 0
    out["partial"] |= any(x["offset"] + x["size"] > len(data) for t in out["tracks"] for x in t["samples"][-1:])
    return out


def sample_bytes(data: bytes, sample: dict) -> bytes:
    """The bytes of a sample, block or frame (``offset``, ``size``) in its file."""
    return data[sample["offset"] : sample["offset"] + sample["size"]]


def _fraction(data: bytes, at: int) -> float:
    n, d = struct.unpack_from(">iI", data, at)
    return n / d if d else 0.0


def codec_records(data: bytes, kind: bytes, span: tuple[int, int]) -> dict:
    """What a visual sample entry's boxes say: codec string as RFC 6381 has it, length of size prefixes, bit depth, colour,
    pixel aspect, clean aperture, whether it is encrypted."""
    name = kind.decode("latin-1")
    found = {k: (a, b) for k, a, b in reversed(list(_boxes(data, *span)))}
    out: dict = {"codec": name, "nal_length": None, "bit_depth": None, "colour": None, "pixel_aspect": 1.0, "aperture": None, "description": None, "encrypted": kind in (b"encv", b"enca") or any(k in found for k in (b"sinf", b"senc", b"saiz"))}
    if kind in (b"avc1", b"avc3") and b"avcC" in found:
        a, b = found[b"avcC"]
        out |= {"codec": f"{name}.{data[a + 1 : a + 4].hex()}", "nal_length": (data[a + 4] & 3) + 1, "bit_depth": 8, "description": data[a:b]}
    elif kind in (b"hvc1", b"hev1") and b"hvcC" in found:
        a, b = found[b"hvcC"]
        compat = int(f"{int.from_bytes(data[a + 2 : a + 6], 'big'):032b}"[::-1], 2)  # bits from the last to the first
        limits = data[a + 6 : a + 12].rstrip(b"\0")
        parts = [name, "\0ABC"[data[a + 1] >> 6].strip("\0") + str(data[a + 1] & 31), f"{compat:X}", ("H" if data[a + 1] & 32 else "L") + str(data[a + 12]), *(f"{x:X}" for x in limits)]
        out |= {"codec": ".".join(parts), "nal_length": (data[a + 21] & 3) + 1, "bit_depth": 8 + (data[a + 17] & 7), "description": data[a:b]}
    elif kind == b"av01" and b"av1C" in found:
        a, b = found[b"av1C"]
        profile, level, tier, high, twelve = data[a + 1] >> 5, data[a + 1] & 31, data[a + 2] >> 7, data[a + 2] >> 6 & 1, data[a + 2] >> 5 & 1
        depth = 12 if high and twelve else 10 if high else 8
        out |= {"codec": f"av01.{profile}.{level:02d}{'H' if tier else 'M'}.{depth:02d}", "bit_depth": depth, "description": data[a:b]}
    elif kind in (b"vp08", b"vp09") and b"vpcC" in found:
        a, _ = found[b"vpcC"]
        depth = data[a + 6] >> 4
        out |= {"codec": f"{name}.{data[a + 4]:02d}.{data[a + 5]:02d}.{depth:02d}", "bit_depth": depth}
    if b"colr" in found:
        a, b = found[b"colr"]
        out["colour"] = data[a : a + 4].decode("latin-1")
        if out["colour"] == "nclx" and b - a >= 11:
            primaries, transfer, matrix, full = struct.unpack_from(">HHHB", data, a + 4)
            out["colour"] = f"nclx {primaries}/{transfer}/{matrix} {'full' if full >> 7 else 'limited'}"
    if b"pasp" in found and found[b"pasp"][1] - found[b"pasp"][0] >= 8:
        out["pixel_aspect"] = _fraction(data, found[b"pasp"][0]) or 1.0
    if b"clap" in found and found[b"clap"][1] - found[b"clap"][0] >= 32:
        out["aperture"] = tuple(_fraction(data, found[b"clap"][0] + 8 * i) for i in range(4))
    return out


def _rotation(data: bytes, tkhd: tuple[int, int]) -> int:
    a, b, _, c, d = struct.unpack_from(">5i", data, tkhd[0] + (52 if data[tkhd[0]] == 1 else 40))
    return {(1, 0): 0, (0, 1): 90, (-1, 0): 180, (0, -1): 270}.get(((a > 0) - (a < 0), (b > 0) - (b < 0)), 0)


def _edit_delay(data: bytes, elst: tuple[int, int] | None) -> int:
    """Ticks of the track before what its first edit that shows something shows; empty edits are passed over."""
    if not elst:
        return 0
    rows = _rows(data, elst, "QqI" if data[elst[0]] == 1 else "IiI")
    return next((start for _, start, _ in rows if start >= 0), 0)


def _rows(data: bytes, span: tuple[int, int] | None, form: str) -> list[tuple]:
    """Entries of a full box that begins with their count."""
    if not span:
        return []
    n, size = struct.unpack_from(">I", data, span[0] + 4)[0], struct.calcsize(">" + form)
    n = min(n, (span[1] - span[0] - 8) // size)
    return list(struct.iter_unpack(">" + form, data[span[0] + 8 : span[0] + 8 + n * size]))


def _numbers(data: bytes, span: tuple[int, int] | None, kinds: str) -> list[np.ndarray]:
    """The same as a column for each of ``kinds`` (of one size)."""
    if not span:
        return [np.zeros(0, dtype=np.int64) for _ in kinds]
    n, size = struct.unpack_from(">I", data, span[0] + 4)[0], struct.calcsize(">" + kinds)
    n = max(0, min(n, (span[1] - span[0] - 8) // size))
    own = size // len(kinds)
    flat = np.frombuffer(data, dtype=f">u{own}", count=n * len(kinds), offset=span[0] + 8) if n else np.zeros(0, dtype=f">u{own}")
    out = []
    for k, kind in enumerate(kinds):
        c = flat[k :: len(kinds)]
        out.append(c.view(">i4").astype(np.int64) if kind == "i" else np.minimum(c, 1 << 62).astype(np.int64) if kind == "Q" else c.astype(np.int64))
    return out


def _expanded(counts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` of each value so many times."""
    counts = np.minimum(counts, n)
    before = sums(counts)[:-1]
    return np.repeat(values, np.clip(n - before, 0, counts))


def _track(data: bytes, trak: tuple[int, int]) -> dict:
    mdia = _child(data, trak, b"mdia")
    mdhd, hdlr, stbl = _child(data, mdia, b"mdhd"), _child(data, mdia, b"hdlr"), _child(data, mdia, b"minf", b"stbl")
    if not (mdhd and hdlr and stbl):
        raise DemuxError("a track without its boxes")
    long = data[mdhd[0]] == 1
    scale = struct.unpack_from(">I", data, mdhd[0] + (20 if long else 12))[0]
    kind = data[hdlr[0] + 8 : hdlr[0] + 12].decode("latin-1")
    entry = next(((k, a, b) for k, a, b in _boxes(data, _child(data, stbl, b"stsd")[0] + 8, _child(data, stbl, b"stsd")[1])), None)
    width = height = 0
    facts: dict = {"codec": "", "nal_length": None, "bit_depth": None, "colour": None, "pixel_aspect": 1.0, "aperture": None, "description": None, "encrypted": False}
    if entry:
        facts["codec"] = entry[0].decode("latin-1")
        if kind == "vide" and entry[1] + 28 <= entry[2]:
            width, height = struct.unpack_from(">HH", data, entry[1] + 24)
            facts = codec_records(data, entry[0], (entry[1] + 78, entry[2]))
    tkhd, elst = _child(data, trak, b"tkhd"), _child(data, trak, b"edts", b"elst")
    stsz = _child(data, stbl, b"stsz")
    fixed, n = struct.unpack_from(">II", data, stsz[0] + 4) if stsz else (0, 0)
    if stsz and not fixed:
        n = max(0, min(n, (stsz[1] - stsz[0] - 12) // 4))
    ctts = _child(data, stbl, b"ctts")
    stss = _child(data, stbl, b"stss")
    timing = _numbers(data, _child(data, stbl, b"stts"), "II"), _numbers(data, ctts, "Ii" if ctts and data[ctts[0]] == 1 else "II")
    marks = _numbers(data, stss, "I")[0] if stss else None
    chunks = _numbers(data, _child(data, stbl, b"stco"), "I")[0]
    chunks = chunks if len(chunks) else _numbers(data, _child(data, stbl, b"co64"), "Q")[0]
    per = _per_chunk(len(chunks), n, _numbers(data, _child(data, stbl, b"stsc"), "III"))
    held = np.minimum(sums(per), n)  # samples before each chunk
    n = int(held[-1])
    sizes = np.full(n, fixed, dtype=np.int64) if fixed or not n else np.frombuffer(data, dtype=">u4", count=n, offset=stsz[0] + 12).astype(np.int64)
    durations, shifts = (_expanded(*t, n) for t in timing)
    durations = np.concatenate((durations, np.full(n - len(durations), durations[-1] if len(durations) else 0, dtype=np.int64)))
    shifts = np.concatenate((shifts, np.zeros(n - len(shifts), dtype=np.int64)))
    keys = np.full(n, marks is None)
    if marks is not None:
        keys[marks[(marks > 0) & (marks <= n)] - 1] = True
    before, dts = sums(sizes), sums(durations)[:-1]
    offsets = before[:-1] + np.repeat(chunks - before[held[:-1]], np.diff(held))
    samples = Columns(n, offset=offsets, size=sizes, dts=dts, cts=shifts, pts=dts + shifts, duration=durations, key=keys)
    return {
        "kind": {"vide": "video", "soun": "audio"}.get(kind, kind), "width": width, "height": height, "timescale": scale, "samples": samples, "edit_delay": _edit_delay(data, elst),
        "rotation": _rotation(data, tkhd) if tkhd and tkhd[1] - tkhd[0] >= 60 else 0, **facts,
    }


def _per_chunk(chunks: int, samples: int, runs: list[np.ndarray]) -> np.ndarray:
    """Samples of each chunk: of the last run that begins at it or before it, or of the first run."""
    first, per = runs[:2]
    if not len(first):
        return np.full(chunks, -(-samples // max(1, chunks)), dtype=np.int64)
    numbers = np.arange(1, chunks + 1)
    # in a table whose runs aren't in order the last one that fits counts: one that is behind an earlier start hides those before it
    lowest = np.minimum.accumulate(first[::-1])[::-1]
    at = np.searchsorted(lowest, numbers, "right") - 1
    return np.where(numbers < first[0], per[0], per[np.maximum(at, 0)])


# --- Matroska / WebM ---


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length integer and what follows it; -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise DemuxError("a bad variable-length integer")
    n = 9 - data[at].bit_length()
    raw = data[at : at + n]
    if len(raw) < n:
        raise DemuxError("cut off")
    value = int.from_bytes(raw, "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        try:
            kind, body = _vint(data, at, True)
            size, body = _vint(data, body, False)
        except DemuxError:
            return
        stop = end if size < 0 else min(body + size, end)
        yield kind, body, stop
        at = stop


#: Element numbers.
SEGMENT, INFO, SCALE, DURATION, TRACKS, TRACK, NUMBER, TYPE, CODEC, VIDEO, WIDTH, HEIGHT = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0xE0, 0xB0, 0xBA
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE, CUES, CUE, CUE_TIME = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x1C53BB6B, 0xBB, 0xB3
CUE_PLACES, CUE_CLUSTER, DOCTYPE, MUXER, PRIVATE, ALPHA_MODE, ADDITIONS, ADDITION, ADDED = 0xB7, 0xF1, 0x4282, 0x4D80, 0x63A2, 0x53C0, 0x75A1, 0xA6, 0xA5


def parse_webm(data: bytes) -> dict:
    """``tracks``, ``blocks`` (track, pts in ms, offset, size, key, and the place of its alpha if it has one), ``cues`` (times),
    ``seek`` (time in ms and place of the cluster of each cue), ``doctype``, ``muxer`` and the duration in ms. A file whose
    clusters can't be read has a block without bytes for each cue."""
    if data[:4] != b"\x1aE\xdf\xa3":
        raise DemuxError("no EBML file")
    out: dict = {"tracks": [], "blocks": [], "cues": [], "seek": [], "doctype": "", "muxer": "", "duration_ms": None, "scale_ns": 1_000_000, "partial": False}
    blocks = {"track": array("q"), "pts_ms": array("d"), "offset": array("q"), "size": array("q"), "key": bytearray()}
    alpha: dict[int, dict] = {}
    seek, places = array("d"), []

    def uint(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def block(a: int, b: int, base: int, key: bool | None) -> None:
        track, at = _vint(data, a, False)
        shift, flags = struct.unpack_from(">hB", data, at)
        for c, v in zip(blocks.values(), (track, (base + shift) * out["scale_ns"] / 1e6, at + 3, b - at - 3, bool(flags & 0x80) if key is None else key), strict=True):
            c.append(v)

    for kind, a, b in _elements(data, 0, len(data)):
        if kind == 0x1A45DFA3:
            out["doctype"] = next((data[x:y].decode("latin-1") for e, x, y in _elements(data, a, b) if e == DOCTYPE), "")
        for k, c, d in _elements(data, a, b) if kind == SEGMENT else ():
            if k == INFO:
                for e, x, y in _elements(data, c, d):
                    if e == SCALE:
                        out["scale_ns"] = uint(x, y)
                    elif e == DURATION:
                        out["duration_ms"] = struct.unpack(">f" if y - x == 4 else ">d", data[x:y])[0] * out["scale_ns"] / 1e6
                    elif e == MUXER:
                        out["muxer"] = data[x:y].decode("utf-8", "replace")
            elif k == TRACKS:
                for e, x, y in _elements(data, c, d):
                    if e == TRACK:
                        t: dict = {"number": 0, "kind": "", "codec": "", "width": 0, "height": 0, "private": b"", "alpha": False}
                        for f, p, q in _elements(data, x, y):
                            if f == NUMBER:
                                t["number"] = uint(p, q)
                            elif f == TYPE:
                                t["kind"] = {1: "video", 2: "audio"}.get(uint(p, q), "other")
                            elif f == CODEC:
                                t["codec"] = data[p:q].decode("latin-1")
                            elif f == PRIVATE:
                                t["private"] = data[p:q]
                            elif f == VIDEO:
                                t["alpha"] = any(g == ALPHA_MODE and uint(r, s) for g, r, s in _elements(data, p, q))
                                t |= {{WIDTH: "width", HEIGHT: "height"}[g]: uint(r, s) for g, r, s in _elements(data, p, q) if g in (WIDTH, HEIGHT)}
                        out["tracks"].append(t)
            elif k == CUES:
                for e, x, y in _elements(data, c, d):
                    if e == CUE:
                        inner = list(_elements(data, x, y))
                        time = next((uint(p, q) for f, p, q in inner if f == CUE_TIME), None)
                        place = next((uint(r, s) for f, p, q in inner if f == CUE_PLACES for g, r, s in _elements(data, p, q) if g == CUE_CLUSTER), None)
                        if time is not None:
                            out["cues"].append(time)
                            seek.append(time * out["scale_ns"] / 1e6)
                            places.append(None if place is None else a + place)
            elif k == CLUSTER:
                base = 0
                for e, x, y in _elements(data, c, d):
                    if e == TIME:
                        base = uint(x, y)
                    elif e == SIMPLE:
                        block(x, y, base, None)
                    elif e == GROUP:
                        inner = list(_elements(data, x, y))
                        for f, p, q in inner:
                            if f == BLOCK:
                                block(p, q, base, not any(g == REFERENCE for g, *_ in inner))
                                added = [(r, s) for g, m, n in inner if g == ADDITIONS for h, u, v in _elements(data, m, n) if h == ADDITION for i, r, s in _elements(data, u, v) if i == ADDED]
                                if added:
                                    alpha[len(blocks["key"]) - 1] = {"alpha_offset": added[0][0], "alpha_size": added[0][1] - added[0][0]}
            out["partial"] |= d >= len(data) and k == CLUSTER and not blocks["key"]
    n = len(blocks["key"])
    own = {c: np.frombuffer(v, dtype={"pts_ms": np.float64, "key": np.bool_}.get(c, np.int64)) if n else np.zeros(0) for c, v in blocks.items()}
    times = np.frombuffer(seek, dtype=np.float64) if len(seek) else np.zeros(0)
    out["seek"] = Columns(len(seek), pts_ms=times, cluster=places)
    out["blocks"] = Columns(n, alpha, **own) if n else Columns(len(seek), track=0, pts_ms=times, offset=None, size=0, key=True)
    return out


def webm_decoder_config(track: dict) -> dict:
    """What a decoder is set up with: codec string, coded size, and the header that the track carries."""
    names = {"V_VP8": "vp8", "V_VP9": "vp09.00.10.08", "V_AV1": "av01.0.01M.08", "V_MPEG4/ISO/AVC": "avc1.42001e", "V_MPEGH/ISO/HEVC": "hvc1.1.6.L93.B0"}
    kind, private = track["codec"].upper(), track.get("private") or b""
    codec = names.get(kind, "")
    if kind == "V_MPEG4/ISO/AVC" and len(private) >= 4:
        codec = f"avc1.{private[1:4].hex()}"
    return {"codec": codec, "width": track["width"], "height": track["height"], "description": private or None}


# --- raw H.264 ---


def _marks(data: bytes) -> Iterator[tuple[int, int, int]]:
    """Where each start code of three or four bytes begins, where its unit does, and where that ends."""
    last = None
    for m in re.finditer(b"\x00\x00\x00?\x01", data):
        if last:
            yield *last, m.start()
        last = m.span()
    if last:
        yield *last, len(data)


def _unit(data: bytes, a: int, b: int) -> bytes:
    return data[a:b].rstrip(b"\0") or data[a:b]


def split_annex_b(data: bytes) -> list[bytes]:
    """Units between start codes of three or four bytes."""
    return [u for _, a, b in _marks(data) if (u := _unit(data, a, b))]


def _access_units(data: bytes, fps: float) -> tuple[Columns, dict[int, bytes]]:
    """Samples with their places in the file, and the first unit of each kind of parameter set."""
    sizes, offsets, lengths, keys = array("q"), array("q"), array("q"), bytearray()
    held, begin, sets = 0, None, {}
    for mark, a, b in _marks(data):
        begin = mark if begin is None else begin
        unit = _unit(data, a, b)
        if not unit:
            continue
        kind = unit[0] & 31
        held += len(unit) + 4
        if kind in (7, 8):
            sets.setdefault(kind, unit)
        if kind in (1, 5):
            for c, v in ((sizes, held), (offsets, begin), (lengths, b - begin), (keys, kind == 5)):
                c.append(v)
            held, begin = 0, b
    n = len(keys)
    size, offset, length = (np.frombuffer(c, dtype=np.int64) if n else np.zeros(0, dtype=np.int64) for c in (sizes, offsets, lengths))
    pts = np.rint(np.arange(n) * 1_000_000 / fps).astype(np.int64)
    return Columns(n, size=size, offset=offset, stretch=length, key=np.frombuffer(keys, dtype=np.bool_) if n else np.zeros(0, dtype=bool), pts=pts, duration=round(1_000_000 / fps)), sets


def access_units(data: bytes, fps: float = 30.0) -> Columns:
    """Samples of a raw stream: each slice closes one, together with the parameter sets before it; a key if it is IDR."""
    found = _access_units(data, fps)[0]
    return Columns(len(found), **{c: found.columns[c] for c in ("size", "key", "pts", "duration")})


class _Golomb:
    def __init__(self, data: bytes) -> None:
        clean = bytearray()
        for b in data:  # 00 00 03 stands for 00 00
            if not (b == 3 and clean[-2:] == b"\0\0"):
                clean.append(b)
        self.bits, self.at = "".join(f"{b:08b}" for b in clean), 0

    def u(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise DemuxError("cut off")
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        v = self.ue()
        return (v + 1) // 2 if v & 1 else -(v // 2)


def read_sps(unit: bytes) -> tuple[int, int] | None:
    """Width and height of a sequence parameter set; None if it is cut off."""
    try:
        r = _Golomb(unit[4:])
        profile = unit[1]
        r.ue()
        chroma = 1
        if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128):
            chroma = r.ue()
            if chroma == 3:
                r.u(1)
            r.ue(), r.ue(), r.u(1)
            if r.u(1):
                for i in range(8 if chroma != 3 else 12):
                    if r.u(1):
                        last = following = 8
                        for _ in range(16 if i < 6 else 64):
                            if following:
                                following = (last + r.se()) & 255
                            last = following or last
        r.ue()
        order = r.ue()
        if order == 0:
            r.ue()
        elif order == 1:
            r.u(1), r.se(), r.se()
            for _ in range(r.ue()):
                r.se()
        r.ue(), r.u(1)
        width, rows = (r.ue() + 1) * 16, r.ue() + 1
        frames = r.u(1)
        if not frames:
            r.u(1)
        r.u(1)
        height = rows * 16 * (2 - frames)
        if r.u(1):
            left, right, top, bottom = r.ue(), r.ue(), r.ue(), r.ue()
            ux, uy = (1 if chroma in (0, 3) else 2), (2 if chroma == 1 else 1) * (2 - frames)
            width, height = width - (left + right) * ux, height - (top + bottom) * uy
        return width, height
    except (DemuxError, IndexError):
        return None


def build_avcc(sps: bytes, pps: bytes) -> bytes:
    return bytes([1, *sps[1:4], 0xFF, 0xE1]) + struct.pack(">H", len(sps)) + sps + b"\x01" + struct.pack(">H", len(pps)) + pps


def annex_b_track(data: bytes, fps: float = 30.0) -> dict:
    """A raw stream as a track: samples with places and sizes in the file, the picture's size, a decoder's description."""
    found, sets = _access_units(data, fps)
    if not len(found):
        raise DemuxError("no pictures in the stream")
    sps, pps = (sets.get(k, b"") for k in (7, 8))
    size = read_sps(sps) if len(sps) > 4 else None
    c = found.columns
    rows = Columns(len(found), size=c["stretch"], key=c["key"], pts=c["pts"], duration=c["duration"], offset=c["offset"], dts=c["pts"], cts=0)
    return {
        "kind": "video", "codec": f"avc1.{sps[1:4].hex()}" if len(sps) >= 4 else "avc1.42001e", "width": size[0] if size else 0, "height": size[1] if size else 0, "timescale": 1_000_000,
        "samples": rows, "edit_delay": 0, "rotation": 0, "description": build_avcc(sps, pps) if sps and pps else None, "encrypted": False,
    }


# --- RIFF: AVI, WAVE and others ---


def write_avi(frames: list[bytes], width: int, height: int, fps: float = 10.0) -> bytes:
    """24-bit pictures (RGB rows from the top) as an AVI file with an index."""
    pitch = (width * 3 + 3) // 4 * 4

    def chunk(tag: bytes, body: bytes) -> bytes:
        return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    movi, index, at = b"movi", b"", 4
    for rgb in frames:
        rows = [rgb[y * width * 3 : (y + 1) * width * 3] for y in reversed(range(height))]
        dib = b"".join(b"".join(row[i + 2 : i + 3] + row[i + 1 : i + 2] + row[i : i + 1] for i in range(0, len(row), 3)).ljust(pitch, b"\0") for row in rows)
        index += b"00db" + struct.pack("<III", 0x10, at, len(dib))
        part = chunk(b"00db", dib)
        movi, at = movi + part, at + len(part)
    avih = struct.pack("<14I", round(1e6 / fps), 0, 0, 0x10, len(frames), 0, 1, pitch * height, width, height, 0, 0, 0, 0)
    strh = b"vidsDIB " + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1000, round(fps * 1000), 0, len(frames), pitch * height, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, pitch * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", movi) + chunk(b"idx1", index))


#: What a list of facts calls them.
RIFF_INFO = {"INAM": "name", "IART": "artist", "ICMT": "comment", "ICRD": "date", "ISFT": "software", "IGNR": "genre", "IPRD": "product", "IENG": "engineer"}


def parse_riff(data: bytes) -> dict:
    """``form``, ``info`` (facts by name), ``chunks`` (tag, offset, size) of all levels, ``partial``; of a WAVE its channels and
    rate; of an AVI its streams, size, rate, ``open_dml_frames`` and where its pictures are. RIFX is RIFF the other way round."""
    if data[:4] not in (b"RIFF", b"RIFX") or len(data) < 12:
        raise DemuxError("no RIFF file")
    end = "<" if data[:4] == b"RIFF" else ">"
    u16, u32 = (lambda at, f=f: struct.unpack_from(end + f, data, at)[0] for f in "HI")
    out: dict = {"form": data[8:12].decode("latin-1"), "big": end == ">", "info": {}, "chunks": [], "streams": [], "partial": False, "open_dml_frames": None, "fps": 0.0, "width": 0, "height": 0, "total_frames": 0, "codec": "", "has_alpha": False}
    todo = [(12, min(len(data), 8 + u32(4)), "")]
    while todo:
        at, stop, inside = todo.pop()
        while at + 8 <= stop:
            tag, size, body = data[at : at + 4].decode("latin-1"), u32(at + 4), at + 8
            out["partial"] |= body + size > len(data)
            span = (body, min(body + size, stop))
            kind, there = data[body : body + 4].decode("latin-1") if tag == "LIST" else "", span[1] - body
            out["chunks"].append({"tag": tag, "list": kind, "inside": inside, "offset": body, "size": size})
            if tag == "LIST":
                todo.append((body + 4, span[1], kind))
            elif inside == "INFO" and tag in RIFF_INFO:
                out["info"][RIFF_INFO[tag]] = data[span[0] : span[1]].split(b"\0")[0].decode("latin-1")
            elif tag == "fmt " and there >= 8:
                out |= {"channels": u16(body + 2), "sample_rate": u32(body + 4)}
            elif tag == "data" and out["form"] == "WAVE":
                out["data_bytes"] = size
            elif tag == "avih" and there >= 40:
                out |= {"fps": 1e6 / u32(body) if u32(body) else 0.0, "total_frames": u32(body + 16), "width": u32(body + 32), "height": u32(body + 36)}
            elif tag == "strh" and there >= 36:
                out["streams"].append({"kind": data[body : body + 4].decode("latin-1"), "handler": data[body + 4 : body + 8].decode("latin-1"), "fps": u32(body + 24) / u32(body + 20) if u32(body + 20) else 0.0, "length": u32(body + 32)})
            elif tag == "strf" and there >= 40 and out["streams"] and out["streams"][-1]["kind"] == "vids":
                out |= {"codec": data[body + 16 : body + 20].rstrip(b"\0").decode("latin-1") or "DIB", "has_alpha": u16(body + 14) == 32}
            elif tag == "dmlh" and there >= 4:
                out["open_dml_frames"] = u32(body)
            at = body + size + (size & 1)
    return out


def parse_avi(data: bytes) -> dict:
    """``frames`` (offset, size, key), ``fps``, size, whether they come from a valid ``index`` or from a walk over the chunks.

    Offsets of an index count from the list of pictures or from the file, before or after a chunk's head: the base is taken by
    which every entry is a chunk of its tag and size."""
    out = parse_riff(data)
    if out["form"] != "AVI ":
        raise DemuxError("no AVI file")
    end = ">" if out["big"] else "<"
    pictures = [c for c in out["chunks"] if c["inside"] in ("movi", "rec ") and c["tag"][2:] in ("db", "dc", "pb", "pc") and c["tag"][:2].isdigit() and c["size"]]
    walked = sorted((c["offset"], min(c["size"], len(data) - c["offset"]), True) for c in pictures)
    places = {c["offset"]: (c["tag"], c["size"]) for c in pictures}
    movi = next((c["offset"] for c in out["chunks"] if c["list"] == "movi"), None)
    index = next((c for c in out["chunks"] if c["tag"] == "idx1"), None)
    entries = []
    if index:
        raw = data[index["offset"] : index["offset"] + index["size"]]
        entries = [(tag.decode("latin-1"), flags, at, n) for tag, flags, at, n in struct.iter_unpack(end + "4sIII", raw[: len(raw) // 16 * 16]) if tag[2:] in (b"db", b"dc", b"pb", b"pc")]
    facts = {"fps": out["fps"], "width": out["width"], "height": out["height"], "info": out["info"], "partial": out["partial"], "open_dml_frames": out["open_dml_frames"], "codec": out["codec"], "has_alpha": out["has_alpha"], "streams": out["streams"]}
    for base in (movi + 8, movi + 4, movi, 8, 0) if movi is not None else ():
        if entries and all(places.get(base + at) == (tag, n) for tag, _, at, n in entries):
            return facts | {"frames": [(base + at, n, bool(flags & 0x10)) for _, flags, at, n in entries], "index": True}
    return facts | {"frames": walked, "index": False}


# --- over columns ---

SAMPLES = "track int, sample_idx int, offset bigint, size bigint, pts_ms double, key boolean, error string"


def samples(files: DataFrame, data: str = "content", key: str = "path") -> DataFrame:
    """A row for each sample of each file, whatever its container; files that can't be read give one row with ``error``."""
    kind = files.schema[key].dataType

    def of(raw: bytes) -> Iterator[tuple]:
        """Stretches of a file's rows as columns: how many, the number of the first, and values as ``SAMPLES`` has them from then on."""
        try:
            if raw[4:8] in (b"ftyp", b"moov"):
                for t, track in enumerate(parse_mp4(raw)["tracks"]):
                    s = track["samples"]
                    for a, b in _slices(len(s)):
                        offset, size, pts, key = (s.columns[c][a:b] for c in ("offset", "size", "pts", "key"))
                        yield b - a, t, a, offset, size, pts * 1000 / max(1, track["timescale"]), key, None
            elif raw[:4] == b"\x1aE\xdf\xa3":
                s = parse_webm(raw)["blocks"]
                for a, b in _slices(len(s)):
                    track, offset, size, pts, key = (s.part(c, a, b) for c in ("track", "offset", "size", "pts_ms", "key"))
                    yield b - a, track, a, offset, size, pts, key, None
            elif raw[:4] == b"RIFF":
                avi = parse_avi(raw)
                for a, b in _slices(len(avi["frames"])):
                    offset, size, key = zip(*avi["frames"][a:b], strict=True)
                    yield b - a, 0, a, offset, size, [i * 1000 / (avi["fps"] or 10) for i in range(a, b)], key, None
            else:
                raise DemuxError("unknown container")
        except (DemuxError, struct.error, TypeError, IndexError) as e:
            yield 1, None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string())
        for k, raw in contents(batches, data, key):
            for n, track, first, *rest in of(raw):
                values = [track, None if first is None else np.arange(first, first + n, dtype=np.int32), *rest]
                yield pa.RecordBatch.from_arrays([pa.repeat(k, n), *(pa.repeat(pa.scalar(v, type=t), n) if v is None or isinstance(v, (int, str)) else pa.array(v, type=t) for v, t in zip(values, kinds, strict=True))], names=[key, "track", "sample_idx", "offset", "size", "pts_ms", "key", "error"])
            del raw

    one_at_a_time(files.sparkSession)
    return files.select(key, data).mapInArrow(run, f"{key} {kind.simpleString()}, {SAMPLES}")


def _slices(n: int) -> Iterator[tuple[int, int]]:
    return ((a, min(a + SLICE, n)) for a in range(0, n, SLICE))


def contents(batches: Iterator[pa.RecordBatch], data: str, *more: str) -> Iterator[tuple]:
    """The columns ``more`` and the bytes of each file, one file at a time; null data is none."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield *(batch.column(c)[i] for c in more), batch.column(data)[i].as_py() or b""
        del batch
        give_back()


def expand_runs(runs: DataFrame, count: str, value: str, order: str, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Run-length tables (``count`` times ``value``) to samples with their running sums: ``sample_idx``, ``value``, ``dts``."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(count)).over(w), F.lit(0))
    before = F.coalesce(F.sum(F.col(count) * F.col(value)).over(w), F.lit(0))
    # runs know where they start, so samples need no window
    out = runs.withColumns({"_s": start, "_b": before}).where(F.col(count) > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)))
    return out.select(*keys, (F.col("_s") + F.col("_k")).cast("bigint").alias("sample_idx"), F.col(value).alias("value"), (F.col("_b") + F.col("_k") * F.col(value)).alias("dts"))


def chunk_runs(chunks: DataFrame, runs: DataFrame, first: str = "first_chunk", chunk: str = "chunk", key: str = "track_id", span: int = 1024) -> DataFrame:
    """Range join: each chunk with the last run whose first chunk isn't beyond it. One sort of the union, no pairs.

    The union is dealt by key and span of ``span`` chunk numbers, so that a long track isn't one task; what is open at a
    span's start is the last run of the spans before, of which there is a row each."""
    from pyspark.sql import Window as W

    values = [c for c in runs.columns if c not in (key, first)]
    both = chunks.select(key, F.col(chunk).alias("_c"), F.lit(1).alias("_side"), F.struct(*[c for c in chunks.columns if c != key]).alias("_row")).unionByName(
        runs.select(key, F.col(first).alias("_c"), F.lit(0).alias("_side"), F.struct(*values).alias("_v")), allowMissingColumns=True
    )
    both = both.withColumn("_span", F.floor(F.col("_c") / span)).repartition(many_tasks(chunks.sparkSession), key, "_span")
    inside = F.last("_v", ignorenulls=True).over(W.partitionBy(key, "_span").orderBy("_c", "_side").rowsBetween(W.unboundedPreceding, 0))
    ends = both.groupBy(F.col(key).alias("_k"), F.col("_span").alias("_s")).agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_c"))).alias("_e"))
    earlier = F.last("_e", ignorenulls=True).over(W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1))
    opened = ends.select("_k", "_s", earlier.alias("_e"))
    found = both.withColumn("_v", inside).where("_side = 1").join(opened, (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("_span").eqNullSafe(F.col("_s"))), "left")
    return found.withColumn("_v", F.coalesce("_v", "_e")).select(key, "_row.*", *(F.col(f"_v.{v}").alias(v) for v in values))
