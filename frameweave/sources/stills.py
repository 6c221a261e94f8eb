"""Facts of still pictures by their headers: size, animation, alpha, orientation. Nothing is decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FACTS = "format string, width int, height int, frames int, has_alpha boolean, orientation int, error string"


def png(data: bytes) -> dict:
    width, height, _, color = struct.unpack_from(">IIBB", data, 16)
    out = {"format": "png", "width": width, "height": height, "frames": 1, "has_alpha": color in (4, 6)}
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"acTL" and size >= 8:
            out["frames"] = struct.unpack_from(">I", data, at + 8)[0]
        out["has_alpha"] |= kind == b"tRNS"
        at += 12 + size
    return out


def jpeg(data: bytes) -> dict:
    out = {"format": "jpeg", "frames": 1, "has_alpha": False, "orientation": 1}
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if mark in (0xC0, 0xC1, 0xC2, 0xC3):
            out["height"], out["width"] = struct.unpack_from(">HH", data, at + 5)
            return out
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            out["orientation"] = _orientation(data[at + 10 : at + 2 + size])
        at += 2 + size
    raise ValueError("no frame header")


def _orientation(tiff: bytes) -> int:
    order = "<" if tiff[:2] == b"II" else ">"
    first = struct.unpack_from(order + "I", tiff, 4)[0]
    for i in range(struct.unpack_from(order + "H", tiff, first)[0]):
        tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, first + 2 + 12 * i)
        if tag == 0x0112 and 1 <= value <= 8:
            return value
    return 1


def webp(data: bytes) -> dict:
    out = {"format": "webp", "frames": 0, "has_alpha": False}
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if kind == b"VP8X":
            out |= {"has_alpha": bool(data[body] & 0x10), "width": 1 + int.from_bytes(data[body + 4 : body + 7], "little"), "height": 1 + int.from_bytes(data[body + 7 : body + 10], "little")}
        elif kind == b"VP8 " and "width" not in out:
            out["width"], out["height"] = (v & 0x3FFF for v in struct.unpack_from("<HH", data, body + 6))
        elif kind == b"VP8L" and "width" not in out:
            bits = struct.unpack_from("<I", data, body + 1)[0]
            out |= {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF), "has_alpha": bool(bits >> 28 & 1)}
        out["frames"] += kind == b"ANMF"
        at = body + size + (size & 1)
    return out | {"frames": max(1, out["frames"])}


def bmp(data: bytes) -> dict:
    width, height, _, bits = struct.unpack_from("<iiHH", data, 18)
    return {"format": "bmp", "width": abs(width), "height": abs(height), "frames": 1, "has_alpha": bits == 32}


def summarize(data: bytes) -> dict:
    """Facts of a picture; ``error`` says why there are none."""
    kinds = ((b"\x89PNG\r\n\x1a\n", 0, png), (b"\xff\xd8", 0, jpeg), (b"WEBP", 8, webp), (b"BM", 0, bmp))
    for magic, at, f in kinds:
        if data[at : at + len(magic)] == magic:
            try:
                return f(data)
            except (struct.error, IndexError, ValueError) as e:
                return {"error": f"{type(e).__name__}: {e}"}
    return {"error": "no known picture"}


def summaries(files: DataFrame, data: str = "content", key: str = "path") -> DataFrame:
    """``key`` and the facts of each file's first 64 KiB and what follows."""
    kind = files.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in FACTS.split(", ")]
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [summarize(x or b"") for x in b.column(data).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([r.get(n) for r in rows], type=t) for n, t in zip(names, types, strict=True))], names=[key, *names])

    return files.select(key, data).mapInArrow(run, f"{key} {kind}, {FACTS}")
