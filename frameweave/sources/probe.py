"""The front door: bytes from files, data URLs and columns, and what they are, in one schema for every format.

``probe`` never fails for bytes that it knows by their head: what can't be parsed gives ``partial`` and ``parse_error`` beside
what was found out before. ``probes`` does that for a column of binary data, in Arrow batches.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import demux, gif, stills
from .columns import one_at_a_time

#: Bytes that are looked at to tell a format.
SNIFF_BYTES = 64 * 1024

#: Formats with their extensions, MIME types, and whether their pictures can be decoded (None: some can).
FORMATS: dict[str, tuple[tuple[str, ...], tuple[str, ...], bool | None]] = {
    "mp4": (("mp4", "m4v", "mov", "m4a", "f4v"), ("video/mp4", "video/quicktime", "audio/mp4"), True),
    "webm": (("webm",), ("video/webm",), True), "mkv": (("mkv", "mka"), ("video/x-matroska",), True), "avi": (("avi",), ("video/x-msvideo",), None),
    "gif": (("gif",), ("image/gif",), True), "png": (("png", "apng"), ("image/png",), True), "jpeg": (("jpg", "jpeg", "jpe"), ("image/jpeg",), True),
    "webp": (("webp",), ("image/webp",), True), "avif": (("avif",), ("image/avif",), True), "bmp": (("bmp", "dib"), ("image/bmp",), True),
    "ico": (("ico", "cur"), ("image/vnd.microsoft.icon",), True), "tiff": (("tif", "tiff"), ("image/tiff",), True), "svg": (("svg", "svgz"), ("image/svg+xml",), True),
    "pdf": (("pdf",), ("application/pdf",), False), "zip": (("zip",), ("application/zip",), None), "flac": (("flac",), ("audio/flac",), False),
    "mp3": (("mp3",), ("audio/mpeg",), False), "m3u8": (("m3u8",), ("application/vnd.apple.mpegurl",), False), "tg": (("tg",), ("video/telegram",), False),
}


class InputError(ValueError):
    """Input that isn't there, too large or malformed; ``code`` tells which."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def read_data_url(url: str) -> bytes:
    """The bytes of a ``data:`` URL; base 64 may be the URL-safe kind, be broken into lines and lack its padding."""
    head, sep, body = url.partition(",")
    if not sep or not head.lower().startswith("data:"):
        raise InputError("input-invalid", "no data URL")
    if not head.lower().endswith(";base64"):
        from urllib.parse import unquote_to_bytes

        return unquote_to_bytes(body)
    return decode_base64(body)


def decode_base64(text: str) -> bytes:
    clean = re.sub(r"\s", "", text).replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(clean + "=" * (-len(clean) % 4), validate=True)
    except binascii.Error as e:
        raise InputError("input-base64", str(e)) from None


def encode_base64(data: bytes, url_safe: bool = False, line: int | None = None) -> str:
    """Base 64; ``url_safe`` leaves out the padding; ``line``: characters of a line."""
    text = base64.urlsafe_b64encode(data).decode().rstrip("=") if url_safe else base64.b64encode(data).decode()
    return "\n".join(text[i : i + line] for i in range(0, len(text), line)) if line else text


def read_files(spark: SparkSession, path: str, pattern: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """Files below ``path`` by Spark's own reader (any scheme that it knows): ``path``, ``length``, ``content``, ``error``.

    Files of more than ``most_bytes`` are a row with the error ``too-large`` and no content, which isn't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).select("path", "length", "content")
    if most_bytes is None:
        return files.withColumn("error", F.lit(None).cast("string"))
    small = files.where(F.col("length") <= most_bytes).withColumn("error", F.lit(None).cast("string"))  # the source skips the others
    large = files.select("path", "length").where(F.col("length") > most_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too-large").alias("error"))
    return small.unionByName(large)


def by_extension(name: str) -> str | None:
    found = re.search(r"\.([a-z0-9]{2,5})($|[?#])", name.lower())
    return next((f for f, (known, *_) in FORMATS.items() if found and found[1] in known), None)


def sniff(data: bytes, name: str = "") -> tuple[str | None, str | None, float]:
    """Format, MIME type and confidence; by the extension, or not at all, where the head says nothing. As ``demux.identify``."""
    head = data[:SNIFF_BYTES]
    if head[:4] in (b"RIFF", b"RIFX"):
        return demux.RIFF.get(head[8:12].hex().upper(), ("riff", "application/octet-stream", 0.6))
    for at, digits, fmt, mime, sure in demux.MAGIC:
        magic = bytes.fromhex(digits)
        if head[at : at + len(magic)] == magic:
            return fmt, ("video/quicktime" if fmt == "mp4" and head[8:12] == b"qt  " else mime), sure
    if re.match(rb"\s*(<\?xml[\s\S]{0,400}?)?<svg", head[:512], re.I):
        return "svg", "image/svg+xml", 0.95
    known = by_extension(name)
    return (known, FORMATS[known][1][0], 0.4) if known else (None, None, 0.0)


def _mp4(data: bytes) -> dict:
    m = demux.parse_mp4(data)
    video = next((t for t in m["tracks"] if t["kind"] == "video"), None)
    out = {"duration_ms": m["duration_ms"], "rotation": m["rotation"], "partial": m["partial"], "fast_start": m["fast_start"], "fragmented": m["fragments"] > 0, "encrypted": m["encrypted"]}
    if video:
        out |= {"width": video["width"], "height": video["height"], "frames": len(video["samples"]), "codec": video["codec"], "bit_depth": video["bit_depth"], "colour": video["colour"]}
        out["duration_ms"] = out["duration_ms"] or int(video["samples"].array("duration").sum()) * 1000 / max(1, video["timescale"])
    return out


def _webm(data: bytes) -> dict:
    w = demux.parse_webm(data)
    video = next((t for t in w["tracks"] if t["kind"] == "video"), None)
    out = {"duration_ms": w["duration_ms"] or 0.0, "partial": w["partial"], "muxer": w["muxer"]}
    if video:
        blocks = w["blocks"]
        own = np.isin(blocks.array("track"), (0, video["number"]))
        out |= {"width": video["width"], "height": video["height"], "frames": int(own.sum()), "codec": demux.webm_decoder_config(video)["codec"], "has_alpha": video["alpha"] or any(own[i] and "alpha_offset" in x for i, x in blocks.extra.items())}
    return out


def _riff(data: bytes) -> dict:
    r = demux.parse_riff(data)
    if r["form"] != "AVI ":
        return {"partial": r["partial"], "muxer": r["info"].get("software")}
    avi = demux.parse_avi(data)
    fps = avi["fps"] or next((s["fps"] for s in avi["streams"] if s["kind"] == "vids"), 0.0)
    n = len(avi["frames"]) or avi["open_dml_frames"] or r["total_frames"]
    return {"width": avi["width"], "height": avi["height"], "frames": n, "codec": avi["codec"], "fps": fps, "duration_ms": n * 1000 / fps if fps else 0.0, "partial": avi["partial"], "has_alpha": avi["has_alpha"], "muxer": avi["info"].get("software")}


def _gif(data: bytes) -> dict:
    g = gif.parse(data, pixels=False)
    return {"width": g.width, "height": g.height, "frames": len(g.frames), "duration_ms": sum(f.delay_cs for f in g.frames) * 10.0, "partial": g.truncated, "has_alpha": any(f.transparent is not None for f in g.frames)}


def zip_entries(data: bytes) -> int:
    """Files in an archive, by its directory, or, where it is cut off, by the heads of files that are there."""
    end = data.rfind(b"PK\x05\x06")
    if end >= 0 and end + 12 <= len(data):
        return struct.unpack_from("<H", data, end + 10)[0]
    return data.count(b"PK\x03\x04")


def _h264(data: bytes) -> dict:
    t = demux.annex_b_track(data)
    return {"width": t["width"], "height": t["height"], "frames": len(t["samples"]), "codec": t["codec"], "duration_ms": int(t["samples"].array("duration").sum()) / 1000}


def _still(data: bytes) -> dict:
    facts = stills.summarize(data)
    if facts.get("error"):
        raise demux.DemuxError(facts["error"])
    return {k: facts.get(k) for k in ("width", "height", "frames", "has_alpha", "orientation")}


PARSERS = {"mp4": _mp4, "webm": _webm, "mkv": _webm, "avi": _riff, "riff": _riff, "gif": _gif, "png": _still, "jpeg": _still, "webp": _still, "bmp": _still, "zip": lambda d: {"files": zip_entries(d)}, "h264-annexb": _h264}

PROBE = (
    "format string, mime string, confidence double, size bigint, width bigint, height bigint, frames bigint, duration_ms double, fps double, bitrate bigint, codec string, bit_depth int, colour string, has_alpha boolean, "
    "rotation int, orientation int, fast_start boolean, fragmented boolean, encrypted boolean, files bigint, muxer string, can_decode boolean, partial boolean, parse_error string"
)


def probe(data: bytes, name: str = "") -> dict:
    """Facts of a file; those that its format doesn't have are missing."""
    fmt, mime, sure = sniff(data, name)
    out: dict = {"format": fmt, "mime": mime, "confidence": sure, "size": len(data), "can_decode": FORMATS[fmt][2] is not False if fmt in FORMATS else fmt == "h264-annexb", "partial": False, "parse_error": None if fmt else "unknown format"}
    if fmt in PARSERS:
        try:
            out |= {k: v for k, v in PARSERS[fmt](data).items() if v is not None}
        except (demux.DemuxError, gif.GifError, struct.error, IndexError, TypeError, ValueError) as e:
            out |= {"partial": True, "parse_error": f"{type(e).__name__}: {e}"}
    out["can_decode"] = bool(out["can_decode"]) and not out.get("encrypted")
    ms = out.get("duration_ms") or 0.0
    if not 1e-3 <= ms < 1e15:  # nothing that a clip lasts
        out["duration_ms"] = 0.0
    elif out.get("frames"):
        out["fps"] = out.get("fps") or out["frames"] * 1000 / ms
    if out["duration_ms"] if "duration_ms" in out else 0:
        out["bitrate"] = round(out["size"] * 8000 / ms) if out.get("width") else None
    return out


def probes(files: DataFrame, data: str = "content", key: str = "path", name: Column | None = None) -> DataFrame:
    """``key`` and the facts of each file. Null data is an unknown format of no bytes."""
    kind = files.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in PROBE.split(", ")]
    types = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [types[f.split()[1]] for f in PROBE.split(", ")]
    asked = files.select(key, F.col(data).alias("_data"), (name if name is not None else F.lit("")).alias("_name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [probe(d, n.as_py() or "") for n, d in demux.contents((b,), "_data", "_name")]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([r.get(n) for r in rows], type=t) for n, t in zip(names, kinds, strict=True))], names=[key, *names])

    one_at_a_time(files.sparkSession)
    return asked.mapInArrow(run, f"{key} {kind}, {PROBE}")
