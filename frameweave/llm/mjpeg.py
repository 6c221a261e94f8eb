"""AVI motion-JPEG columns: write, parse RIFF indexes, decode intra frames, detect shots, yield timed clips.

Bytes are stored losslessly as 8-bit grey samples with the lossless process of the JPEG standard (ITU-T T.81, annex H,
SOF3, predictor 1). The Huffman table gives category s a code of 9 - s bits, so that every difference takes nine
bits: such data are packed and unpacked with array operations. Other tables are decoded symbol by symbol, and so are
the frames of ordinary motion-JPEG (baseline DCT, grey or YCbCr, with or without restart intervals; frames without
tables use the standard's own). Lossless scans are read with predictor 1, one component and no point transform; other
variants are refused.

Shots: each frame has a histogram of 64 bins; a cut stands where half the L1 distance to the previous frame's
exceeds both a floor and the mean plus ``k`` standard deviations of the last distances since the cut before.

Edge cases: a null or empty text is stored as 64 zero bytes; a missing or wrong index is rebuilt by a walk over the
``movi`` list; a file without frames, null or cut off has no clips and a payload of the frames that are whole; equal
bytes give equal files. Rows are kept one to one and other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import pieces, text_bytes

WIDTH, MOST_ROWS, FPS, UNIT = 64, 64, 25, 64
BATCH_BYTES = 8 << 20

# --- fixed values of ITU-T T.81: the zigzag order (figure 5) and the typical Huffman tables (annex K.3) ---
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMA = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    list(bytes.fromhex(
        "0102030004110512213141061351610722711432 8191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    )),
)
AC_CHROMA = (
    [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    list(bytes.fromhex(
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    )),
)


class MediaError(ValueError):
    """A frame or file that cannot be decoded."""


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit symbol of each difference -255..255, and back."""
    to, back = np.zeros(511, dtype=np.uint16), np.zeros(512, dtype=np.uint8)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2  # 0, 10, 110, ... for the categories 8, 7, 6, ...
        bits = d if d >= 0 else d + (1 << s) - 1
        to[d + 255] = (code << s) | bits
        back[(code << s) | bits] = d & 255
    return to, back


TO_SYMBOL, FROM_SYMBOL = _symbols()
NINE_BIT_TABLE = ([1] * 9 + [0] * 7, [8, 7, 6, 5, 4, 3, 2, 1, 0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """JPEG (SOF3) of each of the frames (n, rows, width), 8-bit grey; rows * width is a multiple of 8."""
    n, rows, width = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    s = TO_SYMBOL[d.reshape(-1, 8) + 255]
    packed = np.empty((len(s), 9), dtype=np.uint8)
    packed[:, 0] = s[:, 0] >> 1
    for k in range(1, 8):
        packed[:, k] = ((s[:, k - 1] & ((1 << k) - 1)) << (8 - k)) | (s[:, k] >> (k + 1))
    packed[:, 8] = s[:, 7] & 255
    size = rows * width // 8 * 9
    scan = packed.tobytes()
    head = (
        b"\xff\xd8"
        + _segment(0xC3, struct.pack(">BHHBBBB", 8, rows, width, 1, 1, 0x11, 0))
        + _segment(0xC4, bytes([0, *NINE_BIT_TABLE[0], *NINE_BIT_TABLE[1]]))
        + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    )
    return [head + scan[i * size : (i + 1) * size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(n)]


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """The AVI file that holds ``payload`` (a positive multiple of 64 bytes)."""
    rows = len(payload) // WIDTH
    height = min(rows, MOST_ROWS)
    n = -(-rows // height)
    samples = np.frombuffer(payload.ljust(n * height * WIDTH, b"\0"), dtype=np.uint8).reshape(n, height, WIDTH)
    movi, index = [b"movi"], []
    at = 4
    for jpeg in encode_lossless(samples):
        chunk = _chunk(b"00dc", jpeg)
        movi.append(chunk)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(jpeg)))
        at += len(chunk)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 24, b"MJPG", WIDTH * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    body = (
        b"AVI "
        + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
        + _chunk(b"plen", struct.pack("<Q", len(payload)))
        + _chunk(b"LIST", b"".join(movi))
        + _chunk(b"idx1", b"".join(index))
    )
    return _chunk(b"RIFF", body)


def parse_avi(data: bytes) -> dict:
    """Frame places ``[(offset, size, key)]``, ``fps``, ``width``, ``height`` and ``payload_bytes`` (None if unsaid)."""
    out: dict = {"frames": [], "fps": 0.0, "width": 0, "height": 0, "payload_bytes": None}
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return out
    movi, index, todo = None, None, [(12, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, stop = at + 8, min(at + 8 + size, end)
            if tag == b"LIST" and data[body : body + 4] == b"movi":
                movi = (body, stop)
            elif tag == b"LIST":
                todo.append((body + 4, stop))
            elif tag == b"avih" and stop - body >= 40:
                micros, out["width"], out["height"] = *struct.unpack_from("<I", data, body), *struct.unpack_from("<II", data, body + 32)
                out["fps"] = out["fps"] or (1e6 / micros if micros else 0.0)
            elif tag == b"strh" and data[body : body + 4] == b"vids" and stop - body >= 28:
                scale, rate = struct.unpack_from("<II", data, body + 20)
                out["fps"] = rate / scale if scale and rate else out["fps"]
            elif tag == b"plen" and stop - body >= 8:
                out["payload_bytes"] = struct.unpack_from("<Q", data, body)[0]
            elif tag == b"idx1":
                index = (body, stop)
            at = body + size + (size & 1)
    if movi:
        out["frames"] = (_from_index(data, movi, *index) if index else None) or _walk(data, *movi)
    return out


def _from_index(data: bytes, movi: tuple[int, int], at: int, end: int) -> list | None:
    """Frames of ``idx1``; None unless every entry lands on its own chunk, from the list or from the file's start."""
    entries = [e for e in struct.iter_unpack("<4sIII", data[at : at + (end - at) // 16 * 16]) if e[0][2:] in (b"dc", b"db")]
    for base in (movi[0], 0):
        found = []
        for tag, flags, offset, size in entries:
            place = base + offset
            if data[place : place + 4] != tag or data[place + 4 : place + 8] != struct.pack("<I", size) or place + 8 + size > len(data):
                break
            found.append((place + 8, size, bool(flags & 0x10)))
        else:
            if found:
                return found
    return None


def _walk(data: bytes, at: int, end: int) -> list:
    found, at = [], at + 4
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag == b"LIST":
            at += 12
            continue
        if tag[2:] in (b"dc", b"db") and size and at + 8 + size <= end:
            found.append((at + 8, size, True))
        at += 8 + size + (size & 1)
    return found


def _header(jpeg: bytes) -> dict:
    """Tables, frame and scan header of a JPEG; ``scan`` is where its entropy-coded data begin."""
    if jpeg[:2] != b"\xff\xd8":
        raise MediaError("no SOI marker")
    info: dict = {"huff": {}, "quant": {}, "restart": 0}
    at = 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise MediaError("a marker is missing")
        marker = jpeg[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            while len(body) >= 17:
                counts = list(body[1:17])
                info["huff"][body[0]] = (counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1, 0xC3):
            bits, info["rows"], info["width"], n = struct.unpack_from(">BHHB", body)
            info |= {"kind": marker, "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
            if bits != 8:
                raise MediaError(f"samples of {bits} bits")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise MediaError(f"coding process {marker:#x}")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                info["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xDD:
            info["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if "kind" not in info:
                raise MediaError("a scan without a frame header")
            n = body[0]
            info |= {"tables": {body[1 + 2 * i]: body[2 + 2 * i] for i in range(n)}, "predictor": body[1 + 2 * n], "transform": body[3 + 2 * n] & 15, "scan": at}
            return info
    raise MediaError("no scan")


def _codes(table: tuple[list[int], list[int]]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a canonical Huffman table."""
    counts, symbols = table
    out, code, k = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """Bits of one restart interval."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).tolist(), 0

    def symbol(self, codes: dict) -> int:
        code = 0
        for length in range(1, 17):
            if self.at >= len(self.data):
                raise MediaError("the scan is cut off")
            code = code << 1 | self.data[self.at]
            self.at += 1
            if (length, code) in codes:
                return codes[length, code]
        raise MediaError("no such code")

    def value(self, s: int) -> int:
        """The signed value of category ``s`` that follows."""
        v = 0
        for b in self.data[self.at : self.at + s]:
            v = v << 1 | b
        self.at += s
        return v if not s or v >> (s - 1) else v - (1 << s) + 1


def _intervals(scan: bytes) -> list[bytes]:
    """Entropy-coded data up to the next marker that isn't RSTn, cut at those, without stuffing."""
    out, start, at = [], 0, scan.find(b"\xff")
    while at >= 0:
        follow = scan[at + 1] if at + 1 < len(scan) else 0xD9
        if 0xD0 <= follow <= 0xD7:
            out.append(scan[start:at])
            start = at + 2
        elif follow:
            break
        at = scan.find(b"\xff", at + 2)
    out.append(scan[start : at if at >= 0 else len(scan)])
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _unpack(data: np.ndarray) -> np.ndarray:
    """Nine-byte groups to eight nine-bit symbols."""
    p = data.reshape(-1, 9).astype(np.uint16)
    s = np.empty((len(p), 8), dtype=np.uint16)
    for k in range(8):
        s[:, k] = ((p[:, k] & ((1 << (8 - k)) - 1)) << (k + 1)) | (p[:, k + 1] >> (7 - k))
    return s


def _integrate(d: np.ndarray) -> np.ndarray:
    """Samples (n, rows, width) from differences modulo 256 under predictor 1."""
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.uint8)
    return np.cumsum(d, axis=2, dtype=np.uint8)


def _lossless(info: dict, jpeg: bytes) -> np.ndarray:
    if len(info["parts"]) != 1 or info["predictor"] != 1 or info["transform"] or info["restart"]:
        raise MediaError("this lossless variant is not supported")
    part = info["parts"][0][0]
    codes = _codes(info["huff"][info["tables"][part] >> 4])
    bits = _Bits(_intervals(jpeg[info["scan"] :])[0])
    d = np.fromiter((bits.value(bits.symbol(codes)) & 255 for _ in range(info["rows"] * info["width"])), dtype=np.uint8)
    return _integrate(d.reshape(1, info["rows"], info["width"]))[0]


def _basis() -> np.ndarray:
    k, x = np.mgrid[0:8, 0:8]
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 1 / 2)


def _baseline(info: dict, jpeg: bytes) -> np.ndarray:
    """Grey samples of a baseline frame: the first component."""
    std = {0x00: DC_LUMA, 0x10: AC_LUMA, 0x01: DC_CHROMA, 0x11: AC_CHROMA}
    tables = {k: _codes(v) for k, v in (std | info["huff"]).items()}
    parts = info["parts"]
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-info["width"] // (8 * hmax)), -(-info["rows"] // (8 * vmax))
    id0, h0, v0, q0 = parts[0]
    plane = np.zeros((down * v0 * 8, across * h0 * 8))
    basis, quant = _basis(), info["quant"].get(q0)
    if quant is None:
        raise MediaError("no quantization table")
    runs = iter(_intervals(jpeg[info["scan"] :]))
    bits, last = _Bits(next(runs)), dict.fromkeys((p[0] for p in parts), 0)
    for unit in range(across * down):
        if info["restart"] and unit and unit % info["restart"] == 0:
            bits, last = _Bits(next(runs, b"")), dict.fromkeys(last, 0)
        for pid, h, v, _ in parts:
            dc, ac = tables[info["tables"][pid] >> 4], tables[0x10 | info["tables"][pid] & 15]
            for sub in range(h * v):
                block = np.zeros(64)
                last[pid] += bits.value(bits.symbol(dc))
                block[0], k = last[pid], 1
                while k < 64:
                    run = bits.symbol(ac)
                    if run == 0:
                        break
                    k += run >> 4
                    if run & 15:
                        value = bits.value(run & 15)
                        if k < 64:
                            block[k] = value
                    k += 1
                if pid == id0:
                    square = np.zeros(64)
                    square[ZIGZAG] = block * quant
                    y, x = (unit // across * v + sub // h) * 8, (unit % across * h + sub % h) * 8
                    plane[y : y + 8, x : x + 8] = basis.T @ square.reshape(8, 8) @ basis
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[: info["rows"] * v0 // vmax, : info["width"] * h0 // hmax]


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray]:
    """Grey samples of every frame; frames with nine-bit symbols and one shape are decoded together."""
    heads = [_header(j) for j in jpegs]
    out: list = [None] * len(jpegs)
    together: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for i, (info, jpeg) in enumerate(zip(heads, jpegs, strict=True)):
        if info["kind"] != 0xC3:
            out[i] = _baseline(info, jpeg)
            continue
        size = info["rows"] * info["width"]
        plain = len(info["parts"]) == 1 and info["predictor"] == 1 and not info["transform"] and not info["restart"] and size % 8 == 0
        if plain and info["huff"].get(info["tables"][info["parts"][0][0]] >> 4) == NINE_BIT_TABLE:
            data = jpeg[info["scan"] : -2 if jpeg[-2:] == b"\xff\xd9" else None].replace(b"\xff\x00", b"\xff")
            if len(data) != size // 8 * 9:
                raise MediaError("the scan has a wrong size")
            together.setdefault((info["rows"], info["width"]), []).append((i, data))
        else:
            out[i] = _lossless(info, jpeg)
    for (rows, width), members in together.items():
        symbols = _unpack(np.frombuffer(b"".join(d for _, d in members), dtype=np.uint8))
        samples = _integrate(FROM_SYMBOL[symbols].reshape(len(members), rows, width))
        for (i, _), frame in zip(members, samples, strict=True):
            out[i] = frame
    return out


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """Share of the samples in each of 64 bins, a row for each frame."""
    return np.array([np.bincount(f.ravel() >> 2, minlength=64) / f.size for f in frames]).reshape(len(frames), 64)


def cuts(hist: np.ndarray, k: float = 3.0, floor: float = 0.2, window: int = 12) -> list[tuple[int, float]]:
    """Frames that open a shot after the first, with the distance that showed it."""
    distance = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    found, since = [], 0
    for i, d in enumerate(distance.tolist()):
        past = distance[max(since, i - window) : i]
        if d > max(floor, float(past.mean() + k * past.std()) if len(past) else floor):
            found.append((i + 1, d))
            since = i + 1
    return found


def read_avi(data: bytes) -> tuple[bytes, list[tuple]]:
    """The payload, and the clips (shot, first frame, frames, start ms, end ms, mean luma, distance at its cut)."""
    info = parse_avi(data)
    frames = decode_frames([data[a : a + n] for a, n, _ in info["frames"]])
    payload = b"".join(f.tobytes() for f in frames)
    if info["payload_bytes"] is not None:
        payload = payload[: info["payload_bytes"]]
    if not frames:
        return payload, []
    step = 1000 / (info["fps"] or FPS)
    opens = [(0, 0.0), *(cuts(histograms(frames)) if len(frames) > 1 else [])]
    ends = [at for at, _ in opens[1:]] + [len(frames)]
    clips = []
    for shot, ((at, distance), end) in enumerate(zip(opens, ends, strict=True)):
        total, size = sum(int(f.sum(dtype=np.int64)) for f in frames[at:end]), sum(f.size for f in frames[at:end])
        clips.append((shot, at, end - at, at * step, end * step, total / size, distance))
    return payload, clips


CLIP = "struct<shot:int,first_frame:int,frames:int,start_ms:double,end_ms:double,mean_luma:double,cut_distance:double>"


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with the binary column ``media``: an AVI file of the text's UTF-8, padded to a multiple of 64 bytes."""
    schema = T.StructType([f for f in df.schema.fields if f.name != media] + [T.StructField(media, T.BinaryType())])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, BATCH_BYTES):
            raw = text_bytes(batch.column(text))
            files = [write_avi(x.ljust(max(UNIT, -(-len(x) // UNIT) * UNIT), b"\0")) for x in raw]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(files, type=pa.binary())], names=[*keep, media])

    return df.mapInArrow(run, schema)


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what its files hold: payload size and digests, ``clips`` and ``error`` (null if all went well)."""
    new = T.StructType.fromDDL(f"payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, clips array<{CLIP}>, error string")
    schema = T.StructType([f for f in df.schema.fields if f.name not in new.names] + new.fields)
    keep = [f.name for f in schema.fields[: -len(new.fields)]]
    clips = pa.list_(pa.struct([(f.name, {"int": pa.int32(), "double": pa.float64()}[f.dataType.simpleString()]) for f in new["clips"].dataType.elementType.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f["name"] if isinstance(f, dict) else f.name for f in clips.value_type]
        for batch in pieces(batches, media, BATCH_BYTES):
            rows = []
            for data in text_bytes(batch.column(media)):
                try:
                    payload, found, error = *read_avi(data), None
                except (MediaError, struct.error, KeyError, IndexError) as e:
                    payload, found, error = b"", [], f"{type(e).__name__}: {e}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), [dict(zip(names, c, strict=True)) for c in found], error))
            columns = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), clips, pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], names=[*keep, *new.names])

    return df.mapInArrow(run, schema)


def clips(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """Timed clip rows: one for each shot of each file."""
    return read_back(df.select(key, media), media).select(key, F.explode("clips").alias("clip")).select(key, "clip.*")
