"""Writers of containers: boxes and files of ISO base media, elements and files of WebM, chunks of RIFF.

They wrap samples that are there already (nothing is encoded), and make the files that parsers are tested with.
"""

from __future__ import annotations

import struct

import numpy as np

from .columns import SLICE, column, count, sums


def u32(n: int) -> bytes:
    return struct.pack(">I", n & 0xFFFFFFFF)


def u64(n: int) -> bytes:
    return struct.pack(">Q", n)


def fourcc(tag: str) -> bytes:
    """Four characters as four bytes, filled up with blanks."""
    return tag.encode("latin-1")[:4].ljust(4)


def box_head(kind: bytes, size: int) -> bytes:
    """What stands before a box's ``size`` bytes; one beyond four gigabytes has its size in eight bytes."""
    return u32(8 + size) + kind if size + 8 < 1 << 32 else u32(1) + kind + u64(16 + size)


def box(kind: bytes, *parts: bytes) -> bytes:
    """A box of ISO base media."""
    return b"".join((box_head(kind, sum(len(p) for p in parts)), *parts))


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, u32(version << 24 | flags), *parts)


#: The identity of a picture's orientation, and quarter turns of it, in 16.16 and 2.30 fixed point.
def _matrix(rotation: int) -> bytes:
    one = 0x10000
    a, b, c, d = {0: (one, 0, 0, one), 90: (0, one, -one, 0), 180: (-one, 0, 0, -one), 270: (0, -one, one, 0)}[rotation % 360]
    return struct.pack(">9i", a, b, 0, c, d, 0, 0, 0, 0x40000000)


def _mvhd(timescale: int, duration: int) -> bytes:
    return full_box(b"mvhd", 0, 0, struct.pack(">IIII", 0, 0, timescale, duration), u32(0x10000), b"\x01\0", bytes(10), _matrix(0), bytes(24), u32(2))


def init_segment(timescale: int = 1000) -> bytes:
    """What a fragmented file begins with: its brand and a movie header without a duration."""
    return box(b"ftyp", b"isom", u32(0x200), b"isomiso2") + box(b"moov", _mvhd(timescale, 0))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each of a run of equal values stands there, and the values."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, dtype=np.int64)
    return np.diff(starts, append=len(values)), values[starts]


def _packed(values: np.ndarray, signed: bool = False) -> np.ndarray:
    """Numbers of four bytes each."""
    low, high = (-(1 << 31), (1 << 31) - 1) if signed else (0, (1 << 32) - 1)
    if len(values) and not (low <= values.min() and values.max() <= high):
        raise struct.error(f"a number that is not between {low} and {high}")
    return values.astype(">i4" if signed else ">u4")


def _table(kind: bytes, *columns: np.ndarray, version: int = 0, lead: bytes = b"") -> bytes:
    """A full box of rows, after their count."""
    body = np.empty((len(columns[0]), len(columns)), dtype=">u4")
    for k, c in enumerate(columns):
        body[:, k] = c.view(">u4")
    return full_box(kind, version, 0, lead, u32(len(body)), body.tobytes())


def sample_entry(codec: bytes, width: int, height: int, *records: bytes) -> bytes:
    """A visual sample entry with its codec's records."""
    return box(codec, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", width, height), u32(0x480000), u32(0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 24, -1), *records)


def mp4(samples: list[dict] | dict[str, np.ndarray], data: bytes, timescale: int = 1000, entry: bytes | None = None, width: int = 0, height: int = 0, edit_delay: int = 0, rotation: int = 0, per_chunk: int = 4, moov_first: bool = True, protection: bytes = b"") -> bytes:
    """A file of one video track. ``samples``: size, duration, cts and key of each, in the order of decoding, as dicts or as
    columns; ``data`` has their bytes one after the other. ``edit_delay``: ticks of the track that aren't shown;
    ``protection``: a box beside the header."""
    entry = entry or sample_entry(b"avc1", width, height)
    n = count(samples)
    sizes, durations, shifts = (column(samples, c) for c in ("size", "duration", "cts"))
    keys = np.flatnonzero(column(samples, "key", bool)) + 1
    total = int(durations.sum(dtype=np.int64))
    firsts = np.arange(0, n, per_chunk)
    places = sums(sizes)[firsts]
    counts, first_chunks = _runs(np.diff(firsts, append=n))
    per = sums(counts)[:-1]
    (run, lasting), (shift_run, shifted) = _runs(durations), _runs(shifts)
    one = np.ones(len(per), dtype=np.int64)
    stts = _table(b"stts", _packed(run), _packed(lasting))
    ctts = _table(b"ctts", _packed(shift_run), _packed(shifted, True), version=1) if shifts.any() else b""
    stss = _table(b"stss", _packed(keys)) if len(keys) < n else b""
    stsc = _table(b"stsc", _packed(per + 1), _packed(first_chunks), _packed(one))
    stsz = _table(b"stsz", (sizes.astype(np.int64) & 0xFFFFFFFF).astype(">u4"), lead=u32(0))
    ftyp = box(b"ftyp", b"isom", u32(0x200), b"isommp42")

    def moov(first: int) -> bytes:
        stbl = box(b"stbl", full_box(b"stsd", 0, 0, u32(1), entry), stts, ctts, stss, stsc, stsz, _table(b"stco", _packed(places + first)))
        mdia = box(
            b"mdia", full_box(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, timescale, total, 0x55C4, 0)), full_box(b"hdlr", 0, 0, u32(0), b"vide", bytes(12), b"\0"),
            box(b"minf", full_box(b"vmhd", 0, 1, bytes(8)), stbl),
        )
        edits = box(b"edts", full_box(b"elst", 0, 0, u32(1), struct.pack(">IiI", max(0, total - edit_delay), edit_delay, 0x10000))) if edit_delay else b""
        tkhd = full_box(b"tkhd", 0, 7, struct.pack(">IIIII", 0, 0, 1, 0, total), bytes(16), _matrix(rotation), struct.pack(">II", width << 16, height << 16))
        return box(b"moov", _mvhd(timescale, total), box(b"trak", tkhd, edits, mdia), protection)

    head = box_head(b"mdat", len(data))
    if moov_first:
        return b"".join((ftyp, moov(len(ftyp) + len(moov(0)) + 8), head, data))
    return b"".join((ftyp, head, data, moov(len(ftyp) + 8)))


# --- WebM ---


def element_head(kind: int, size: int) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (0x0100000000000000 | size).to_bytes(8, "big")


def element(kind: int, *parts: bytes) -> bytes:
    return b"".join((element_head(kind, sum(len(p) for p in parts)), *parts))


def _uint(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def webm(blocks: list[dict] | dict[str, np.ndarray], data: bytes, codec: str = "V_VP8", width: int = 0, height: int = 0, duration_ms: float = 0.0, cues: bool = True, private: bytes = b"", cluster_ms: int = 1000) -> bytearray:
    """A file of one video track. ``blocks``: pts (whole milliseconds, ascending), size and key of each, as dicts or as columns; a
    cluster begins with every key frame and at least every ``cluster_ms``."""
    info = element(0x1549A966, element(0x2AD7B1, _uint(1_000_000)), element(0x4489, struct.pack(">d", duration_ms)), element(0x4D80, b"frameweave"))
    track = element(
        0x1654AE6B, element(0xAE, element(0xD7, b"\x01"), element(0x83, b"\x01"), element(0x86, codec.encode()), element(0x63A2, private) if private else b"", element(0xE0, element(0xB0, _uint(width)), element(0xBA, _uint(height)))),
    )
    pts, sizes, keys, raw = column(blocks, "pts"), column(blocks, "size"), column(blocks, "key", bool), memoryview(data)
    lead = element(0x1A45DFA3, element(0x4282, b"webm")) + element_head(0x18538067, 0)
    file, index, cluster = bytearray(lead + info + track), bytearray(), bytearray()
    base, at = None, 0

    def close() -> None:
        """The cluster goes into the file, and where it begins into the index."""
        if base is not None:
            index.extend(element(0xBB, element(0xB3, _uint(base)), element(0xB7, element(0xF7, b"\x01"), element(0xF1, _uint(len(file) - len(lead))))))
            time = element(0xE7, _uint(base))
            file.extend(element_head(0x1F43B675, len(time) + len(cluster)) + time)
            file.extend(cluster)
            cluster.clear()

    for a in range(0, len(pts), SLICE):
        for t, size, key in zip(*(c[a : a + SLICE].tolist() for c in (pts, sizes, keys)), strict=True):
            if base is None or key or t - base >= cluster_ms:
                close()
                base = t
            part = raw[at : at + size]
            cluster += element_head(0xA3, 4 + len(part)) + b"\x81" + struct.pack(">hB", t - base, 0x80 if key else 0)
            cluster += part
            at += size
    close()
    if cues:
        file += element_head(0x1C53BB6B, len(index))
        file += index
    file[len(lead) - 12 : len(lead)] = element_head(0x18538067, len(file) - len(lead))
    return file


# --- RIFF ---


def chunk(tag: str, body: bytes, big: bool = False) -> bytes:
    """A chunk, filled up to an even length; ``big``: with its most significant byte first, as in RIFX."""
    return fourcc(tag) + struct.pack(">I" if big else "<I", len(body)) + body + b"\0" * (len(body) & 1)


def riff(form: str, *chunks: bytes, big: bool = False) -> bytes:
    body = fourcc(form) + b"".join(chunks)
    return (b"RIFX" if big else b"RIFF") + struct.pack(">I" if big else "<I", len(body)) + body


def riff_list(kind: str, *chunks: bytes, big: bool = False) -> bytes:
    return chunk("LIST", fourcc(kind) + b"".join(chunks), big)
