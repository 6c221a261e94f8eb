"""GIF's LZW: codes grow from min + 1 to 12 bits, least significant bit first, framed in sub-blocks of 255 bytes."""

from __future__ import annotations

MOST = 4096


def encode(indices: bytes, min_size: int, clear_interval: int = 0) -> bytes:
    """Code stream (unframed) of palette indexes. ``clear_interval``: codes after which the table is cleared; 0: when full."""
    clear, stop = 1 << min_size, (1 << min_size) + 1
    bits, count, out = 0, 0, bytearray()
    size, following, table = min_size + 1, stop + 1, {}

    def put(code: int) -> None:
        nonlocal bits, count
        bits |= code << count
        count += size
        while count >= 8:
            out.append(bits & 255)
            bits >>= 8
            count -= 8

    put(clear)
    since, held = 0, -1
    for value in indices:
        if held < 0:
            held = value
            continue
        key = held << 8 | value
        if key in table:
            held = table[key]
            continue
        put(held)
        since += 1
        held = value
        if following < MOST and not (clear_interval and since >= clear_interval):
            table[key] = following
            if following == 1 << size and size < 12:
                size += 1
            following += 1
        else:
            if following == 1 << size and size < 12:  # the decoder has added one more entry by now
                size += 1
            put(clear)
            size, following, table, since = min_size + 1, stop + 1, {}, 0
    if held >= 0:
        put(held)
        if following == 1 << size and size < 12:
            size += 1
    put(stop)
    if count:
        out.append(bits & 255)
    return bytes(out)


def decode(data: bytes, min_size: int, limit: int) -> tuple[bytes, bool]:
    """At most ``limit`` indexes, and whether the stream ended in good order. Bad codes end it."""
    clear, stop = 1 << min_size, (1 << min_size) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, size, before = list(base), min_size + 1, b""
    out, held, bits, count = [], 0, 0, 0
    for byte in data:
        bits |= byte << count
        count += 8
        while count >= size:
            code = bits & ((1 << size) - 1)
            bits >>= size
            count -= size
            if code == clear:
                table, size, before = list(base), min_size + 1, b""
                continue
            if code == stop:
                return b"".join(out)[:limit], True
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            else:
                return b"".join(out)[:limit], False
            out.append(entry)
            held += len(entry)
            if before and len(table) < MOST:
                table.append(before + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            before = entry
            if held >= limit:
                return b"".join(out)[:limit], True
    return b"".join(out)[:limit], False


def frame_blocks(data: bytes, most: int = 255) -> bytes:
    """Sub-blocks with their sizes, and the empty one that ends them."""
    return b"".join(bytes([len(data[i : i + most])]) + data[i : i + most] for i in range(0, len(data), most)) + b"\0"


def exact_bytes(indices: bytes, min_size: int, clear_interval: int = 0) -> int:
    return len(encode(indices, min_size, clear_interval))


def tune_clear(indices: bytes, min_size: int, tries: tuple[int, ...] = (0, 1024, 2048, 3072, 3840), prefix: int = 65536) -> int:
    """The interval that makes a prefix smallest."""
    sample = indices[:prefix]
    return min(tries, key=lambda t: (exact_bytes(sample, min_size, t), t))


def max_bytes(pixels: int) -> int:
    """A bound of what ``encode`` makes of so many pixels: a code of twelve bits for each, clear codes, and framing."""
    codes = pixels + 2 + -(-pixels // 255) + 1
    return -(-codes * 12 // 8) + -(-codes // 255) + 64
