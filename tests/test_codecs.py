"""LZW, GIF, containers, quantizers and the filter language, by round trips and hand-made files."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from frameweave.functions.numeric import parse_color
from frameweave.operators import palettes as P
from frameweave.operators import quantize as Q
from frameweave.operators import spatial as S
from frameweave.plans import filtergraph as FG
from frameweave.sources import demux, gif, lzw

PAL = [(i * 17 % 256, (i * 41 + 5) % 256, (i * 97 + 13) % 256) for i in range(16)]


@pytest.mark.parametrize("size", [2, 4, 6, 8])
@pytest.mark.parametrize("clear", [0, 16, 127, 128, 255, 1024, 4090, 4096])
def test_lzw_round_trip(size, clear):
    draw = random.Random(size * 10000 + clear)
    for n in (0, 1, 960, 19200):
        for data in (bytes((i * 7 + i // 13 * 3) & ((1 << size) - 1) for i in range(n)), bytes(draw.randrange(1 << size) for _ in range(n))):
            got, whole = lzw.decode(lzw.encode(data, size, clear), size, n)
            assert got == data and (whole or not n)


def test_lzw_stops_at_bad_codes():
    data = lzw.encode(bytes(range(16)) * 40, 4)
    got, whole = lzw.decode(data[: len(data) // 2], 4, 640)
    assert not whole and (bytes(range(16)) * 40).startswith(got)
    assert lzw.frame_blocks(b"x" * 300) == b"\xff" + b"x" * 255 + b"\x2d" + b"x" * 45 + b"\0"


def moving(frames=8, w=40, h=24):
    out = [gif.Frame(0, 0, w, h, bytes([1]) * (w * h), delay_cs=7)]
    for i in range(1, frames):
        out.append(gif.Frame(5 * i % (w - 8), 3 * i % (h - 6), 8, 6, bytes((i + x + y) & 15 for y in range(6) for x in range(8)), delay_cs=7 + i, disposal=1 + i % 3, interlaced=i % 2 == 0, transparent=3 if i % 4 == 0 else None))
    return gif.Gif(w, h, PAL, out, 2, comments=["a comment"])


def test_gif_round_trip():
    g = moving()
    back = gif.parse(gif.write(g))
    assert [(f.x, f.y, f.indices, f.delay_cs, f.disposal, f.transparent) for f in back.frames] == [(f.x, f.y, f.indices, f.delay_cs, f.disposal, f.transparent) for f in g.frames]
    assert (back.loop, back.comments, back.warnings, back.truncated) == (2, ["a comment"], [], False)
    assert gif.peek(gif.write(g))["colors"] == 16


@pytest.mark.parametrize("frames", [1, 2, 8, 12])
def test_optimized_files_show_the_same(frames):
    data = gif.write(moving(frames))
    made = gif.optimize(data)
    assert len(made) <= len(data) and gif.verify(data, made)["ok"]


def test_equal_pictures_become_one():
    data = gif.write(gif.Gif(8, 8, PAL, [gif.Frame(0, 0, 8, 8, bytes(64), delay_cs=10) for _ in range(9)], 0))
    made = gif.parse(gif.optimize(data))
    assert len(made.frames) == 1 and made.frames[0].delay_cs == 90
    other = gif.write(gif.Gif(8, 8, PAL, [gif.Frame(0, 0, 8, 8, bytes([1]) * 64, delay_cs=90)], 0))
    assert not gif.verify(data, other)["ok"]


def test_cut_off_gif_keeps_what_is_whole():
    data = gif.write(moving())
    back = gif.parse(data[: len(data) - 60])
    assert back.truncated and 0 < len(back.frames) <= 8
    with pytest.raises(gif.GifError):
        gif.parse(b"no gif at all")


def test_gif_data_source(spark, tmp_path):
    (tmp_path / "a.gif").write_bytes(gif.write(moving()))
    spark.dataSource.register(gif.GifSource)
    rows = spark.read.format("gif").load(str(tmp_path)).orderBy("frame_idx").collect()
    assert len(rows) == 8 and bytes(rows[1].indices) == moving().frames[1].indices
    assert spark.read.format("gif").schema("frame_idx int, delay_cs int").load(str(tmp_path)).count() == 8


def test_interlaced_rows():
    assert gif.interlaced_rows(7) == [0, 4, 2, 6, 1, 3, 5]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *parts, version=0):
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def mp4():
    u = lambda *v: struct.pack(f">{len(v)}I", *v)
    entry = box(b"avc1", bytes(24), struct.pack(">HH", 64, 32), bytes(50), box(b"avcC", bytes([1, 0x42, 0, 0x1F])))
    stbl = box(b"stbl", full(b"stsd", u(1), entry), full(b"stsz", u(0, 3, 8, 7, 6)), full(b"stts", u(1, 3, 1000)), full(b"stss", u(1, 1)), full(b"ctts", u(1, 3, 1000), version=1), full(b"stco", u(1, 500)))
    mdia = box(b"mdia", full(b"mdhd", u(0, 0, 30000, 3000)), full(b"hdlr", u(0), b"vide", bytes(12)), box(b"minf", stbl))
    return box(b"ftyp", b"isom", u(0)) + box(b"moov", box(b"trak", mdia))


def test_mp4_samples():
    found = demux.parse_mp4(mp4())["tracks"][0]
    assert (found["kind"], found["codec"], found["width"], found["height"], found["timescale"]) == ("video", "avc1.42001f", 64, 32, 30000)
    assert [(s["offset"], s["size"], s["dts"], s["pts"], s["key"]) for s in found["samples"]] == [(500, 8, 0, 1000, True), (508, 7, 1000, 2000, False), (515, 6, 2000, 3000, False)]
    assert demux.parse_mp4(mp4()[:-5])["tracks"] or demux.parse_mp4(mp4()[:-5])["partial"]


def webm():
    def e(kind, body):
        raw = kind.to_bytes((kind.bit_length() + 7) // 8, "big")
        return raw + (0x10000000 | len(body)).to_bytes(4, "big") + body

    track = e(demux.TRACK, e(demux.NUMBER, b"\1") + e(demux.TYPE, b"\1") + e(demux.CODEC, b"V_VP8") + e(demux.VIDEO, e(demux.WIDTH, b"\x40") + e(demux.HEIGHT, b"\x20")))
    blocks = b"".join(e(demux.SIMPLE, b"\x81" + struct.pack(">hB", t, 0x80 if k else 0) + b"data") for t, k in ((0, 1), (33, 0), (66, 0), (100, 1)))
    cues = e(demux.CUES, e(demux.CUE, e(demux.CUE_TIME, b"\0")) + e(demux.CUE, e(demux.CUE_TIME, b"\x64")))
    return e(0x1A45DFA3, b"") + e(demux.SEGMENT, e(demux.INFO, e(demux.SCALE, (10**6).to_bytes(3, "big")) + e(demux.DURATION, struct.pack(">d", 133.333))) + e(demux.TRACKS, track) + e(demux.CLUSTER, e(demux.TIME, b"\0") + blocks) + cues)


def test_webm_blocks():
    found = demux.parse_webm(webm())
    assert [(b["pts_ms"], b["key"], b["size"]) for b in found["blocks"]] == [(0, True, 4), (33, False, 4), (66, False, 4), (100, True, 4)]
    assert found["cues"] == [0, 100] and found["tracks"][0]["codec"] == "V_VP8" and found["tracks"][0]["width"] == 64 and round(found["duration_ms"], 3) == 133.333


def test_avi_index_and_walk():
    data = demux.write_avi([bytes([v]) * (16 * 8 * 3) for v in (20, 80, 160)], 16, 8, 10)
    found = demux.parse_avi(data)
    assert found["index"] and len(found["frames"]) == 3 and found["fps"] == 10 and (found["width"], found["height"]) == (16, 8)
    at = data.index(b"idx1")
    broken = demux.parse_avi(data[: at + 20] + bytes(4) + data[at + 24 :])
    assert not broken["index"]
    assert [f[:2] for f in broken["frames"]] == [f[:2] for f in found["frames"]]


def test_samples_of_a_column(spark):
    files = [("a", mp4()), ("b", webm()), ("c", b"nothing"), ("d", None)]
    rows = demux.samples(spark.createDataFrame([(n, bytearray(d) if d is not None else None) for n, d in files], "path string, content binary")).collect()
    assert sorted((r.path, r.error is None) for r in rows) == [("a", True)] * 3 + [("b", True)] * 4 + [("c", False), ("d", False)]


def test_raw_h264():
    sps = bytes.fromhex("6764001facd940")
    stream = b"\0\0\0\1" + sps + b"\0\0\0\1\x68\xee" + b"\0\0\1\x65abc\0\0\1\x41xyz"
    assert [u[0] & 31 for u in demux.split_annex_b(stream)] == [7, 8, 5, 1]
    assert [a["key"] for a in demux.access_units(stream)] == [True, False]
    assert demux.build_avcc(sps, b"\x68\xee")[:4] == bytes([1, 0x64, 0, 0x1F]) and demux.read_sps(sps[:5]) is None


@pytest.mark.parametrize("method", sorted(set(Q.QUANTIZERS) - set(Q.FIXED)))
def test_quantizers(method):
    rng = np.random.default_rng(3)
    few = rng.integers(0, 256, (12, 3))
    palette, error = Q.quantize(few, np.ones(12), 16, method)
    assert error < 3
    many = rng.integers(0, 256, (2000, 3))
    errors = [Q.quantize(many, np.ones(2000), n, method)[1] for n in (4, 16, 64)]
    assert errors == sorted(errors, reverse=True)


@pytest.mark.parametrize("kernel", sorted(Q.DIFFUSION))
def test_diffusion_keeps_the_mean(kernel):
    picture = np.full((24, 24, 3), 96)
    out = Q.diffuse(picture, np.array([(0, 0, 0), (255, 255, 255)], dtype=float), kernel)
    assert abs(out.mean() * 255 - 96) < 24


def test_bayer_matrices():
    assert sorted(P.bayer(8)) == list(range(64)) and sorted(P.bayer(16)) == list(range(256)) and P.bayer(2) == [0, 2, 3, 1]


def test_filter_language(spark):
    steps = FG.parse("scale=8:8,eq=brightness=0.06:contrast=0.2,css=brightness(120%) opacity(0.5),hue=40")
    assert [s.name for s in steps] == ["scale", "eq", "css", "hue"] and steps[1].args == {"brightness": 0.06, "contrast": 0.2}
    with pytest.raises(FG.FilterError):
        FG.parse("fps=12,unheard=1")
    px = spark.range(256).selectExpr("0L as frame_idx", "cast(id % 16 as int) as x", "cast(id div 16 as int) as y", "cast(id as int) as r", "cast(id as int) as g", "cast(255 - id as int) as b", "255 as a")
    for name in FG.filters():
        clip = FG.apply(FG.Clip(px, 16, 16), name)
        assert clip.px.count() > 0, name
    clip = FG.apply(FG.Clip(px, 16, 16), "fit=width=12:height=6,rotate=90")
    assert (clip.width, clip.height) == (6, 12) and clip.px.count() == 72
    assert len(FG.filters()) == 47


def test_plans_and_colours():
    assert S.fit_plan(320, 240, 100, 100) == {"width": 100, "height": 75, "x": 0, "y": 12}
    assert S.solve_size(320, 240, 160, -1) == (160, 120) and S.aspect_crop(160, 90, 1.0) == (35, 0, 90, 90)
    assert parse_color("#f80") == (255, 136, 0, 255) and parse_color("rgba(1, 2, 3, 0.2)") == (1, 2, 3, 51)
    assert parse_color("hsl(120, 100%, 50%)")[:3] == (0, 255, 0) and parse_color("tomato") == (255, 99, 71, 255)
