"""Containers, probing, decoding and the GIF optimizer on files that are made here."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest

from frameweave.operators import samples as SM
from frameweave.sources import demux, gif, mux, probe


def clip(frames, colors, width=16, height=16, **more):
    return gif.write(gif.Gif(width, height, colors, [gif.Frame(0, 0, width, height, bytes(int(v) for v in f), delay_cs=7 + i) for i, f in enumerate(frames)], **more))


def test_every_technique_keeps_the_pictures():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 8, 256)
    frames = [base.copy() for _ in range(6)]
    for i, f in enumerate(frames):
        f[i * 17 : i * 17 + 9] = (i + 3) % 8
    frames.insert(3, frames[2].copy())
    data = clip(frames, [(i * 30, 255 - i * 20, i * 11) for i in range(8)], loop=0, comments=["made by hand"])
    for without in [(), *((t,) for t in gif.TECHNIQUES), gif.TECHNIQUES]:
        made = gif.optimize(data, without)
        assert gif.verify(data, made)["ok"] and len(made) <= len(data), without
    assert len(gif.parse(gif.optimize(data)).frames) == 6 and len(gif.parse(gif.optimize(data, ("dedupe",))).frames) == 7
    assert gif.parse(gif.optimize(data, ("strip_comments",))).comments == ["made by hand"] and not gif.parse(gif.optimize(data)).comments
    assert len(gif.optimize(data)) < len(gif.optimize(data, ("sub_frames", "transparent_unchanged"))) < len(data)
    with pytest.raises(gif.GifError):
        gif.optimize(data, ("no such",))


def test_pictures_of_more_than_255_colours():
    """Two frames of 200 colours each, the second over half of the canvas that the first left: 300 colours are shown at once."""
    a = gif.Frame(0, 0, 20, 20, bytes(i % 200 for i in range(400)), [(i, 0, 7) for i in range(200)], 10, gif.LEAVE)
    b = gif.Frame(0, 10, 20, 10, bytes(i % 200 for i in range(200)), [(i, 255, 9) for i in range(200)], 10, gif.LEAVE)
    whole = gif.Frame(0, 0, 20, 20, bytes(400), [(0, 0, 0)], 10, gif.LEAVE)
    data = gif.write(gif.Gif(20, 20, None, [a, b, whole, a]))
    assert gif.verify(data, gif.optimize(data))["ok"]
    lossy = gif.optimize(data, colors=16)
    got = gif.verify(data, lossy)
    assert got["same_duration"] and 0 < got["worst"] and len(lossy) < len(data)
    assert gif.verify(data, lossy, tolerance=got["worst"])["ok"]
    pictures = [np.frombuffer(r, np.uint8).reshape(20, 20, 4) for r, _, _ in gif.compose(gif.parse(lossy))]
    assert len(np.unique(np.concatenate([p[..., :3].reshape(-1, 3) for p in pictures]), axis=0)) <= 16


def test_overflowing_palettes():
    frames = [gif.Frame(0, 0, 16, 16, bytes(i % 6 for i in range(256)), [((3 * i) & 255, (60 * c + i) & 255, (255 - 2 * i) & 255) for c in range(6)], 5) for i in range(60)]
    data = gif.write(gif.Gif(16, 16, None, frames))
    assert gif.verify(data, gif.optimize(data))["ok"]


def test_compact_in_rect():
    indices = bytes([0, 1, 2, 3, 4, 5, 6, 7, 7])
    part, palette = gif.compact_in_rect(indices, [(i, i, i) for i in range(8)], 3, (1, 1, 2, 2))
    assert part == bytes([0, 1, 2, 2]) and palette == [(4, 4, 4), (5, 5, 5), (7, 7, 7)]


def test_data_urls_and_base64():
    raw = bytes(range(256))
    assert probe.read_data_url("data:image/gif;base64," + base64.b64encode(raw).decode()) == raw
    assert probe.read_data_url("data:;base64," + probe.encode_base64(raw, url_safe=True)) == raw
    assert probe.read_data_url("data:;base64," + probe.encode_base64(raw, line=76)) == raw and max(map(len, probe.encode_base64(raw, line=76).split("\n"))) == 76
    assert probe.read_data_url("data:text/plain,a%20b") == b"a b"
    for bad in ("data:;base64,!!!!", "http://x", "data:"):
        with pytest.raises(probe.InputError):
            probe.read_data_url(bad)


def test_files_by_spark(spark, tmp_path):
    for n, size in (("a.gif", 10), ("b.gif", 5000), ("c.txt", 3)):
        (tmp_path / n).write_bytes(bytes(size))
    got = {r.path.rsplit("/", 1)[1]: (r.length, None if r.content is None else len(r.content), r.error) for r in probe.read_files(spark, f"file://{tmp_path}", "*.gif", 100).collect()}
    assert got == {"a.gif": (10, 10, None), "b.gif": (5000, None, "too-large")}


def test_gif_source_and_column(spark, tmp_path):
    data = clip([bytes(256), bytes([1] * 256)], [(0, 0, 0), (9, 9, 9)])
    for i in range(3):
        (tmp_path / f"{i}.gif").write_bytes(data)
    (tmp_path / "x.txt").write_bytes(b"no picture")
    spark.dataSource.register(gif.GifSource)
    rows = spark.read.format("gif").load(f"file://{tmp_path}").collect()
    assert len(rows) == 6 and {r.delay_cs for r in rows} == {7, 8}
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    assert sorted((r.frame_idx, bytes(r.indices)) for r in gif.frames_of(files).collect()) == sorted((r.frame_idx, bytes(r.indices)) for r in rows)


def test_probe_never_fails(spark):
    mp4 = mux.mp4([{"size": 4, "duration": 500, "cts": 0, "key": i == 0} for i in range(4)], b"abcd" * 4, 1000, None, 64, 32)
    made = {
        "mp4": mp4, "webm": mux.webm([{"pts": 0, "size": 3, "key": True}], b"xyz", "V_VP9", 8, 6, 40.0), "avi": demux.write_avi([bytes(48)] * 2, 4, 4), "gif": clip([bytes(256)] * 2, [(0, 0, 0), (1, 1, 1)]),
        "zip": b"PK\x03\x04" + bytes(26) + b"PK\x03\x04" + bytes(26), "riff": mux.riff("CDX ", mux.chunk("data", b"x")), "pdf": b"%PDF-1.4", "svg": b"<svg></svg>",
    }
    rng = random.Random(2)
    cut = [(f"{n}-{k}", d[:k]) for n, d in made.items() for k in sorted({rng.randrange(len(d)) for _ in range(25)})]
    broken = [(f"{n}~{k}", bytes(c ^ (rng.randrange(256) if rng.random() < 0.05 else 0) for c in d)) for n, d in made.items() for k in range(25)]
    rows = spark.createDataFrame([(n, bytearray(d)) for n, d in [*made.items(), *cut, *broken, ("empty", b"")]] + [("null", None)], "path string, content binary")
    got = {r.path: r for r in probe.probes(rows).collect()}
    assert len(got) == len(made) + len(cut) + len(broken) + 2
    assert {n: got[n].format for n in made} == {n: n for n in made}
    assert (got["mp4"].frames, got["mp4"].duration_ms, got["mp4"].width, got["webm"].codec, got["zip"].files) == (4, 2000.0, 64, "vp09.00.10.08", 2)
    assert got["empty"].format is None and got["null"].parse_error == "unknown format" and not got["pdf"].can_decode
    assert probe.probe(mux.mp4([{"size": 1, "duration": 1, "cts": 0, "key": True}], b"x", protection=mux.full_box(b"pssh", 0, 0, bytes(20))))["can_decode"] is False
    assert probe.probe(b"", "clip.mkv")["format"] == "mkv"


def test_open_dml_rec_lists_and_rifx():
    body = mux.riff_list("movi", mux.riff_list("rec ", mux.chunk("00dc", b"one")), mux.chunk("00dc", b"three!"), mux.chunk("01wb", b"sound"))
    dml = mux.riff_list("odml", mux.chunk("dmlh", (77).to_bytes(4, "little") + bytes(4)))
    avi = demux.parse_avi(mux.riff("AVI ", mux.riff_list("hdrl", mux.chunk("avih", (40000).to_bytes(4, "little") + bytes(52)), dml), body))
    assert (len(avi["frames"]), avi["open_dml_frames"], avi["fps"], avi["index"]) == (2, 77, 25.0, False)
    assert demux.parse_riff(mux.riff("WAVE", mux.chunk("data", b"12", True), big=True))["data_bytes"] == 2


def test_webm_without_clusters_has_cues():
    whole = mux.webm([{"pts": p, "size": 2, "key": p in (0, 100)} for p in (0, 33, 66, 100)], b"ab" * 4, "V_VP8", 64, 32, 133.333)
    w = demux.parse_webm(whole)
    assert [b["pts_ms"] for b in w["blocks"]] == [0, 33, 66, 100] and [c["pts_ms"] for c in w["seek"]] == [0, 100] and w["duration_ms"] == 133.333
    assert [demux.sample_bytes(whole, b) for b in w["blocks"]] == [b"ab"] * 4
    avc = demux.webm_decoder_config({"codec": "V_MPEG4/ISO/AVC", "width": 1, "height": 2, "private": bytes([1, 0x4D, 0x40, 0x28])})
    assert avc["codec"] == "avc1.4d4028" and demux.webm_decoder_config({"codec": "V_UNKNOWN", "width": 1, "height": 2})["codec"] == ""


def test_init_segment_and_large_boxes():
    assert [k for k, *_ in demux._boxes(mux.init_segment(90000), 0, len(mux.init_segment(90000)))] == [b"ftyp", b"moov"]
    m = demux.parse_mp4(mux.init_segment(90000))
    assert m["tracks"] == [] and not m["partial"] and m["brands"] == ["isom", "iso2"]
    data = mux.u32(1) + b"free" + mux.u64(20) + b"body" + mux.box(b"ftyp", b"isom", mux.u32(0))
    assert demux.parse_mp4(data)["brand"] == "isom"


def plain_replay(rows, window, most):
    """Samples that come out, by hand: a failure costs itself and, out of replays, all up to the next key frame."""
    out, wait, left, blind = [], [], most, False
    for i, (pts, key, size, ok) in enumerate(rows):
        if size < 1:
            continue
        if key:
            blind = False
        if blind:
            continue
        if not ok:
            seen = any(r[2] >= 1 and r[3] for r in rows[max((j for j in range(i + 1) if rows[j][1] and rows[j][2] >= 1), default=0) : i])
            if left and seen and not key:
                left -= 1
            else:
                blind = True
            continue
        wait.append((pts, i))
        while len(wait) > max(2, window):
            out.append(wait.pop(wait.index(min(wait))))
    return out + sorted(wait)


@pytest.mark.parametrize("most", [0, 1, 50])
def test_replay(spark, most):
    rng = random.Random(most)
    rows = []
    for track in range(6):
        for i in range(rng.randint(1, 60)):
            rows.append((track, i, i * 10 + rng.choice((0, 15, -15)), i % 8 == 0, 0 if rng.random() < 0.05 else 5, rng.random() > 0.12))
    df = spark.createDataFrame(rows, "track_id bigint, sample_idx bigint, pts bigint, key boolean, size bigint, ok boolean")
    got = {}
    for r in SM.decode(df, 4, most).orderBy("track_id", "out_idx").collect():
        got.setdefault(r.track_id, []).append((r.pts, r.sample_idx))
    for track in range(6):
        assert got.get(track, []) == plain_replay([r[2:] for r in rows if r[0] == track], 4, most), track
    stats = {r.track_id: r for r in SM.decode_stats(df, 4, most).collect()}
    assert all(stats[t].delivered == len(got.get(t, [])) for t in range(6))
    assert SM.decode(df.limit(0)).count() == 0
