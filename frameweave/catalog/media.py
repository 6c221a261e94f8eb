"""Queries of containers and samples: files are made of the tables' rows, taken apart again and held against the rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import samples as SM
from ..plans.bridge import PALETTE_SQL, PX_SQL, table
from ..sources import demux, gif, lzw, mux, probe
from ..sources.columns import SLICE, give_back, one_at_a_time
from . import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# --- sample tables: every order is a sample of one of twenty tracks ---

TICKS = 30000


def _orders(s, d):
    o = table(s, d, "orders").select((F.col("o_custkey") % 20).alias("track_id"), "o_orderkey", "o_custkey")
    w = W.partitionBy("track_id").orderBy("o_orderkey")
    at = F.row_number().over(w) - 1
    o = o.select("track_id", at.cast("bigint").alias("sample_idx"), (F.col("o_orderkey") % 61 + 1).alias("size"), (F.col("o_custkey") % 5 * 100 + 500).alias("duration"), (F.col("o_orderkey") % 4 * 700).alias("cts"), "o_orderkey")
    dts = F.coalesce(F.sum("duration").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return o.withColumn("dts", dts).withColumns({"pts": F.col("dts") + F.col("cts"), "key": F.col("sample_idx") % 7 == 0})


_SAMPLES = """o as (select o_custkey % 20 as track_id, row_number() over (partition by o_custkey % 20 order by o_orderkey) - 1 as sample_idx, o_orderkey % 61 + 1 as size, o_custkey % 5 * 100 + 500 as duration, o_orderkey % 4 * 700 as cts, o_orderkey from orders),
sm as (select *, cast(coalesce(sum(duration) over (partition by track_id order by sample_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as dts,
  cast(coalesce(sum(duration) over (partition by track_id order by sample_idx rows between unbounded preceding and 1 preceding), 0) as bigint) + cts as pts, sample_idx % 7 = 0 as key from o)"""


def _made(rows, make, *columns):
    """A file for each track of ``rows``: ``make`` gets its number and its rows in order, as an array for ``sample_idx`` and each of
    ``columns``. What a file has in four bytes comes in four bytes."""
    names = ["sample_idx", *columns]
    narrow = [F.col(c).cast("int").alias(c) if c in ("size", "duration", "cts") else F.col(c) for c in names]

    def run(t: pa.Table) -> pa.Table:
        own = {c: t.column(c).to_numpy() for c in names}
        if (np.diff(own["sample_idx"]) < 0).any():
            order = np.argsort(own["sample_idx"], kind="stable")
            own = {c: v[order] for c, v in own.items()}
        track = t.column("track_id")[0].as_py()
        made = make(track, own)
        del own
        give_back()
        ends = np.array([0, len(made)], dtype=np.int32)
        content = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(ends), pa.py_buffer(made)])  # as it is, without a copy
        return pa.table([pa.array([track], type=pa.int64()), content], names=["path", "content"])

    one_at_a_time(rows.sparkSession)
    return rows.select("track_id", *narrow).groupBy("track_id").applyInArrow(run, "path bigint, content binary")


def _bytes_of(rows) -> np.ndarray:
    """Each sample's bytes: its number, as often as it is large."""
    return np.repeat((rows["sample_idx"] % 256).astype(np.uint8), rows["size"])


_MP4 = ("size", "duration", "cts", "key")


def _mp4(track: int, rows: dict[str, np.ndarray]) -> bytes:
    return mux.mp4(rows, _bytes_of(rows), TICKS, None, 64, 32, edit_delay=track * 10, rotation=track % 4 * 90, per_chunk=track % 5 + 1, moov_first=track % 2 == 0)


QUERIES["mp4_samples"] = lambda s, d: (
    demux.samples(_made(_orders(s, d), _mp4, *_MP4))
    .select(F.col("path").alias("track_id"), F.col("sample_idx").cast("bigint").alias("sample_idx"), (F.col("offset") - F.min("offset").over(W.partitionBy("path"))).alias("place"), "size", F.round("pts_ms", 6).alias("pts_ms"), "key")
)
ORACLES["mp4_samples"] = f"""with {_SAMPLES} select track_id, sample_idx, cast(coalesce(sum(size) over (partition by track_id order by sample_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as place, size, round(pts * 1000e0 / {TICKS}, 6) as pts_ms, key from sm"""


def _sample_digests(s, d):
    def run(batches):
        for path, raw in demux.contents(batches, "content", "path"):
            found = demux.parse_mp4(raw)["tracks"][0]["samples"]
            for a in range(0, len(found), SLICE):
                places = zip(*(found.part(c, a, a + SLICE) for c in ("offset", "size")), strict=True)
                digests = [hashlib.md5(raw[at : at + n]).hexdigest() for at, n in places]
                yield pa.RecordBatch.from_arrays([pa.repeat(path, len(digests)), pa.array(np.arange(a, a + len(digests))), pa.array(digests, type=pa.string())], names=["track_id", "sample_idx", "digest"])

    return _made(_orders(s, d), _mp4, *_MP4).mapInArrow(run, "track_id bigint, sample_idx bigint, digest string")


QUERIES["mp4_sample_bytes"] = _sample_digests
ORACLES["mp4_sample_bytes"] = f"with {_SAMPLES} select track_id, sample_idx, md5(unhex(repeat(printf('%02x', sample_idx % 256), size::integer))) as digest from sm"
QUERIES["probe_mp4"] = lambda s, d: probe.probes(_made(_orders(s, d), _mp4, *_MP4)).select(
    F.col("path").alias("track_id"), "format", "mime", *(F.col(c).cast("int").alias(c) for c in ("width", "height", "frames")), F.round("duration_ms", 6).alias("duration_ms"), F.round("fps", 6).alias("fps"), "codec", "rotation", "fast_start", "fragmented", "encrypted", "can_decode", "partial", "parse_error"
)
ORACLES["probe_mp4"] = f"""with {_SAMPLES}, t as (select track_id, cast(count(*) as integer) as frames, sum(duration) * 1000e0 / {TICKS} as ms from sm group by track_id)
select track_id, 'mp4' as format, 'video/mp4' as mime, 64 as width, 32 as height, frames, round(ms, 6) as duration_ms, round(frames * 1000e0 / ms, 6) as fps, 'avc1' as codec, cast(track_id % 4 * 90 as integer) as rotation,
  track_id % 2 = 0 as fast_start, false as fragmented, false as encrypted, true as can_decode, false as partial, cast(null as varchar) as parse_error from t"""


def _cut(track: int, rows: dict[str, np.ndarray]) -> bytes | bytearray:
    """Files that end early, of every format; some are only a head."""
    make = [_mp4, _webm, lambda *_: demux.write_avi([bytes(16 * 8 * 3)] * 3, 16, 8), lambda *_: gif.write(gif.Gif(4, 4, [(0, 0, 0), (9, 9, 9)], [gif.Frame(0, 0, 4, 4, bytes(16))] * 2))][track % 4]
    whole = make(track, rows)
    return whole[: 40 if track % 8 < 4 else len(whole) - 5]


def _webm_rows(s, d):
    """Every order is a block: 33 ms apart, a key frame every fifth."""
    return _orders(s, d).select("track_id", "sample_idx", "size", (F.col("sample_idx") * 33 + F.col("o_orderkey") % 3).alias("pts"), (F.col("sample_idx") % 5 == 0).alias("key"))


_WEBM = ("size", "pts", "key")


def _webm(track: int, rows: dict[str, np.ndarray]) -> bytearray:
    return mux.webm(rows, _bytes_of(rows), ["V_VP8", "V_VP9", "V_AV1"][track % 3], 80, 60, float(len(rows["size"]) * 33), cues=track % 4 > 0)


QUERIES["probe_partial"] = lambda s, d: probe.probes(_made(_orders(s, d), _cut, *_MP4, "pts")).select(F.col("path").alias("track_id"), "format", "partial", F.col("parse_error").isNotNull().alias("failed"), "can_decode")
ORACLES["probe_partial"] = f"""with {_SAMPLES} select distinct track_id, ['mp4', 'webm', 'avi', 'gif'][track_id % 4 + 1] as format,
  track_id % 4 <> 1 as partial, false as failed, true as can_decode from sm"""

QUERIES["webm_blocks"] = lambda s, d: (
    demux.samples(_made(_webm_rows(s, d), _webm, *_WEBM)).select(F.col("path").alias("track_id"), F.col("sample_idx").cast("bigint").alias("sample_idx"), "size", "pts_ms", "key")
)
_BLOCKS = f"{_SAMPLES}, bl as (select track_id, sample_idx, size, sample_idx * 33 + o_orderkey % 3 as pts, sample_idx % 5 = 0 as key from sm)"
ORACLES["webm_blocks"] = f"with {_BLOCKS} select track_id, sample_idx, size, pts * 1e0 as pts_ms, key from bl"


def _webm_facts(s, d):
    def run(batches):
        for path, raw in demux.contents(batches, "content", "path"):
            w = demux.parse_webm(raw)
            c = demux.webm_decoder_config(w["tracks"][0])
            row = (len(w["seek"]), sum(x["pts_ms"] for x in w["seek"]), all(raw[x["cluster"] : x["cluster"] + 4] == b"\x1f\x43\xb6\x75" for x in w["seek"]), c["codec"], c["width"], c["height"], w["doctype"], w["muxer"], w["duration_ms"])
            kinds = (pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.repeat(path, 1), *(pa.array([v], type=t) for v, t in zip(row, kinds, strict=True))], names=["track_id", "cues", "cue_ms", "cues_hit", "codec", "width", "height", "doctype", "muxer", "duration_ms"])

    return _made(_webm_rows(s, d), _webm, *_WEBM).mapInArrow(run, "track_id bigint, cues bigint, cue_ms double, cues_hit boolean, codec string, width bigint, height bigint, doctype string, muxer string, duration_ms double")


QUERIES["webm_cues"] = _webm_facts
ORACLES["webm_cues"] = f"""with {_BLOCKS} select track_id, case when track_id % 4 > 0 then count(*) filter (key) else 0 end as cues, coalesce(case when track_id % 4 > 0 then sum(pts) filter (key) end, 0) * 1e0 as cue_ms, true as cues_hit,
  ['vp8', 'vp09.00.10.08', 'av01.0.01M.08'][track_id % 3 + 1] as codec, 80::bigint as width, 60::bigint as height, 'webm' as doctype, 'frameweave' as muxer, count(*) * 33e0 as duration_ms from bl group by track_id"""


SPS = bytes.fromhex("6764001facd9405005bb016a02020280000003008000001e478c18cb")  # 1280 x 720


def _h264(track: int, rows: dict[str, np.ndarray]) -> bytearray:
    head = b"\0\0\0\1" + SPS + b"\0\0\1" + b"\x68\xee\x3c\x80"
    first, other = head + b"\0\0\1\x65", b"\0\0\1\x41"
    out = bytearray()
    for a in range(0, len(rows["size"]), SLICE):
        part = zip(*(rows[c][a : a + SLICE].tolist() for c in ("sample_idx", "size")), strict=True)
        out += b"".join((other if i % 10 else first) + b"\x9a" * size for i, size in part)
    return out


def _h264_samples(s, d):
    def run(batches):
        for path, raw in demux.contents(batches, "content", "path"):
            t = demux.annex_b_track(raw, 25.0)
            found = t["samples"]
            for a in range(0, len(found), SLICE):
                offset, size, pts, key = (found.columns[c][a : a + SLICE] for c in ("offset", "size", "pts", "key"))
                n = len(size)
                yield pa.RecordBatch.from_arrays([pa.repeat(path, n), *(pa.array(v) for v in (np.arange(a, a + n), offset, size, pts / 1000, key)), pa.repeat(t["codec"], n)], names=["track_id", "sample_idx", "offset", "size", "pts_ms", "key", "codec"])

    return _made(_orders(s, d), _h264, "size").mapInArrow(run, "track_id bigint, sample_idx bigint, offset bigint, size bigint, pts_ms double, key boolean, codec string")


QUERIES["annex_b_samples"] = _h264_samples
ORACLES["annex_b_samples"] = f"""with {_SAMPLES}, n as (select *, size + 4 + case when sample_idx % 10 = 0 then {len(SPS) + 11} else 0 end as bytes from sm)
select track_id, sample_idx, cast(coalesce(sum(bytes) over (partition by track_id order by sample_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", bytes as size, sample_idx * 40e0 as pts_ms, sample_idx % 10 = 0 as key, 'avc1.64001f' as codec from n"""


def _avi(track: int, rows: dict[str, np.ndarray]) -> bytes:
    n = len(rows["sample_idx"]) % 9 + 1
    made = bytearray(demux.write_avi([bytes([25 * i + 5]) * (16 * 8 * 3) for i in range(n)], 16, 8, 10))
    if track % 3 == 1:  # an index that points elsewhere
        at = made.index(b"idx1") + 16
        made[at : at + 4] = (999_999).to_bytes(4, "little")
    return bytes(made)


def _avi_facts(s, d):
    def run(batches):
        for b in batches:
            out = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                a = demux.parse_avi(raw)
                out += [(path, i, o - a["frames"][0][0], n, bytes(demux.sample_bytes(raw, {"offset": o, "size": n}))[0], a["index"], a["width"], a["height"], a["codec"]) for i, (o, n, _) in enumerate(a["frames"])]
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds)], names=["track_id", "frame_idx", "place", "size", "first_byte", "by_index", "width", "height", "codec"])

    return _made(_orders(s, d), _avi).mapInArrow(run, "track_id bigint, frame_idx bigint, place bigint, size bigint, first_byte bigint, by_index boolean, width bigint, height bigint, codec string")


QUERIES["avi_frames"] = _avi_facts
ORACLES["avi_frames"] = f"""with {_SAMPLES}, n as (select track_id, count(*) % 9 + 1 as n from sm group by track_id), f as (select track_id, unnest(range(0, n)) as i from n)
select track_id, i as frame_idx, i * 392 as place, 384::bigint as size, 25 * i + 5 as first_byte, track_id % 3 <> 1 as by_index, 16::bigint as width, 8::bigint as height, 'DIB' as codec from f"""


def _riff_file(track: int, rows: dict[str, np.ndarray]) -> bytes:
    big = track % 2 == 1
    order = "big" if big else "little"
    fmt = (1).to_bytes(2, order) + (track % 3 + 1).to_bytes(2, order) + (8000 + track).to_bytes(4, order) + bytes(8)
    info = mux.riff_list("INFO", mux.chunk("INAM", f"clip {track}\0".encode(), big), mux.chunk("ISFT", b"frameweave\0", big), big=big)
    return mux.riff("WAVE", mux.chunk("fmt ", fmt, big), info, mux.chunk("data", bytes(len(rows["sample_idx"])), big), big=big)


def _riff_facts(s, d):
    def run(batches):
        for b in batches:
            r = [demux.parse_riff(x) for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), pa.array([x["big"] for x in r]), *(pa.array([x[k] for x in r], type=pa.int64()) for k in ("channels", "sample_rate", "data_bytes")), *(pa.array([x["info"].get(k) for x in r]) for k in ("name", "software")), pa.array([x["partial"] for x in r])],
                names=["track_id", "big", "channels", "sample_rate", "data_bytes", "name", "software", "partial"],
            )

    return _made(_orders(s, d), _riff_file).mapInArrow(run, "track_id bigint, big boolean, channels bigint, sample_rate bigint, data_bytes bigint, name string, software string, partial boolean")


QUERIES["riff_info"] = _riff_facts
ORACLES["riff_info"] = f"with {_SAMPLES} select track_id, track_id % 2 = 1 as big, track_id % 3 + 1 as channels, 8000 + track_id as sample_rate, count(*) as data_bytes, 'clip ' || track_id as name, 'frameweave' as software, false as partial from sm group by track_id"

# --- codec strings of sample entries ---

_ENTRIES = [
    (b"avc1", mux.box(b"avcC", bytes([1, 0x64, 0, 0x1F, 0xFF])), "avc1.64001f", 8, 4), (b"avc3", mux.box(b"avcC", bytes([1, 0x42, 0xC0, 0x1E, 0xFD])), "avc3.42c01e", 8, 2),
    (b"hvc1", mux.box(b"hvcC", bytes([1, 1, 0x60, 0, 0, 0, 0xB0, 0, 0, 0, 0, 0, 93, 0xF0, 0, 0xFC, 0xFD, 0xF8, 0xF8, 0, 0, 0x0F])), "hvc1.1.6.L93.B0", 8, 4),
    (b"hev1", mux.box(b"hvcC", bytes([1, 0x22, 0x20, 0, 0, 0, 0x90, 0, 0, 0, 0, 0, 120, 0xF0, 0, 0xFC, 0xFD, 0xFA, 0xFA, 0, 0, 0x0F])), "hev1.2.4.H120.90", 10, 4),
    (b"av01", mux.box(b"av1C", bytes([0x81, 0x08, 0x0C, 0])), "av01.0.08M.08", 8, None), (b"av01", mux.box(b"av1C", bytes([0x81, 0x2D, 0xC0, 0])), "av01.1.13H.10", 10, None),
    (b"vp09", mux.full_box(b"vpcC", 1, 0, bytes([2, 31, 0xA0, 1, 1, 1, 0, 0])), "vp09.02.31.10", 10, None), (b"mp4v", b"", "mp4v", None, None),
]


def _codecs(s, d):
    extras = mux.box(b"colr", b"nclx", bytes([0, 9, 0, 16, 0, 9, 0x80])) + mux.box(b"pasp", mux.u32(4), mux.u32(3))
    out = []
    for i, (kind, record, *_) in enumerate(_ENTRIES):
        raw = mux.mp4([{"size": 1, "duration": 1, "cts": 0, "key": True}], b"x", 1000, mux.sample_entry(kind, 320, 240, record, extras), 320, 240)
        t = demux.parse_mp4(raw)["tracks"][0]
        out.append((i, t["codec"], t["bit_depth"], t["nal_length"], t["colour"], round(t["pixel_aspect"], 6), t["width"], t["height"]))
    return s.createDataFrame(out, "id int, codec string, bit_depth int, nal_length int, colour string, pixel_aspect double, width int, height int")


QUERIES["codec_strings"] = _codecs
ORACLES["codec_strings"] = (
    "select id, codec, bit_depth, nal_length, 'nclx 9/16/9 full' as colour, 1.333333e0 as pixel_aspect, 320 as width, 240 as height from (values "
    + ", ".join(f"({i}, '{codec}', {depth or 'null'}, {nal or 'null'})" for i, (_, _, codec, depth, nal) in enumerate(_ENTRIES)) + ") t(id, codec, bit_depth, nal_length)"
)

# --- times, seeking, decode ranges ---


def _times(s, d, **how):
    return SM.frame_times(_orders(s, d), TICKS, F.col("track_id") * 10, **how)


_TIMES = f"""{_SAMPLES}, tm as (select *, row_number() over w - 1 as place, (pts - track_id * 10) * 1000e0 / {TICKS} as pts_ms, duration * 1000e0 / {TICKS} as duration_ms, (lead(pts) over w - pts) * 1000e0 / {TICKS} as to_next from sm window w as (partition by track_id order by pts, sample_idx))"""


def _cols():
    return ("track_id", "sample_idx", "place", *(F.round(c, 6).alias(c) for c in ("pts_ms", "duration_ms", "to_next")))


_SQLC = "track_id, sample_idx, place, round(pts_ms, 6) as pts_ms, round(duration_ms, 6) as duration_ms, round(to_next, 6) as to_next"
QUERIES["mp4_frame_times"] = lambda s, d: _times(s, d).select(*_cols())
ORACLES["mp4_frame_times"] = f"with {_TIMES} select {_SQLC} from tm"
QUERIES["mp4_frame_times_merged"] = lambda s, d: _times(s, d, merge_ms=15.0).select(*_cols())
ORACLES["mp4_frame_times_merged"] = f"with {_TIMES} select {_SQLC} from tm where to_next is null or to_next >= 15"
QUERIES["mp4_key_times"] = lambda s, d: _times(s, d, keys_only=True).select(*_cols())
ORACLES["mp4_key_times"] = f"with {_TIMES} select {_SQLC} from tm where key"


def _wanted(s, d):
    """Every customer asks for a moment of a track, some beyond its end."""
    return table(s, d, "customer").select((F.col("c_custkey") % 20).alias("track_id"), "c_custkey", (F.col("c_custkey") * 37 % 20000 + 0.5).alias("want_ms"))


QUERIES["mp4_seek_range"] = lambda s, d: SM.seek_range(_times(s, d), _wanted(s, d)).withColumn("target_ms", F.round("target_ms", 6))
ORACLES["mp4_seek_range"] = f"""with {_TIMES}, k as (select *, max(case when key then sample_idx end) over (partition by track_id order by sample_idx) as from_key from tm),
q as (select c_custkey % 20 as track_id, c_custkey, c_custkey * 37 % 20000 + 0.5e0 as want_ms from customer),
f as (select q.track_id, q.c_custkey, q.want_ms, arg_min(struct_pack(i := k.sample_idx, f := from_key, t := k.pts_ms), struct_pack(a := k.pts_ms, b := k.sample_idx)) filter (k.pts_ms >= want_ms - 1) as hit,
  arg_max(struct_pack(i := k.sample_idx, f := from_key, t := k.pts_ms), struct_pack(a := k.pts_ms, b := k.sample_idx)) as last from q join k using (track_id) group by all)
select track_id, c_custkey, want_ms, coalesce(hit, last).f as first_sample, coalesce(hit, last).i as last_sample, coalesce(hit, last).i - coalesce(hit, last).f + 1 as warmup, round(coalesce(hit, last).t, 6) as target_ms from f"""
QUERIES["decode_range"] = lambda s, d: SM.decode_range(_times(s, d), F.col("track_id") * 40.0, F.col("track_id") * 40.0 + 500).select("track_id", "sample_idx", F.round("pts_ms", 6).alias("pts_ms"), "key", "wanted", F.col("rank").cast("bigint").alias("rank"), "pts_key", "warmup")
ORACLES["decode_range"] = f"""with {_TIMES}, m as (select *, pts_ms >= track_id * 40e0 - 1 and pts_ms <= track_id * 40e0 + 501 as want, max(case when key then sample_idx end) over (partition by track_id order by sample_idx) as from_key from tm),
e as (select track_id, min(from_key) as a, min(sample_idx) as f, max(sample_idx) as z from m where want group by track_id),
r as (select track_id, sample_idx, row_number() over (partition by track_id order by pts_ms, sample_idx) - 1 as rank from m where want)
select m.track_id, m.sample_idx, round(pts_ms, 6) as pts_ms, key, want as wanted, rank, floor(pts_ms * 8 + 0.5e0) / 8 as pts_key, f - a as warmup from m join e using (track_id) left join r on r.track_id = m.track_id and r.sample_idx = m.sample_idx where m.sample_idx between a and z"""


def _fed(s, d):
    """Samples of which every 53rd fails, unless it is a key frame, and every 97th is empty."""
    o = _orders(s, d)
    return o.select("track_id", "sample_idx", "pts", "key", F.when(F.col("sample_idx") % 97 == 96, 0).otherwise(F.col("size")).alias("size"), (F.col("key") | (F.col("sample_idx") % 53 != 52)).alias("ok"))


QUERIES["decode_replay"] = lambda s, d: SM.decode(_fed(s, d), window=1 << 30, most_replays=1 << 30)
ORACLES["decode_replay"] = f"""with {_SAMPLES} select track_id, sample_idx, pts, row_number() over (partition by track_id order by pts, sample_idx) - 1 as out_idx from sm where (key or sample_idx % 53 <> 52) and sample_idx % 97 <> 96"""
QUERIES["decode_replay_stats"] = lambda s, d: SM.decode_stats(_fed(s, d), window=4, most_replays=1 << 30).select("track_id", "delivered", "failed", "empty", "replays", "lost")
ORACLES["decode_replay_stats"] = f"""with {_SAMPLES}, b as (select *, sample_idx % 97 = 96 as hollow, sample_idx % 53 = 52 and not key and sample_idx % 97 <> 96 as bad from sm)
select track_id, count(*) filter (not bad and not hollow) as delivered, count(*) filter (bad) as failed, count(*) filter (hollow) as empty, count(*) filter (bad) as replays, 0::bigint as lost from b group by track_id"""


def _any_file(track: int, rows: dict[str, np.ndarray]) -> bytes | bytearray:
    """A file of one of four kinds; blocks of WebM are 33 ms apart, a key frame every fifth."""
    if track % 4 == 1:
        rows = rows | {"pts": rows["sample_idx"] * 33, "key": rows["sample_idx"] % 5 == 0}
    return [_mp4, _webm, _h264, _avi][track % 4](track, rows)


QUERIES["video_plans"] = lambda s, d: SM.video_plans(_made(_orders(s, d), _any_file, *_MP4)).select(
    F.col("path").alias("track_id"), "format", "codec", "width", "height", F.size("times").cast("bigint").alias("frames"), F.col("keys").cast("bigint").alias("keys"), F.round(F.array_max("times"), 6).alias("last_ms"), "seekable", "warning", "error"
)
ORACLES["video_plans"] = f"""with {_TIMES}, t as (select track_id, track_id % 4 as m, count(*) as n, count(*) filter (key) as k, count(*) filter (sample_idx % 5 = 0) as k5, count(*) filter (sample_idx % 10 = 0) as k10, max(pts_ms) as last from tm group by track_id)
select track_id, ['mp4', 'webm', 'h264-annexb', 'avi'][m + 1] as format, case m when 0 then 'avc1' when 1 then ['vp8', 'vp09.00.10.08', 'av01.0.01M.08'][track_id % 3 + 1] when 2 then 'avc1.64001f' else 'DIB' end as codec,
  cast([64, 80, 1280, 16][m + 1] as integer) as width, cast([32, 60, 720, 8][m + 1] as integer) as height, case m when 3 then n % 9 + 1 else n end as frames, case m when 0 then k when 1 then k5 when 2 then k10 else n % 9 + 1 end as keys,
  round(case m when 0 then last when 1 then (n - 1) * 33e0 when 2 then floor((n - 1) * 1000000 / 30e0 + 0.5e0) / 1000 else n % 9 * 100e0 end, 6) as last_ms, true as seekable, cast(null as varchar) as warning, cast(null as varchar) as error from t"""


def _listed(s, d):
    return _orders(s, d).select(F.col("track_id").alias("clip_id"), F.col("o_orderkey").alias("frame_idx"), F.when(F.col("sample_idx") % 3 > 0, F.col("sample_idx") * 90 + 7).alias("pts_ms"))


QUERIES["frames_from_list"] = lambda s, d: SM.frames_from_list(_listed(s, d), 5.0, 80.0).select("clip_id", "frame_idx", F.col("index").cast("bigint").alias("index"), "pts_ms")
ORACLES["frames_from_list"] = f"with {_SAMPLES} select track_id as clip_id, o_orderkey as frame_idx, sample_idx as index, case when sample_idx % 3 > 0 then sample_idx * 90e0 + 7 else 5 + sample_idx * 80e0 end as pts_ms from sm"
QUERIES["list_facts"] = lambda s, d: SM.list_facts(SM.frames_from_list(_listed(s, d), 5.0, 80.0)).withColumn("fps", F.round("fps", 6))
ORACLES["list_facts"] = f"""with {_SAMPLES}, f as (select track_id as clip_id, case when sample_idx % 3 > 0 then sample_idx * 90e0 + 7 else 5 + sample_idx * 80e0 end as t from sm),
g as (select clip_id, count(*) as frames, case when count(*) > 1 then greatest(1e0, max(t) - min(t)) else 1000e0 end as duration_ms from f group by clip_id) select *, round(frames * 1000e0 / duration_ms, 6) as fps from g"""

# --- GIF files against the rows that they were made of ---


def _lzw_trip(s, d):
    def run(batches):
        for b in batches:
            raw = b.column("indices").to_pylist()
            back = [lzw.decode(lzw.encode(x, 4, interval), 4, len(x))[0] for x, interval in zip(raw, (0, 16, 200) * len(raw), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("frame_idx"), pa.array([hashlib.md5(x.hex().encode()).hexdigest() for x in back])], names=["frame_idx", "digest"])

    return files._planes(s, d).mapInArrow(run, "frame_idx bigint, digest string")


_PLANE = """g as (select f.frame_idx, cast(i % 16 as integer) as x, cast(i // 16 as integer) as y, i from (select distinct frame_idx from px) f, range(256) t(i)),
pl as (select g.frame_idx, g.i, coalesce(px.idx, 0) as idx from g left join px using (frame_idx, x, y))"""
QUERIES["lzw_round_trip"] = _lzw_trip
ORACLES["lzw_round_trip"] = f"with {PX_SQL}, {_PLANE} select frame_idx, md5(string_agg(printf('%02x', idx), '' order by i)) as digest from pl group by frame_idx"


def _pictures(optimized: bool):
    """What each clip shows and when, after writing, and after optimizing if that is asked for."""

    def query(s, d):
        def run(batches):
            for b in batches:
                out = []
                for clip, raw in zip(b.column("clip_id").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                    shown = gif.compose(gif.parse(gif.optimize(raw) if optimized else raw))
                    out += [(clip, at, hashlib.md5(b"".join(rgba[i : i + 3] for i in range(0, len(rgba), 4)).hex().encode()).hexdigest(), ms) for rgba, at, ms in shown]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["clip_id", "at_ms", "digest", "ms"])

        return files._gifs(s, d).mapInArrow(run, "clip_id bigint, at_ms bigint, digest string, ms bigint")

    return query


_SHOWN = f"""{PX_SQL}, {PALETTE_SQL}, {_PLANE}, pic as (select frame_idx, md5(string_agg(printf('%02x%02x%02x', pr, pg, pb), '' order by i)) as digest from pl join pal using (idx) group by frame_idx),
tl as (select frame_idx % 4 as clip_id, frame_idx, digest, (frame_idx % 5 + 4) * 10 as ms from pic)"""
QUERIES["gif_pictures"] = _pictures(False)
ORACLES["gif_pictures"] = f"with {_SHOWN} select clip_id, cast(coalesce(sum(ms) over (partition by clip_id order by frame_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as at_ms, digest, ms from tl"
QUERIES["optimized_pictures"] = _pictures(True)
ORACLES["optimized_pictures"] = f"""with {_SHOWN}, r as (select *, coalesce(digest <> lag(digest) over (partition by clip_id order by frame_idx), true)::int as opens from tl),
n as (select *, sum(opens) over (partition by clip_id order by frame_idx) as run from r), whole as (select clip_id, run, any_value(digest) as digest, cast(sum(ms) as bigint) as ms from n group by clip_id, run)
select clip_id, cast(coalesce(sum(ms) over (partition by clip_id order by run rows between unbounded preceding and 1 preceding), 0) as bigint) as at_ms, digest, ms from whole"""
