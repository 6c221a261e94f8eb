"""Queries of bytes, containers, codecs, quantizers and the filter language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import kernels as K
from ..operators import palettes as P
from ..operators import quantize as Q
from ..plans import filtergraph as FG
from ..plans.bridge import PX_SQL, SIDE, pixels, table
from ..sources import demux, gif, lzw

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PAL = [(i * 17 % 256, (i * 41 + 5) % 256, (i * 97 + 13) % 256) for i in range(16)]

_HEADS = [
    "474946383961", "0000001866747970", "1A45DFA3", "52494646000000004156492000", "524946460000000057454250", "89504E470D0A1A0A", "FFD8FFE0", "424D00", "25504446",
    "504B0304", "4F676753", "664C6143", "494433", "49492A00", "00000100", "0102030405060708", "3C7376672078",
]


def _sniff(s, d):
    rows = s.createDataFrame([(i, bytearray.fromhex(h)) for i, h in enumerate(_HEADS)], "id int, data binary")
    return rows.select("id", demux.identify(F.col("data"))["format"].alias("format"))


QUERIES["sniff_format"] = _sniff
ORACLES["sniff_format"] = (
    "select cast(id as integer) as id, format from (values " + ", ".join(f"({i}, {v})" for i, v in enumerate(["'gif'", "'mp4'", "'webm'", "'avi'", "'webp'", "'png'", "'jpeg'", "'bmp'", "'pdf'", "'zip'", "'ogg'", "'flac'", "'mp3'", "'tiff'", "'ico'", "null", "'svg'"])) + ") t(id, format)"
)
QUERIES["page_mime_sniff"] = lambda s, d: table(s, d, "pages").select("page_id", demux.identify(F.encode("html", "UTF-8"), F.col("url"))["format"].alias("format"), F.lower(F.hex(F.encode(F.substring("html", 1, 8), "UTF-8"))).alias("head"))
ORACLES["page_mime_sniff"] = "select page_id, cast(null as varchar) as format, lower(hex(encode(substr(html, 1, 8)))) as head from pages"


def _hashes(s, d):
    b = F.encode("text", "UTF-8")
    b64 = F.translate(F.base64(b), "\r\n", "")  # Spark breaks lines after 76 characters
    return table(s, d, "documents").select(
        "doc_id", F.octet_length(b).cast("bigint").alias("n"), N.fnv1a(b).alias("fnv"), b64.alias("b64"), F.lower(F.hex(b)).alias("hex"), (F.unbase64(F.base64(b)) == b).alias("same")
    )


QUERIES["byte_codecs"] = _hashes
ORACLES["byte_codecs"] = """select doc_id, strlen(text) as n,
  case when text is not null then list_reduce(list_prepend(2166136261::bigint, [('0x' || x)::bigint for x in regexp_extract_all(h, '..')]), lambda h, c: (xor(h, c) * 16777619) & 4294967295) end as fnv,
  to_base64(encode(text)) as b64, lower(h) as hex, case when text is not null then true end as same from (select doc_id, text, hex(encode(text)) as h from documents)"""
QUERIES["byte_sizes"] = lambda s, d: table(s, d, "documents").select(
    "doc_id", N.format_bytes(F.col("n_chars") * 37).alias("human"), N.parse_bytes(F.concat(F.col("n_chars").cast("string"), F.lit("kB"))).alias("parsed"), N.round_up(F.col("n_chars"), 48).alias("up"), N.fixed16(F.col("n_chars")).alias("fixed")
)
ORACLES["byte_sizes"] = """select doc_id, case when n_chars * 37 >= 1073741824 then printf('%.1f GB', floor(n_chars * 37 / 1073741824e0 * 10 + 0.5e0) / 10) when n_chars * 37 >= 1048576 then printf('%.1f MB', floor(n_chars * 37 / 1048576e0 * 10 + 0.5e0) / 10)
 when n_chars * 37 >= 1024 then printf('%.1f KB', floor(n_chars * 37 / 1024e0 * 10 + 0.5e0) / 10) else (n_chars * 37) || ' B' end as human, n_chars * 1024 as parsed, (n_chars + 47) // 48 * 48 as up, n_chars / 65536e0 as fixed from documents"""
QUERIES["stts_expand"] = lambda s, d: demux.expand_runs(
    table(s, d, "orders").select((F.col("o_orderkey") % 50).alias("track_id"), F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 4).alias("n"), (F.col("o_orderkey") % 7 + 1).alias("delta")), "n", "delta", "ord"
)
ORACLES["stts_expand"] = """with r as (select o_orderkey % 50 as track_id, o_orderkey as ord, o_custkey % 4 as n, o_orderkey % 7 + 1 as delta from orders),
c as (select *, coalesce(sum(n) over w, 0) as s, coalesce(sum(n * delta) over w, 0) as b from r window w as (partition by track_id order by ord rows between unbounded preceding and 1 preceding)),
e as (select *, unnest(range(0, n)) as k from c) select track_id, cast(s + k as bigint) as sample_idx, delta as value, cast(b + k * delta as bigint) as dts from e"""


def _range_join(s, d):
    """Every order is a run; every order's key is a chunk of each of the three tracks."""
    orders = table(s, d, "orders")
    runs = orders.select((F.col("o_orderkey") % 3).alias("track_id"), F.col("o_orderkey").alias("first_chunk"), (F.col("o_custkey") % 9 + 1).alias("per_chunk"))
    chunks = orders.select(F.col("o_orderkey").alias("chunk")).distinct().select(F.explode(F.array(*(F.lit(k).cast("bigint") for k in range(3)))).alias("track_id"), "chunk")
    return demux.chunk_runs(chunks, runs.groupBy("track_id", "first_chunk").agg(F.min("per_chunk").alias("per_chunk")))


QUERIES["stsc_range_join"] = _range_join
ORACLES["stsc_range_join"] = """with c as (select unnest([0, 1, 2]) as track_id, o_orderkey as chunk from (select distinct o_orderkey from orders)),
r as (select o_orderkey % 3 as track_id, o_orderkey as first_chunk, min(o_custkey % 9 + 1) as per_chunk from orders group by 1, 2)
select cast(c.track_id as bigint) as track_id, chunk, per_chunk from c asof left join r on r.track_id = c.track_id and c.chunk >= r.first_chunk"""


def _keyframes(s, d):
    from pyspark.sql import Window as W

    e = table(s, d, "events").select("user_id", "event_id", (F.col("event_type") == "signup").alias("key"))
    last = F.last(F.when(F.col("key"), F.col("event_id")), ignorenulls=True)
    return e.select("user_id", "event_id", last.over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)).alias("from_key"))


QUERIES["keyframe_range"] = _keyframes
ORACLES["keyframe_range"] = "select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as from_key from events"


def _filter_chain(s, d):
    clip = FG.apply(FG.Clip(pixels(s, d), SIDE, SIDE), "crop=8:8:4:4,grayscale,posterize=levels=4,invert")
    return clip.px.select("frame_idx", "x", "y", "r", "g", "b")


QUERIES["filter_chain"] = _filter_chain
_GRAY = "case when a = 0 then {c} else cast(least(greatest(floor((0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) + 0.5e0), 0e0), 255e0) as integer) end"
ORACLES["filter_chain"] = f"""with {PX_SQL}, q as (select frame_idx, x - 4 as x, y - 4 as y, {', '.join(f'{_GRAY.format(c=c)} as {c}' for c in 'rgb')} from px where x between 4 and 11 and y between 4 and 11)
select frame_idx, x, y, {', '.join(f'255 - cast(least(greatest(floor(floor({c} / 85e0 + 0.5e0) * 85e0 + 0.5e0), 0e0), 255e0) as integer) as {c}' for c in 'rgb')} from q"""

# --- codecs and quantizers: no SQL; tests hold them against round trips and plain versions ---


def _filled(px, *columns):
    """Frames with all their places in order, as an array ``p``: a place without a pixel is 0, the background; where
    several pixels are at one place the smallest counts."""
    one = px.groupBy("frame_idx", (F.col("y") * SIDE + F.col("x")).alias("at")).agg(F.min(F.struct(*columns)).alias("v"))
    held = one.groupBy("frame_idx").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    nothing = F.struct(*(F.lit(0).alias(c) for c in columns))
    return held.select("frame_idx", F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.coalesce(F.try_element_at("m", i), nothing)).alias("p"))


def _planes(s, d):
    """Index planes of the bridge's frames."""
    return _filled(pixels(s, d), "idx").select("frame_idx", F.unhex(F.array_join(F.transform("p", lambda q: F.lpad(F.hex(q["idx"]), 2, "0")), "")).alias("indices"))


def _lzw(s, d):
    def run(batches):
        for b in batches:
            raw = b.column("indices").to_pylist()
            coded = [lzw.encode(x, 4) for x in raw]
            same = [lzw.decode(c, 4, len(x)) == (x, True) for c, x in zip(coded, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("frame_idx"), pa.array([len(c) for c in coded], type=pa.int64()), pa.array(same)], names=["frame_idx", "lzw_bytes", "round_trip"])

    return _planes(s, d).mapInArrow(run, "frame_idx bigint, lzw_bytes bigint, round_trip boolean")


QUERIES["lzw_bytes"] = _lzw


def _gifs(s, d):
    frames = _planes(s, d).select((F.col("frame_idx") % 4).alias("clip_id"), "frame_idx", "indices", (F.col("frame_idx") % 5 + 4).cast("int").alias("delay_cs"))
    return gif.encode_clips(frames, SIDE, SIDE, PAL)


def _gif_roundtrip(s, d):
    def run(batches):
        for b in batches:
            files = [gif.parse(x) for x in b.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("clip_id"), *(pa.array(v, type=pa.int64()) for v in ([len(f.frames) for f in files], [sum(x.delay_cs for x in f.frames) * 10 for f in files], [len(f.warnings) for f in files]))], names=["clip_id", "frames", "duration_ms", "warnings"]
            )

    return _gifs(s, d).mapInArrow(run, "clip_id bigint, frames bigint, duration_ms bigint, warnings bigint")


QUERIES["gif_roundtrip"] = _gif_roundtrip
ORACLES["gif_roundtrip"] = f"with {PX_SQL}, f as (select distinct frame_idx from px) select frame_idx % 4 as clip_id, count(*) as frames, cast(sum((frame_idx % 5 + 4) * 10) as bigint) as duration_ms, 0::bigint as warnings from f group by 1"


def _optimized(s, d):
    def run(batches):
        for b in batches:
            raw = b.column("bytes").to_pylist()
            made = [gif.optimize(x) for x in raw]
            ok = [gif.verify(x, y)["ok"] for x, y in zip(raw, made, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("clip_id"), pa.array([len(x) for x in raw], type=pa.int64()), pa.array([len(x) for x in made], type=pa.int64()), pa.array(ok)], names=["clip_id", "bytes_in", "bytes_out", "same_pictures"])

    return _gifs(s, d).mapInArrow(run, "clip_id bigint, bytes_in bigint, bytes_out bigint, same_pictures boolean")


QUERIES["optimize_clip"] = _optimized


def _quantized(method: str):
    def query(s, d):
        hist = P.histogram(pixels(s, d).withColumn("clip_id", F.col("frame_idx") % 4), ("clip_id",)).withColumnRenamed("key", "key24")
        return Q.quantize_clips(hist, 16, method)

    return query


for _method in sorted(set(Q.QUANTIZERS) - set(Q.FIXED)):
    QUERIES[f"quantize_{_method.replace('-', '_')}"] = _quantized(_method)


def _diffused(s, d):
    px = _filled(pixels(s, d), "r", "g", "b")
    hexed = F.array_join(F.transform("p", lambda q: F.concat(*(F.lpad(F.hex(q[c]), 2, "0") for c in "rgb"))), "")
    frames = px.select("frame_idx", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.unhex(hexed).alias("rgb"))
    return Q.diffuse_frames(frames, PAL).select("frame_idx", F.md5("indices").alias("digest"))


QUERIES["diffusion_fs"] = _diffused
_FULL = "g as (select f.frame_idx, cast(i % 16 as integer) as x, cast(i // 16 as integer) as y, i from (select distinct frame_idx from px) f, range(256) t(i)), fp as (select g.frame_idx, g.x, g.y, coalesce(r, 0) as r, coalesce(px.g, 0) as g, coalesce(b, 0) as b from g left join px using (frame_idx, x, y))"
# what is like the first place and reached from the border by steps over what is like it
ORACLES["flood_key"] = f"""with recursive {PX_SQL}, {_FULL}, f as (select frame_idx, r as fr, g as fg, b as fb from fp where x = 0 and y = 0),
like_first as (select frame_idx, x, y from fp join f using (frame_idx) where (r - fr) * (r - fr) + (g - fg) * (g - fg) + (b - fb) * (b - fb) <= 9000),
reached as (select frame_idx, x, y from like_first where x in (0, 15) or y in (0, 15)
  union select l.frame_idx, l.x, l.y from reached q join like_first l on l.frame_idx = q.frame_idx and abs(l.x - q.x) + abs(l.y - q.y) = 1)
select frame_idx, x, y, r, g, b, case when q.x is not null then 0 else a end as a from px left join (select frame_idx as qf, x, y from reached) q on q.qf = px.frame_idx and q.x = px.x and q.y = px.y"""
ORACLES["flood_key"] = ORACLES["flood_key"].replace("select frame_idx, x, y, r, g, b, case when q.x", "select frame_idx, px.x, px.y, r, g, b, case when q.x")
# the generator's numbers one after the other, dealt to a frame's visible pixels in order
ORACLES["grain"] = f"""with recursive {PX_SQL}, lcg as (select 1 as n, (1::bigint * 1664525 + 1013904223) & 4294967295 as s union all select n + 1, (s * 1664525 + 1013904223) & 4294967295 from lcg where n < 256),
q as (select *, row_number() over (partition by frame_idx, a > 0 order by y, x) as n from px),
z as (select q.*, case when a > 0 then ((s >> 8) / 16777216e0 - 0.5e0) * 24 else 0 end as noise from q join lcg using (n))
select frame_idx, x, y, {', '.join(f'cast(trunc(least(greatest({c} + noise, 0e0), 255e0)) as integer) as {c}' for c in 'rgb')}, a from z"""
QUERIES["flood_key"] = lambda s, d: K.flood_key(pixels(s, d), SIDE, SIDE, 9000)
QUERIES["grain"] = lambda s, d: K.grain(pixels(s, d), SIDE, SIDE)
QUERIES["rotate_any"] = lambda s, d: K.rotate_any(pixels(s, d), SIDE, SIDE, 30.0)
QUERIES["scale_lanczos"] = lambda s, d: K.scale_smooth(pixels(s, d), SIDE, SIDE, 10, 12, "lanczos3")


def _avi(s, d):
    made = [(i, bytearray(demux.write_avi([np.full(16 * 8 * 3, v, dtype=np.uint8).tobytes() for v in (20, 80, 160)[: i % 3 + 1]], 16, 8, 10))) for i in range(6)]
    return demux.samples(s.createDataFrame(made, "path bigint, content binary"))


QUERIES["avi_samples"] = _avi
