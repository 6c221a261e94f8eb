"""Queries of histograms, palettes and mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import palettes as P
from ..plans.bridge import PALETTE_SQL, PX_SQL, palette, pixels, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PAL = [(i * 17 % 256, (i * 41 + 5) % 256, (i * 97 + 13) % 256) for i in range(16)]

_HIST = "h as (select (r << 16) | (g << 8) | b as key, sum(a / 255e0) as weight from px where a > 8 group by 1)"
_DIST = "((((512 + ((r + pr) >> 1)) * (r - pr) * (r - pr)) >> 8) + 4 * (g - pg) * (g - pg) + (((767 - ((r + pr) >> 1)) * (b - pb) * (b - pb)) >> 8))"
_NEAR = "n as (select *, row_number() over (partition by key order by {d}, idx) as k, {d} as distance from c, pal)".format(d=_DIST)
_COLORS = "c as (select key, weight, key >> 16 as r, (key >> 8) & 255 as g, key & 255 as b from h)"
_FIT = f"{PX_SQL}, {PALETTE_SQL}, {_HIST}, {_COLORS}, {_NEAR}, m as (select key, weight, idx, distance from n where k = 1)"

QUERIES["rgb_histogram"] = lambda s, d: P.histogram(pixels(s, d)).withColumn("weight", F.round("weight", 6))
ORACLES["rgb_histogram"] = f"with {PX_SQL}, {_HIST} select key, round(weight, 6) as weight from h"
QUERIES["rgb_histogram_sampled"] = lambda s, d: P.histogram(pixels(s, d).drop("a"), step=2)
ORACLES["rgb_histogram_sampled"] = f"with {PX_SQL} select (r << 16) | (g << 8) | b as key, count(*) * 4e0 as weight from px where x % 2 = 0 and y % 2 = 0 group by 1"
QUERIES["dominant_colors"] = lambda s, d: P.dominant(P.histogram(pixels(s, d)), 8)
ORACLES["dominant_colors"] = f"""with {PX_SQL}, {_HIST}, t as (select key, weight, row_number() over (order by weight desc, key) as rank, sum(weight) over () as total from h)
select cast(rank as integer) as rank, key, round(weight, 6) as weight, round(weight / total, 6) as share, printf('#%02x%02x%02x', key >> 16, (key >> 8) & 255, key & 255) as hex from t where rank <= 8"""
QUERIES["dominant_by_frame"] = lambda s, d: P.dominant(P.histogram(pixels(s, d), ("frame_idx",)), 3, ("frame_idx",))
ORACLES["dominant_by_frame"] = f"""with {PX_SQL}, h as (select frame_idx, (r << 16) | (g << 8) | b as key, sum(a / 255e0) as weight from px where a > 8 group by 1, 2),
t as (select *, row_number() over (partition by frame_idx order by weight desc, key) as rank, sum(weight) over (partition by frame_idx) as total from h)
select frame_idx, cast(rank as integer) as rank, key, round(weight, 6) as weight, round(weight / total, 6) as share, printf('#%02x%02x%02x', key >> 16, (key >> 8) & 255, key & 255) as hex from t where rank <= 3"""
QUERIES["nearest_palette"] = lambda s, d: P.map_colors(P.histogram(pixels(s, d)), PAL).select("key", "idx", "distance")
ORACLES["nearest_palette"] = f"with {_FIT} select key, idx, distance from m"
QUERIES["quant_rmse"] = lambda s, d: P.quantization_error(P.histogram(pixels(s, d)), PAL)
ORACLES["quant_rmse"] = f"with {_FIT} select round(sqrt(sum(weight * distance) / sum(weight) / 3), 6) as rmse from m"
QUERIES["map_frame"] = lambda s, d: P.map_pixels(pixels(s, d), PAL).select("frame_idx", "x", "y", "idx")
ORACLES["map_frame"] = f"""with {PX_SQL}, {PALETTE_SQL}, n as (select frame_idx, x, y, a, pal.idx, row_number() over (partition by frame_idx, x, y order by {_DIST}, pal.idx) as k from px, pal)
select frame_idx, x, y, case when a >= 128 then idx end as idx from n where k = 1"""
QUERIES["palette_sort_usage"] = lambda s, d: P.sort_by_usage(P.histogram(pixels(s, d)), PAL).select("place", "idx", F.col("colors").cast("bigint").alias("colors"))
ORACLES["palette_sort_usage"] = f"with {_FIT}, u as (select idx, count(*) as colors from m group by idx) select cast(row_number() over (order by coalesce(colors, 0) desc, idx) - 1 as integer) as place, idx, coalesce(colors, 0) as colors from pal left join u using (idx)"
QUERIES["palette_dedupe"] = lambda s, d: P.dedupe(
    palette(s).unionByName(palette(s).withColumn("idx", F.col("idx") + 16)).unionByName(palette(s).withColumns({"idx": F.col("idx") + 32, "pr": F.lit(255) - F.col("pr")}))
)
ORACLES["palette_dedupe"] = f"""with {PALETTE_SQL}, u as (select * from pal union all select idx + 16, pr, pg, pb from pal union all select idx + 32, 255 - pr, pg, pb from pal),
f as (select pr, pg, pb, min(idx) as first_idx from u group by all) select pr, pg, pb, first_idx, cast(row_number() over (order by first_idx) - 1 as integer) as idx from f"""
QUERIES["palette_compact_remap"] = lambda s, d: P.compact(pixels(s, d), ("frame_idx",))
ORACLES["palette_compact_remap"] = f"with {PX_SQL}, u as (select frame_idx, idx, count(*) as pixels from px group by 1, 2) select frame_idx, idx, pixels, cast(row_number() over (partition by frame_idx order by idx) - 1 as integer) as new_idx from u"


def _frame_palettes(s, d):
    px = pixels(s, d)
    return px.groupBy("frame_idx", "idx").agg(F.min("r").alias("pr"), F.min("g").alias("pg"), F.min("b").alias("pb"))


QUERIES["global_palette_union"] = lambda s, d: P.global_union(_frame_palettes(s, d))
ORACLES["global_palette_union"] = f"""with {PX_SQL}, p as (select frame_idx, idx, min(r) as pr, min(g) as pg, min(b) as pb from px group by 1, 2),
f as (select pr, pg, pb, min(frame_idx * 1000 + idx) as place from p group by all) select cast(row_number() over (order by place) - 1 as integer) as idx, pr, pg, pb, row_number() over (order by place) <= 256 as fits from f"""
QUERIES["palette_waste"] = lambda s, d: P.waste(pixels(s, d), 16)
ORACLES["palette_waste"] = f"with {PX_SQL} select frame_idx, count(distinct idx) as used, 16 - count(distinct idx) as wasted, count(distinct idx) < 14.4 as may_help from px group by 1"


def _bayer(bits: int) -> str:
    """A Bayer matrix by its law: each bit of x and y, the lowest weighing most, adds two bits, x xor y and y."""
    return " + ".join(f"((xor(x >> {k}, y >> {k}) & 1) * 2 + ((y >> {k}) & 1)) * {4 ** (bits - 1 - k)}" for k in range(bits))


def _dither(name: str, side: int, rank: str):
    """``rank``: SQL of the matrix' entry at x, y."""
    QUERIES[f"ordered_dither_{name}"] = lambda s, d: P.ordered_dither(pixels(s, d), PAL, name).select("frame_idx", "x", "y", "idx")
    shifted = ", ".join(f"cast(trunc(least(greatest({c} + (({rank} + 0.5e0) / {side * side} - 0.5e0) * 32e0, 0e0), 255e0)) as integer) as {c}" for c in "rgb")
    ORACLES[f"ordered_dither_{name}"] = f"""with {PX_SQL}, {PALETTE_SQL}, q as (select frame_idx, x, y, {shifted} from px),
    n as (select frame_idx, x, y, idx, row_number() over (partition by frame_idx, x, y order by {_DIST}, idx) as k from q, pal) select frame_idx, x, y, idx from n where k = 1"""


for _bits in (1, 2, 3, 4):
    _dither(f"bayer{1 << _bits}", 1 << _bits, f"({_bayer(_bits)})")
_dither("clustered4", 4, "([12, 16, 11, 13, 14, 8, 9, 10, 6, 2, 1, 7, 4, 0, 3, 5])[(y % 4) * 4 + x % 4 + 1]")
_dither("bluenoise8", 8, f"({P.BLUENOISE8})[(y % 8) * 8 + x % 8 + 1]")  # values without a law
QUERIES["fixed_palette_luma"] = lambda s, d: P.fixed_palette(s, P.named_palette("websafe"))
ORACLES["fixed_palette_luma"] = """with s as (select unnest([0, 51, 102, 153, 204, 255]) as v), c as (select r.v as pr, g.v as pg, b.v as pb from s r, s g, s b)
select pr, pg, pb, cast(row_number() over (order by round(0.2126e0 * pr + 0.7152e0 * pg + 0.0722e0 * pb, 6), pr, pg, pb) - 1 as integer) as idx from c"""


def _centroids(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = e.select("label", F.posexplode("v").alias("k", "c")).groupBy("label", "k").agg(F.avg("c").alias("c"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda p: p["c"]).alias("m"))
    # as many centroids as labels; Spark sees their size
    dist = F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    j = e.select("vec_id", "v").crossJoin(means).groupBy("vec_id").agg(F.min(F.struct(F.round(dist, 9).alias("d"), F.col("label").alias("label"))).alias("n"))
    return j.select("vec_id", F.col("n.label").alias("centroid"), F.round(F.col("n.d"), 6).alias("distance"))


QUERIES["embedding_nearest_centroid"] = _centroids
ORACLES["embedding_nearest_centroid"] = """with e as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as k from embeddings),
m as (select label, k, avg(v) as c from e group by label, k),
n as (select vec_id, m.label as centroid, round(sum((v - c) * (v - c)), 9) as dd from e join m using (k) group by vec_id, m.label),
r as (select *, row_number() over (partition by vec_id order by dd, centroid) as rank from n) select vec_id, centroid, round(dd, 6) as distance from r where rank = 1"""
QUERIES["auto_rules"] = lambda s, d: s.range(4096).select(
    F.col("id"), P.auto_method(F.lit(10), F.col("id") * 37 % 12000, F.col("id") % 256 + 1).alias("method"),
    P.auto_dither(F.col("id") % 256 + 1, F.col("id") * 7 % 100 / 100.0, F.col("id") % 2 == 0).alias("dither"),
)
ORACLES["auto_rules"] = """with t as (select i as id, i * 37 % 12000 as seen, i % 256 + 1 as n, (i * 7 % 100) / 100e0 as motion from range(4096) r(i))
select id, case when n <= 8 then case when seen > 8192 then 'wu' else 'median-cut' end when seen < 1500 then 'median-cut' when n <= 64 then 'kmeans' else 'imagequant' end as method,
case when n >= 128 and motion > 0.65e0 then null when n >= 64 and id % 2 = 0 then 'bluenoise8' when n <= 16 then 'floyd-steinberg' when n <= 32 then 'atkinson' else 'bayer8' end as dither from t"""
