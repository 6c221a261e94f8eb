"""Colour histograms, palettes and the mapping of pixels to palette entries.

Pixels are first aggregated to distinct colours; what is expensive (distances to a palette of at most 256 entries) is done
once for each distinct colour. The palette is a table or, once chosen, an array literal that travels with the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import byte, hex_color, luma709, pack_rgb, redmean_sq, unpack_rgb


def histogram(px: DataFrame, keys: tuple[str, ...] = (), alpha_cut: int = 8, step: int = 1) -> DataFrame:
    """Weight of each colour; a pixel weighs its alpha's share, and ``step * step`` where only every step-th is looked at."""
    seen = px.where(F.col("a") > alpha_cut) if "a" in px.columns else px
    if step > 1:
        seen = seen.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    weight = F.col("a") / 255.0 if "a" in px.columns else F.lit(1.0)
    return seen.groupBy(*keys, pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("key")).agg((F.sum(weight) * (step * step)).alias("weight"))


def dominant(hist: DataFrame, k: int = 8, keys: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` heaviest colours with their shares."""
    total = hist.groupBy(*keys).agg(F.sum("weight").alias("total"))
    if keys:
        ranked = hist.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("weight"), "key"))).where(F.col("rank") <= k).join(total, list(keys))
    else:
        top = hist.orderBy(F.desc("weight"), "key").limit(k)  # at most k rows: one window over them is small
        ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("weight"), "key"))).crossJoin(total)
    r, g, b = unpack_rgb(F.col("key"))
    return ranked.select(*keys, "rank", "key", F.round("weight", 6).alias("weight"), F.round(F.col("weight") / F.col("total"), 6).alias("share"), hex_color(r, g, b).alias("hex"))


def palette_literal(palette: list[tuple[int, int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(int(r)).alias("r"), F.lit(int(g)).alias("g"), F.lit(int(b)).alias("b")) for i, (r, g, b) in enumerate(palette)))


def nearest(r: Column, g: Column, b: Column, palette: list[tuple[int, int, int]]) -> Column:
    """``struct(d, i)``: redmean distance and index of the nearest entry, the first of equal ones."""
    return F.array_min(F.transform(palette_literal(palette), lambda p: F.struct(redmean_sq(r, g, b, p["r"], p["g"], p["b"]).alias("d"), p["i"].alias("i"))))


def map_pixels(px: DataFrame, palette: list[tuple[int, int, int]], alpha_threshold: int = 128) -> DataFrame:
    """``px`` with ``idx``: the nearest palette entry, null where alpha is below the threshold."""
    i = nearest(F.col("r"), F.col("g"), F.col("b"), palette)["i"]
    return px.withColumn("idx", F.when(F.col("a") >= alpha_threshold, i) if "a" in px.columns else i)


def map_colors(hist: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """``hist`` with ``idx`` and ``distance`` of the nearest palette entry."""
    r, g, b = unpack_rgb(F.col("key"))
    return hist.withColumn("_n", nearest(r, g, b, palette)).select(*hist.columns, F.col("_n.i").alias("idx"), F.col("_n.d").alias("distance"))


def quantization_error(hist: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Root of the weighted mean redmean distance, by channel."""
    return map_colors(hist, palette).agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("distance")) / F.sum("weight") / 3), 6).alias("rmse"))


def dedupe(palette: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct colours in the order of their first places: ``idx`` (new), ``first_idx``."""
    first = palette.groupBy(*keys, "pr", "pg", "pb").agg(F.min("idx").alias("first_idx"))
    return first.withColumn("idx", (F.row_number().over(W.partitionBy(*keys, F.lit(0)).orderBy("first_idx")) - 1).cast("int"))


def sort_by_usage(hist: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Palette entries by the number of distinct colours that are mapped to them; equal ones keep their order."""
    used = map_colors(hist, palette).groupBy("idx").agg(F.count("*").alias("colors"))
    spark = hist.sparkSession
    entries = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(palette)], "idx int, pr int, pg int, pb int")
    full = entries.join(used, "idx", "left").withColumn("colors", F.coalesce("colors", F.lit(0)))
    return full.withColumn("place", F.row_number().over(W.orderBy(F.desc("colors"), "idx")) - 1)  # at most 256 rows


def compact(ipx: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Used indexes and their new numbers, dense and in order."""
    used = ipx.where("idx is not null").groupBy(*keys, "idx").agg(F.count("*").alias("pixels"))
    return used.withColumn("new_idx", (F.row_number().over(W.partitionBy(*keys, F.lit(0)).orderBy("idx")) - 1).cast("int"))


def global_union(palettes: DataFrame, most: int = 256) -> DataFrame:
    """Ordered union of frames' palettes (``frame_idx``, ``idx``, ``pr``, ``pg``, ``pb``): each colour once, where it first
    stands; ``fits`` tells whether it is among the first ``most``."""
    place = F.min(F.struct("frame_idx", "idx")).alias("first")
    distinct = palettes.groupBy("pr", "pg", "pb").agg(place)
    # more than 2 ** 24 colours there cannot be
    ranked = distinct.withColumn("idx", F.row_number().over(W.orderBy("first")) - 1)
    return ranked.select("idx", "pr", "pg", "pb", (F.col("idx") < most).alias("fits"))


def waste(ipx: DataFrame, palette_size: int, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Used and wasted palette entries, and whether encoding anew may help (less than nine tenths are used)."""
    out = ipx.groupBy(*keys).agg(F.count_distinct("idx").alias("used"))
    return out.select(*keys, "used", (F.lit(palette_size) - F.col("used")).alias("wasted"), (F.col("used") < 0.9 * palette_size).alias("may_help"))


# --- ordered dither ---

#: Small threshold matrices.
BAYER2 = [0, 2, 3, 1]
CLUSTERED4 = [12, 16, 11, 13, 14, 8, 9, 10, 6, 2, 1, 7, 4, 0, 3, 5]
BLUENOISE8 = [
    26, 16, 31, 36, 21, 2, 5, 24, 41, 48, 12, 56, 46, 33, 50, 14, 6, 29, 0, 20, 10, 38, 35, 18, 54, 44, 62, 49, 58, 1, 45, 3,
    19, 34, 8, 27, 4, 30, 13, 55, 63, 52, 60, 23, 51, 47, 61, 40, 11, 37, 28, 15, 39, 7, 25, 57, 32, 43, 22, 42, 17, 53, 26, 9,
]


def bayer(side: int) -> list[int]:
    """The recursive threshold matrix of ``side`` (a power of two), row by row."""
    rows, n = [[0]], 1
    while n < side:
        rows = [[4 * rows[y % n][x % n] + BAYER2[(y // n) * 2 + x // n] for x in range(2 * n)] for y in range(2 * n)]
        n *= 2
    return [v for row in rows for v in row]


MATRICES = {"bayer2": bayer(2), "bayer4": bayer(4), "bayer8": bayer(8), "bayer16": bayer(16), "clustered4": CLUSTERED4, "bluenoise8": BLUENOISE8, "void": BLUENOISE8}


def thresholds(name: str) -> list[float]:
    m = MATRICES[name]
    return [(v + 0.5) / len(m) - 0.5 for v in m]


def ordered_dither(px: DataFrame, palette: list[tuple[int, int, int]], matrix: str = "bayer8", strength: float = 32.0) -> DataFrame:
    """``px`` with ``idx``: nearest entry after the matrix' threshold times ``strength`` is added to every channel."""
    t = thresholds(matrix)
    side = round(len(t) ** 0.5)
    at = ((F.col("y") % side) * side + F.col("x") % side + 1).cast("int")
    shift = F.element_at(F.array(*map(F.lit, t)), at) * F.lit(float(strength))
    r, g, b = (byte(F.col(c) + shift) for c in "rgb")
    return px.withColumn("idx", nearest(r, g, b, palette)["i"])


def auto_dither(colors: Column, motion: Column, photo: Column) -> Column:
    """Name of the dither that suits; null for none."""
    none = (colors >= 128) & (motion > 0.65)
    return F.when(none, F.lit(None).cast("string")).when((colors >= 64) & photo, "bluenoise8").when(colors <= 16, "floyd-steinberg").when(colors <= 32, "atkinson").otherwise("bayer8")


# --- fixed palettes ---


def named_palette(name: str, colors: int = 64) -> list[tuple[int, int, int]]:
    """Palettes by rule, and a few historical ones."""
    import colorsys
    import math

    steps = (0, 51, 102, 153, 204, 255)
    cube = [(r, g, b) for r in steps for g in steps for b in steps]
    n = max(2, min(256, colors))
    if name in ("websafe", "mac"):
        return cube
    if name == "win":
        return cube[:208] + [(41 * i - 10,) * 3 for i in range(1, 7)]
    if name == "grayscale":
        return [(math.floor(i * 255 / (n - 1) + 0.5),) * 3 for i in range(n)]
    if name in ("mono", "mono2"):
        return [(0, 0, 0), (255, 255, 255)]
    if name == "uniform":
        side = max(2, round(n ** (1 / 3)))
        level = [math.floor(i * 255 / (side - 1) + 0.5) for i in range(side)]
        return [(r, g, b) for r in level for g in level for b in level]
    if name == "pastel":
        hues = [tuple(math.floor(v * 255 + 0.5) for v in colorsys.hls_to_rgb(i / 12, 0.72, 0.55)) for i in range(12)]
        return hues + [(40 + 60 * i,) * 3 for i in range(4)]
    return HISTORICAL[name]


#: Screens of old machines.
HISTORICAL = {
    "gameboy": [(33, 42, 18), (88, 109, 43), (158, 185, 84), (202, 222, 173)],
    "gameboy-pocket": [(49, 73, 52), (91, 118, 76), (147, 173, 112), (203, 223, 173)],
    "cga16": [
        (0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255),
        (128, 128, 128), (192, 192, 192), (128, 0, 0), (128, 128, 0), (0, 128, 0), (128, 0, 128), (0, 0, 128),
    ],
    "pico8": [
        (0, 0, 0), (29, 43, 83), (126, 37, 83), (33, 65, 58), (126, 126, 126), (171, 89, 9), (192, 144, 94), (222, 222, 222), (128, 144, 222),
        (142, 90, 138), (142, 142, 142), (222, 176, 176), (72, 72, 72), (222, 214, 11), (204, 196, 148),
    ],
    "nes": [
        (0, 0, 0), (252, 252, 252), (184, 184, 184), (108, 108, 108), (0, 252, 252), (44, 232, 168), (68, 160, 44), (156, 36, 0), (248, 0, 0),
        (252, 152, 120), (188, 96, 144), (196, 60, 156), (136, 136, 136), (240, 216, 176), (108, 218, 144), (76, 156, 108), (80, 156, 148), (64, 124, 208),
        (80, 156, 0), (128, 116, 160), (120, 40, 200), (80, 32, 240), (88, 0, 192), (120, 0, 104), (144, 0, 48), (132, 0, 32), (112, 40, 48),
        (72, 120, 68), (68, 168, 116), (96, 160, 96), (112, 132, 64), (136, 136, 136), (0, 248, 248), (104, 248, 184), (96, 192, 164), (120, 120, 140),
        (164, 112, 196), (184, 96, 220), (188, 96, 188),
    ],
    "c64": [
        (0, 0, 0), (255, 255, 255), (129, 52, 56), (60, 187, 97), (142, 65, 182), (40, 71, 158), (142, 120, 55), (153, 168, 254), (105, 75, 57),
        (170, 109, 92), (204, 173, 178), (32, 91, 58), (203, 209, 145), (144, 127, 148), (180, 194, 79), (30, 185, 248), (241, 239, 239), (246, 0, 0),
    ],
    "amstrad": [
        (0, 0, 0), (0, 0, 170), (0, 0, 255), (0, 170, 0), (0, 170, 170), (0, 170, 255), (0, 255, 0), (0, 255, 170), (0, 255, 255),
        (170, 0, 0), (170, 0, 170), (170, 0, 255), (170, 85, 0), (170, 85, 170), (170, 85, 85), (255, 170, 85), (0, 170, 170), (170, 170, 170),
        (170, 255, 170), (255, 0, 0), (0, 255, 0), (170, 255, 0), (255, 255, 170), (0, 255, 170), (170, 255, 170), (255, 255, 255), (0, 255, 255),
        (170, 255, 255),
    ],
    "zx": [
        (0, 0, 0), (215, 0, 0), (0, 215, 0), (215, 215, 0), (0, 0, 215), (215, 0, 215), (0, 215, 215), (215, 215, 215), (0, 0, 255),
        (255, 0, 0), (0, 255, 0), (255, 255, 0), (0, 0, 255), (255, 0, 255), (0, 255, 255), (255, 0, 255), (255, 255, 255), (0, 0, 127),
        (127, 127, 255), (127, 127, 127), (255, 127, 127), (127, 255, 255), (127, 0, 0), (255, 255, 0), (255, 255, 255), (0, 0, 0), (0, 0, 0),
        (127, 0, 0), (0, 127, 127), (0, 0, 127), (0, 127, 127), (127, 0, 127),
    ],
}
#: Names that ``named_palette`` knows.
PALETTES = ("websafe", "mac", "win", "grayscale", "mono", "mono2", "uniform", "pastel", *HISTORICAL)


def is_ordered(dither: str) -> bool:
    """Whether a dither is a matrix of thresholds, and so needs nothing but a pixel and its place."""
    return dither in MATRICES


def histogram_arrays(hist: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each histogram: ``colors`` (packed, ascending), ``weights``, and the channels as arrays ``r``, ``g``, ``b``."""
    entries = F.array_sort(F.collect_list(F.struct("key", "weight")))
    one = hist.groupBy(*keys).agg(entries.alias("_e"))
    channel = lambda k: F.transform("_e", lambda e: unpack_rgb(e["key"])[k])
    return one.select(*keys, F.transform("_e", lambda e: e["key"]).alias("colors"), F.transform("_e", lambda e: e["weight"]).alias("weights"), *(channel(k).alias(c) for k, c in enumerate("rgb")))


def select_heavy(hist: DataFrame, most: int, keys: tuple[str, ...] = (), share: float = 0.05) -> DataFrame:
    """The ``most`` heaviest colours of each histogram; of the others a ``share`` of their weight goes to one of these: the heaviest
    in the first of the 27 buckets around (four bits for each channel) that has any, or the heaviest of all."""
    by = list(keys) or [F.lit(0).alias("_all")]
    one = [c if isinstance(c, str) else "_all" for c in by]
    hist = hist.select(*([] if keys else by), "*")
    rank = F.row_number().over(W.partitionBy(*one).orderBy(F.desc("weight"), "key"))
    bits = lambda shift: F.shiftright("key", shift).bitwiseAND(15)
    ranked = hist.withColumns({"_rank": rank, "_cell": bits(19) * 256 + bits(11) * 16 + bits(3)})
    kept = ranked.where(F.col("_rank") <= most)
    # the few that are kept reach into the buckets around them; the others, which are many, look one bucket up each
    shifts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(b * 256 + g * 16 + r for b in (-1, 0, 1) for g in (-1, 0, 1) for r in (-1, 0, 1)))))
    reach = kept.select(*one, "_rank", "_cell", shifts.alias("_s")).groupBy(*one, (F.col("_cell") - F.col("_s.d")).alias("_cell")).agg(F.min(F.struct("_s.i", "_rank"))["_rank"].alias("_to"))
    tail = ranked.where(F.col("_rank") > most).select(*one, "weight", "_cell").join(reach, [*one, "_cell"], "left")
    given = tail.groupBy(*one, F.coalesce("_to", F.lit(1)).alias("_rank")).agg(F.sum("weight").alias("_more"))
    out = kept.join(given, [*one, "_rank"], "left")
    return out.select(*keys, "key", (F.col("weight") + F.coalesce("_more", F.lit(0.0)) * share).alias("weight"))


def fixed_palette(spark, colors: list[tuple[int, int, int]]) -> DataFrame:
    """A fixed palette by luma."""
    df = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(colors)], "at int, pr int, pg int, pb int")
    luma = F.round(luma709(F.col("pr"), F.col("pg"), F.col("pb")), 6)
    return df.withColumn("idx", (F.row_number().over(W.orderBy(luma, "at")) - 1).cast("int")).drop("at")


def auto_method(frames: Column, colors_seen: Column, wanted: Column) -> Column:
    """Quantizer by rule: few wanted colours, then few distinct ones, then what refines."""
    few = F.when(colors_seen > 8192, "wu").otherwise("median-cut")
    return F.when(wanted <= 8, few).when(colors_seen < 1500, "median-cut").when(wanted <= 64, "kmeans").otherwise("imagequant")
