"""Queries that have to take in whole tables, against versions of their own over all rows."""

from __future__ import annotations

import base64
import bisect
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweave.catalog import files
from frameweave.operators import kernels
from frameweave.operators import palettes as P
from frameweave.operators import quantize as Q
from frameweave.operators import temporal as T
from frameweave.plans.bridge import PX_SQL
from frameweave.queries import ORACLES, QUERIES
from frameweave.sources import demux


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("orders", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain_runs(chunks, runs):
    """(key, chunk, value of the last run that isn't beyond it)."""
    of = defaultdict(dict)
    for key, first, value in runs:
        of[key][first] = min(value, of[key].get(first, value))
    starts = {key: sorted(v) for key, v in of.items()}
    at = [(key, c, bisect.bisect_right(starts.get(key, []), c)) for key, c in chunks]
    return sorted(((key, c, of[key][starts[key][i - 1]] if i else None) for key, c, i in at), key=str)


def test_stsc_range_join_takes_every_order(spark, sf, duck):
    orders = duck.execute("select o_orderkey, o_custkey from orders").fetchall()
    got = [tuple(r) for r in QUERIES["stsc_range_join"](spark, sf).select("track_id", "chunk", "per_chunk").collect()]
    assert sorted(got, key=str) == plain_runs([(t, k) for k, _ in orders for t in range(3)], [(k % 3, k, c % 9 + 1) for k, c in orders])
    assert max(r[1] for r in got) == max(k for k, _ in orders) > 1000
    assert sorted(got, key=str) == sorted(duck.execute(ORACLES["stsc_range_join"]).fetchall(), key=str)


def test_runs_reach_over_spans(spark):
    runs, chunks = [(0, 5, 7), (0, 40, 3), (0, 41, 4), (1, 90, 2)], [(t, c) for t in range(3) for c in (0, 4, 5, 6, 39, 40, 41, 42, 89, 90, 91, 5000)] * 2
    want = plain_runs(chunks, runs)
    for span in (1, 8, 1024):
        df = demux.chunk_runs(spark.createDataFrame(chunks, "track_id bigint, chunk bigint"), spark.createDataFrame(runs, "track_id bigint, first_chunk bigint, per_chunk bigint"), span=span)
        assert sorted(map(tuple, df.collect()), key=str) == want


def fnv1a(data):
    h = 0x811C9DC5
    for c in data:
        h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
    return h


def test_byte_codecs_read_whole_texts(spark, tmp_path):
    texts = [None, "", "a", "x" * 24, "x" * 24 + "y", "x" * 24 + "z", "äöü€😀" * 40, "\0\x7f\n" * 30, "word " * 20_000, "ab" * 7]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["byte_codecs"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        b = None if t is None else t.encode()
        want = (None,) * 5 if b is None else (len(b), fnv1a(b), base64.b64encode(b).decode(), b.hex(), True)
        assert (got[i].n, got[i].fnv, got[i].b64, got[i].hex, got[i].same) == want, i
    assert got[4].fnv != got[5].fnv


def frames(duck):
    """Pixels of each frame: place to (idx, r, g, b, a)."""
    out = defaultdict(dict)
    for f, x, y, *rest in duck.execute(f"with {PX_SQL} select frame_idx, x, y, idx, r, g, b, a from px").fetchall():
        out[f][x, y] = tuple(rest)
    return out


def test_palette_compact_remap_sees_every_index(spark, sf, duck):
    want = []
    for f, px in frames(duck).items():
        counts = Counter(v[0] for v in px.values())
        want += [(f, k, counts[k], new) for new, k in enumerate(sorted(counts))]
    got = QUERIES["palette_compact_remap"](spark, sf).select("frame_idx", "idx", "pixels", "new_idx").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[2] for w in want) == duck.execute("select count(*) from events").fetchone()[0]


def test_palette_waste_counts_every_index(spark, sf, duck):
    used = {f: len({v[0] for v in px.values()}) for f, px in frames(duck).items()}
    got = QUERIES["palette_waste"](spark, sf).select("frame_idx", "used", "wasted", "may_help").collect()
    assert sorted(map(tuple, got)) == sorted((f, n, 16 - n, n < 14.4) for f, n in used.items())


def test_gaps_and_waste(spark):
    ipx = spark.createDataFrame([(0, k) for k in (0, 3, 3, 9, 15)] + [(1, k) for k in range(15)], "frame_idx bigint, idx int")
    assert sorted(tuple(r) for r in P.compact(ipx, ("frame_idx",)).where("frame_idx = 0").select("idx", "pixels", "new_idx").collect()) == [(0, 1, 0), (3, 2, 1), (9, 1, 2), (15, 1, 3)]
    assert sorted(map(tuple, P.waste(ipx, 16).collect())) == [(0, 4, 12, True), (1, 15, 1, False)]


def plain_rects(px, threshold, padding, align, side):
    out = []
    for f in sorted(px):
        old = px.get(f - 1, {})
        at = [p for p, v in px[f].items() if p in old and max(*(abs(v[k] - old[p][k]) for k in (1, 2, 3)), abs(v[4] - old[p][4]) >> 2) > threshold]
        if at:
            low = [max(min(p[k] for p in at) - padding, 0) // align * align for k in (0, 1)]
            high = [min(-(-(max(p[k] for p in at) + padding + 1) // align) * align, side) for k in (0, 1)]
            out.append((f, *low, high[0] - low[0], high[1] - low[1], len(at)))
    return out


def test_dirty_rect_aligned_sees_the_whole_frame(spark, sf, duck):
    want = plain_rects(frames(duck), 200, 1, 4, 16)
    got = QUERIES["dirty_rect_aligned"](spark, sf).select("frame_idx", "x0", "y0", "w", "h", "changed").collect()
    assert sorted(map(tuple, got)) == want and want


def test_small_rectangles_are_aligned(spark):
    px = {f: {(x, y): (0, 255 * (f == 1 and (x, y) in ((13, 14), (14, 14))), 0, 0, 255) for x in range(16) for y in range(16)} for f in range(2)}
    df = spark.createDataFrame([(f, x, y, *v[1:]) for f, at in px.items() for (x, y), v in at.items()], "frame_idx bigint, x int, y int, r int, g int, b int, a int")
    got = T.dirty_rect(df, 200, 1, 4, 16, 16).select("frame_idx", "x0", "y0", "w", "h", "changed").collect()
    assert list(map(tuple, got)) == plain_rects(px, 200, 1, 4, 16) == [(1, 12, 12, 4, 4, 2)]


def test_nearest_centroid_of_all_components(spark, sf, duck):
    rows = duck.execute("select vec_id, label, embedding from embeddings").fetchall()
    of = defaultdict(list)
    for _, label, v in rows:
        of[label].append(v)
    means = {label: [sum(c) / len(vs) for c in zip(*vs, strict=True)] for label, vs in of.items()}
    want = {i: min((round(sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), 9), label) for label, m in means.items()) for i, _, v in rows}
    got = {r.vec_id: r for r in QUERIES["embedding_nearest_centroid"](spark, sf).collect()}
    assert set(got) == set(want) and all(len(m) == 64 for m in means.values())
    assert all(got[i].centroid == label and abs(got[i].distance - d) < 2e-6 for i, (d, label) in want.items())


def test_partial_frames_are_filled(spark, sf, duck, tmp_path):
    """Frame 3 of the smallest tables has 232 pixels; a missing and a repeated event lose no frame either."""
    want = {f: bytes(px[x, y][0] if (x, y) in px else 0 for y in range(16) for x in range(16)) for f, px in frames(duck).items()}
    assert {r.frame_idx: bytes(r.indices) for r in files._planes(spark, sf).collect()} == want and set(want) == {0, 1, 2, 3}
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.where("event_id <> 5").unionByName(e.where("event_id = 300")).write.parquet(f"{tmp_path}/events.parquet")
    want[0] = want[0][:5] + b"\0" + want[0][6:]
    assert {r.frame_idx: bytes(r.indices) for r in files._planes(spark, str(tmp_path)).collect()} == want
    for path in (sf, str(tmp_path)):
        assert sorted((r.frame_idx, r.round_trip) for r in QUERIES["lzw_bytes"](spark, path).collect()) == [(f, True) for f in range(4)]
        assert sorted((r.clip_id, r.frames) for r in QUERIES["gif_roundtrip"](spark, path).collect()) == [(f, 1) for f in range(4)]
        assert sorted((r.clip_id, r.same_pictures) for r in QUERIES["optimize_clip"](spark, path).collect()) == [(f, True) for f in range(4)]
        assert sorted(r.frame_idx for r in QUERIES["diffusion_fs"](spark, path).collect()) == list(range(4))


def plain_delays(delays, least=2, total=None):
    """The rule frame by frame."""
    out, true, given = [], 0.0, 0
    for d in delays:
        true += max(0.0, d or 0.0)
        out.append(max(least, math.floor(true + 0.5) - given))
        given += out[-1]
    if total is None:
        return out
    drift, order, turn = math.floor(total + 0.5) - given, sorted(range(len(out)), key=lambda i: -out[i]), 0
    left = abs(drift)
    while left and turn < 6 * len(out):
        i = order[turn % len(out)]
        if drift > 0 or out[i] > least:
            out[i] += 1 if drift > 0 else -1
            left -= 1
        turn += 1
    if out:
        out[-1] = max(least, out[-1] + math.floor(total + 0.5) - sum(out))
    return out


@pytest.mark.parametrize("total", [None, 0.6, 40, 90, 151.2, 400])
def test_delays_frame_by_frame(spark, total):
    rng = random.Random(5)
    clips = [[1, 1, 9], [0.2] * 7, [3.33333] * 30, [100, 0.4, 0.4, 0.4, 50], [None, 5, -3, 0, 2.5], [9, 1, 1, 1, 1, 1], *([rng.choice([0.1, 0.9, 2, 7.7, 30]) for _ in range(rng.randint(1, 25))] for _ in range(12))]
    df = spark.createDataFrame([(k, i, None if d is None else float(d), None if total is None else float(total)) for k, c in enumerate(clips) for i, d in enumerate(c)], "clip_id bigint, frame_idx bigint, delay_cs double, want double")
    got = defaultdict(dict)
    for r in T.quantize_delays(df, total=None if total is None else "want").collect():
        got[r.clip_id][r.frame_idx] = r.delay_q
    assert [[got[k][i] for i in range(len(c))] for k, c in enumerate(clips)] == [plain_delays(c, 2, total) for c in clips]


def test_imagequant_keeps_real_colours_at_any_size():
    rng = np.random.default_rng(3)
    few = rng.integers(0, 256, (12, 3))
    palette, rmse = Q.quantize(few, np.ones(12), 16, "imagequant")
    assert rmse == 0 and sorted(map(tuple, palette)) == sorted(set(map(tuple, few.tolist())))
    many = np.unique(rng.integers(0, 256, (20_000, 3)), axis=0)
    made = Q.imagequant(many.astype(float), np.ones(len(many)), 32)
    assert {tuple(c) for c in made.astype(int).tolist()} <= {tuple(c) for c in many.tolist()}
    entries = rng.integers(0, 256, (9, 3)).astype(float)
    whole = Q._distance(many, entries)
    assert (Q.nearest_colors(entries, many) == many[whole.argmin(axis=0)]).all()


def plain_distance(c, p):
    mean, (dr, dg, db) = (int(c[0]) + int(p[0])) >> 1, (int(a) - int(b) for a, b in zip(c, p, strict=True))
    return (((512 + mean) * dr * dr) >> 8) + 4 * dg * dg + (((767 - mean) * db * db) >> 8)


@pytest.mark.parametrize("kernel", ["floyd-steinberg", "atkinson", "sierra-lite", "stucki"])
def test_diffusion_pixel_by_pixel(kernel):
    rng = np.random.default_rng(4)
    palette = [(0, 0, 0), (255, 255, 255), (200, 30, 40), (20, 90, 220)]
    pictures = rng.integers(0, 256, (5, 7, 9, 3))
    div, taps = Q.DIFFUSION[kernel]
    for picture, got in zip(pictures, Q.diffuse(pictures, np.array(palette, dtype=float), kernel), strict=True):
        work = {(x, y): [float(v) for v in picture[y, x]] for y in range(7) for x in range(9)}
        for y in range(7):
            for x in reversed(range(9)) if y % 2 else range(9):
                want = [min(255.0, max(0.0, v)) for v in work[x, y]]
                i = min(range(4), key=lambda k: (plain_distance([round(v) for v in want], palette[k]), k))
                assert got[y, x] == i
                for dx, dy, part in taps:
                    to = (x - dx if y % 2 else x + dx, y + dy)
                    if to in work:
                        work[to] = [v + (a - b) * part / div for v, a, b in zip(work[to], want, palette[i], strict=True)]


@pytest.mark.parametrize("method", sorted(set(Q.QUANTIZERS) - set(Q.FIXED)))
def test_quantizers_find_what_there_is(method):
    """Twelve colours into sixteen entries cost nothing; three clouds into three entries find their middles; order doesn't matter."""
    rng = np.random.default_rng(7)
    few = rng.integers(0, 32, (12, 3)) * 8 + 3
    palette, rmse = Q.quantize(few, rng.integers(1, 9, 12).astype(float), 16, method)
    assert rmse == 0 and set(map(tuple, few.tolist())) <= set(map(tuple, palette.tolist()))
    middles = np.array([(40, 60, 200), (220, 40, 30), (30, 220, 90)])
    cloud = np.unique(np.concatenate([rng.integers(-10, 11, (400, 3)) + m for m in middles]), axis=0)
    palette, rmse = Q.quantize(cloud, np.ones(len(cloud)), 3, method)
    assert len(palette) == 3 and all(min(np.abs(p - m).max() for p in palette) <= 6 for m in middles)
    shuffled = rng.permutation(len(cloud))
    again, _ = Q.quantize(cloud[shuffled][np.lexsort(cloud[shuffled].T[::-1])], np.ones(len(cloud)), 3, method)
    assert sorted(map(tuple, again.tolist())) == sorted(map(tuple, palette.tolist()))


def plain_wu(colors, weights, n):
    """The greedy splits by looking at every colour of every part."""
    cells = colors >> 3

    def spread(own):
        w = weights[own]
        return ((colors[own] * w[:, None]).sum(axis=0) ** 2).sum() / w.sum() if len(own) else 0.0

    def best(own):
        found = (0.0, 0, 0)
        for axis in range(3):
            for at in range(1, 32):
                low, high = own[cells[own, axis] < at], own[cells[own, axis] >= at]
                if len(low) and len(high):
                    gain = spread(low) + spread(high) - spread(own)
                    if gain > found[0] + 1e-6:
                        found = (gain, axis, at)
        return found

    boxes = [np.arange(len(colors))]
    while len(boxes) < n:
        found = [best(b) for b in boxes]
        k = max(range(len(boxes)), key=lambda i: found[i][0])
        if found[k][0] <= 0:
            break
        _, axis, at = found[k]
        own = boxes[k]
        boxes[k : k + 1] = [own[cells[own, axis] < at], own[cells[own, axis] >= at]]
    return sorted(tuple(np.average(colors[b], axis=0, weights=weights[b]).round(4)) for b in boxes)


def test_wu_by_looking_at_every_colour():
    rng = np.random.default_rng(12)
    colors, weights = np.unique(rng.integers(0, 256, (300, 3)), axis=0), None
    weights = rng.integers(1, 20, len(colors)).astype(float)
    for n in (2, 5, 12):
        assert sorted(tuple(p.round(4)) for p in Q.wu(colors.astype(float), weights, n)) == plain_wu(colors, weights, n)


def plain_resample(picture, to_w, to_h, weight):
    """Each place by the weights of all source pixels, colours times alpha; ``weight(n, m, t)`` gives a row of them."""
    h, w, _ = picture.shape
    out = np.zeros((to_h, to_w, 4), dtype=int)
    for y in range(to_h):
        for x in range(to_w):
            k = np.outer(weight(h, to_h, y), weight(w, to_w, x))
            a = (picture[..., 3] * k).sum()
            rgb = [(picture[..., c] * picture[..., 3] * k).sum() / a if a > 0 else 0 for c in range(3)]
            out[y, x] = [min(255, max(0, math.floor(v + 0.5))) for v in (*rgb, a)]
    return out


def test_lanczos_and_cubic_place_by_place(spark):
    rng = np.random.default_rng(6)
    picture = rng.integers(0, 256, (6, 7, 4))
    picture[..., 3] = rng.integers(60, 256, (6, 7))
    df = spark.createDataFrame([(0, x, y, *map(int, picture[y, x])) for y in range(6) for x in range(7)], "frame_idx bigint, x int, y int, r int, g int, b int, a int")

    def lanczos(reach):
        def weight(n, m, t):
            k = max(1.0, n / m)
            d = [(i + 0.5 - (t + 0.5) * n / m) / k for i in range(n)]
            v = [0.0 if abs(x) >= reach else 1.0 if x == 0 else reach * math.sin(math.pi * x) * math.sin(math.pi * x / reach) / (math.pi * x) ** 2 for x in d]
            return np.array(v) / sum(v)

        return weight

    for name, weight in (("lanczos2", lanczos(2)), ("lanczos3", lanczos(3))):
        for to in ((4, 3), (9, 11)):
            want = plain_resample(picture, *to, weight)
            for r in kernels.scale_smooth(df, 7, 6, *to, name).collect():
                assert np.abs(want[r.y, r.x] - [r.r, r.g, r.b, r.a]).max() <= 1


def test_rotation_place_by_place(spark):
    rng = np.random.default_rng(8)
    picture = rng.integers(0, 256, (5, 8, 4))
    picture[..., 3] = 255
    df = spark.createDataFrame([(0, x, y, *map(int, picture[y, x])) for y in range(5) for x in range(8)], "frame_idx bigint, x int, y int, r int, g int, b int, a int")
    c, s = math.cos(math.radians(25)), math.sin(math.radians(25))
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in kernels.rotate_any(df, 8, 5, 25.0).collect()}
    w, h = math.ceil(8 * c + 5 * s), math.ceil(8 * s + 5 * c)
    assert max(x for x, _ in got) < w and max(y for _, y in got) < h
    for y in range(h):
        for x in range(w):
            dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
            sx, sy = c * dx + s * dy + 3.5, -s * dx + c * dy + 2
            total = np.zeros(4)
            for j in (math.floor(sy), math.floor(sy) + 1):
                for i in (math.floor(sx), math.floor(sx) + 1):
                    if 0 <= i < 8 and 0 <= j < 5:
                        total += (1 - abs(sx - i)) * (1 - abs(sy - j)) * picture[j, i]
            alpha = math.floor(total[3] + 0.5)
            assert abs(got.get((x, y), (0, 0, 0, 0))[3] - alpha) <= 1
            if alpha > 2:
                assert np.abs(np.array(got[x, y][:3]) - total[:3] * 255 / total[3]).max() <= 1
