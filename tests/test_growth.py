"""Steps that have to grow no faster than their input, against plain versions and on inputs at which a quadratic one doesn't end."""

from __future__ import annotations

import bisect
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from frameweave.catalog import media
from frameweave.operators import palettes as P
from frameweave.operators import samples as SM
from frameweave.operators import size_model as M
from frameweave.operators import spatial as S
from frameweave.sources import demux, mux


def within(seconds, step):
    began = time.perf_counter()
    out = step()
    assert time.perf_counter() - began < seconds
    return out


def fed(rng, n, numbers):
    rows = [{"track_id": 3, "sample_idx": numbers(i), "pts": i * 10 + rng.choice((0, 0, 15, -15)), "key": rng.choice((i % 8 == 0, None)), "size": 0 if rng.random() < 0.05 else 5, "ok": rng.choice((True, True, True, True, False, None))} for i in range(n)]
    rng.shuffle(rows)
    return pa.Table.from_pylist(rows, pa.schema([("track_id", pa.int64()), *((c, pa.int64()) for c in ("sample_idx", "pts")), ("key", pa.bool_()), ("size", pa.int64()), ("ok", pa.bool_())]))


@pytest.mark.parametrize("window", [0, 4, 1 << 30])
@pytest.mark.parametrize("most", [0, 2, 1 << 30])
def test_columns_decode_as_the_fold(window, most):
    rng = random.Random(window + most)
    for n in [*range(6), 40, 90]:
        for numbers in (lambda i: i, lambda i: i * 3 - 7, lambda i: i // 2):
            table = fed(rng, n, numbers) if n else fed(rng, 1, numbers).slice(0, 0)
            places, times, stats = SM._run(table, window, most)
            fold = SM.Replay(window, most)
            rows = sorted(table.to_pylist(), key=lambda r: r["sample_idx"])
            want = [p for r in rows for p in fold.feed(*(r[c] for c in SM.FED))] + fold.finish()
            assert list(zip(places.tolist(), times.tolist(), strict=True)) == want and stats == fold.stats


def test_many_pictures_wait(spark):
    n = 40_000
    fold = SM.Replay(1 << 30, 1 << 30)
    got = within(8, lambda: [p for i in range(n) for p in fold.feed(i, -i, i % 7 == 0, 1, i % 53 != 52 or i % 7 == 0)] + fold.finish())
    assert [s for s, _ in got] == [i for i in reversed(range(n)) if i % 53 != 52 or i % 7 == 0]
    df = spark.range(n).selectExpr("1L as track_id", "id as sample_idx", "-id as pts", "id % 7 = 0 as key", "1L as size", "id % 53 <> 52 or id % 7 = 0 as ok")
    rows = within(30, lambda: SM.decode(df, 1 << 30, 1 << 30).orderBy("out_idx").collect())
    assert [(r.sample_idx, r.pts) for r in rows] == got


def test_seeking_goes_through_a_track_once(spark):
    """Against a search in sorted times, with ties; no window of its plan reaches to the end, which takes the square of a track's rows."""
    n = 3000
    rng = random.Random(4)
    frames = [(t, i, rng.randrange(900), i % 9 == 4) for t in range(2) for i in range(n)]
    wanted = [(t, k, rng.randrange(-50, 1000) / 1.0) for t in range(3) for k in range(500)]
    times = spark.createDataFrame([(t, i, float(p), k) for t, i, p, k in frames], "track_id bigint, sample_idx bigint, pts_ms double, key boolean")
    df = SM.seek_range(times, spark.createDataFrame(wanted, "track_id bigint, k bigint, want_ms double"))
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    keyed = {(t, i): max((j for j in range(i + 1) if j % 9 == 4), default=0) for t in range(2) for i in range(n)}
    shown = {t: sorted((float(p), i) for u, i, p, _ in frames if u == t) for t in range(2)}
    want = []
    for t, k, w in wanted:
        if t in shown:
            at = min(bisect.bisect_left(shown[t], (w - 1.0, -1)), n - 1)
            p, i = shown[t][at]
            want.append((t, k, w, keyed[t, i], i, i - keyed[t, i] + 1, p))
    assert sorted(map(tuple, df.collect())) == sorted(want)


def peak(step):
    """What a step returns, and the most bytes that it held at once."""
    tracemalloc.start()
    try:
        return step(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def tracks(n):
    i = np.arange(n)
    return {"sample_idx": i, "size": i * 7 % 61 + 1, "duration": i % 5 * 100 + 500, "cts": i % 4 * 700, "key": i % 7 == 0, "pts": i * 33}


def as_dicts(rows):
    return [dict(zip(rows, r, strict=True)) for r in zip(*(c.tolist() for c in rows.values()), strict=True)]


def test_long_webm_files():
    """Clusters are appended to one file; a new one for each took the square of their number."""
    n = 250_000
    rows = tracks(n)
    raw = within(20, lambda: mux.webm(rows, media._bytes_of(rows), "V_VP9", 80, 60, 33.0 * n))
    found = within(30, lambda: demux.parse_webm(bytes(raw)))
    assert [found["blocks"].array(c).tolist() for c in ("pts_ms", "size", "key")] == [rows[c].tolist() for c in ("pts", "size", "key")]
    assert len(found["seek"]) == len(found["cues"]) >= n // 7 and all(raw[x["cluster"] : x["cluster"] + 4] == b"\x1f\x43\xb6\x75" for x in found["seek"])
    few = tracks(50)
    assert mux.webm(few, media._bytes_of(few)) == mux.webm(as_dicts(few), media._bytes_of(few).tobytes())
    assert demux.sample_bytes(raw, found["blocks"][-1]) == bytes([(n - 1) % 256]) * int(rows["size"][-1])


def test_only_the_wanted_file_is_made(monkeypatch):
    monkeypatch.setattr(mux, "webm", None)
    assert len(media._cut(0, tracks(100))) == 40


def test_mp4_files_as_columns():
    n = 100_000
    rows = tracks(n)
    raw, made = peak(lambda: mux.mp4(rows, media._bytes_of(rows), 30000, None, 64, 32, edit_delay=10, per_chunk=3))
    found, parsed = peak(lambda: demux.parse_mp4(raw)["tracks"][0])
    assert made < len(raw) + 150 * n and parsed < 200 * n
    s = found["samples"]
    assert all((s.array(c) == rows[c]).all() for c in ("size", "duration", "cts", "key")) and s[n - 1]["dts"] == rows["duration"][:-1].sum()
    assert [demux.sample_bytes(raw, s[i]) for i in (0, 5, n - 1)] == [bytes([i % 256]) * int(rows["size"][i]) for i in (0, 5, n - 1)]
    few = tracks(50)
    assert mux.mp4(few, media._bytes_of(few)) == mux.mp4(as_dicts(few), media._bytes_of(few).tobytes())


def test_chunks_of_runs_in_any_order():
    rng = random.Random(3)
    for _ in range(200):
        runs = [(rng.randint(1, 9), rng.randint(0, 4)) for _ in range(rng.randint(1, 5))]
        want = [next(p for f, p in reversed(runs) if f <= k) if runs[0][0] <= k else runs[0][1] for k in range(1, 12)]
        assert demux._per_chunk(11, 0, [np.array(c) for c in zip(*runs, strict=True)]).tolist() == want
    assert demux._per_chunk(4, 10, [np.zeros(0, dtype=np.int64)] * 3).tolist() == [3] * 4


def test_raw_streams_as_columns():
    n = 60_000
    rows = tracks(n)
    raw = bytes(media._h264(0, rows))
    found, held = peak(lambda: demux.annex_b_track(raw, 25.0))
    assert held < 100 * n
    sizes = rows["size"] + 4 + np.where(rows["sample_idx"] % 10 == 0, len(media.SPS) + 11, 0)
    s = found["samples"]
    assert (s.array("size") == sizes).all() and (s.array("offset") == np.cumsum(sizes) - sizes).all() and s[3]["pts"] == 120_000
    twice = demux.annex_b_track(b"\0\0\1\0\0\1\x65ab\0\0\1\x41c")  # an empty unit has no place of its own
    assert [(x["offset"], x["size"]) for x in twice["samples"]] == [(0, 9), (9, 5)]


def test_avi_files_need_no_rows():
    rows = {"sample_idx": np.arange(1_000_000)}
    raw, held = peak(lambda: media._avi(0, rows))
    assert held < 1 << 20 and len(demux.parse_avi(raw)["frames"]) == 1_000_000 % 9 + 1


def test_plans_of_long_files(spark):
    n = 100_000
    rows = tracks(n)
    files = [(t, bytearray(within(20, lambda t=t: media._any_file(t, rows)))) for t in range(4)]
    got = {r.path: r for r in SM.video_plans(spark.createDataFrame(files, "path bigint, content binary")).selectExpr("path", "size(times) as n", "keys", "array_max(times) as last", "seekable", "error").collect()}
    assert {t: (r.n, r.keys, r.seekable, r.error) for t, r in got.items()} == {0: (n, -(-n // 7), True, None), 1: (n, n // 5, True, None), 2: (n, n // 10, True, None), 3: (n % 9 + 1, n % 9 + 1, True, None)}
    assert got[1].last == (n - 1) * 33.0


def test_counts_without_a_fold(spark, monkeypatch):
    """The same counts as of the fold, which isn't run: its rows are Python values."""
    rows = [(1, i, i * 10, i % 6 == 0, 5 if i % 11 else 0, i not in (4, 9, 13)) for i in range(40)]
    df = spark.createDataFrame(rows, "track_id bigint, sample_idx bigint, pts bigint, key boolean, size bigint, ok boolean")
    fold = SM.Replay(4, 2)
    for _, *r in rows:
        fold.feed(*r)
    fold.finish()
    monkeypatch.setattr(SM.Replay, "feed", None)
    table = pa.Table.from_pandas(df.toPandas())
    assert SM._run(table, 4, 2)[2] == fold.stats
    assert SM.decode_stats(df, 4, 2).drop("track_id").collect()[0].asDict() == fold.stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", ["mirror", "edge"])
def test_padding_needs_no_join(spark, mode):
    def source(t, d, n):
        at = t - d
        return min(max(at, 0), n - 1) if mode == "edge" else at % (2 * n) if at % (2 * n) < n else 2 * n - 1 - at % (2 * n)

    for w, h, tw, th in ((3, 2, 17, 9), (4, 4, 4, 5), (1, 3, 6, 3), (5, 4, 2, 3)):
        px = [(f, x, y, 10 * x + y + f) for f in range(2) for x in range(-1, w + 1) for y in range(h) if (x + y + f) % 4]
        df = S.pad(spark.createDataFrame(px, "frame_idx long, x int, y int, r int"), w, h, tw, th, mode=mode)
        dx, dy = (tw - w) // 2, (th - h) // 2
        of = {(f, x, y): r for f, x, y, r in px}
        want = [(f, x, y, of[f, source(x, dx, w), source(y, dy, h)]) for f in range(2) for x in range(tw) for y in range(th) if (f, source(x, dx, w), source(y, dy, h)) in of]
        assert sorted(map(tuple, df.select("frame_idx", "x", "y", "r").collect())) == sorted(want)
        assert "Join" not in plan(df) and "Exchange" not in plan(df)


def test_only_counts_of_texts_are_exchanged(spark):
    texts = [(1, "hello world"), (2, ""), (3, None), (4, "äö😀€" * 50 + "\0\n"), (5, "a"), (6, "ab" * 400)]
    df = spark.createDataFrame(texts, "clip_id long, text string")
    own = [(k, i, ord(c) & 15) for k, t in texts for i, c in enumerate(t or "")]
    want = M.index_stats(spark.createDataFrame(own, "clip_id long, pos long, idx int"))
    got = M.text_stats(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert "Window" not in plan(got) and "Generate" not in plan(got)


def test_runs_are_sorted_in_many_tasks(spark):
    df = demux.chunk_runs(spark.range(50).selectExpr("id % 3 as track_id", "id as chunk"), spark.range(5).selectExpr("0L as track_id", "id * 9 as first_chunk", "id as per_chunk"))
    tasks = 16 * spark.sparkContext.defaultParallelism
    assert f"{tasks}), REPARTITION_BY_NUM" in plan(df)


@pytest.mark.parametrize("keys", [("k",), ()])
def test_light_colours_are_not_multiplied(spark, keys):
    """Every light colour looks one bucket up, instead of 27 rows of it."""
    rng = random.Random(8)
    rows = sorted({(k, rng.randrange(1 << 24) & 0x3F3F3F) for k in range(3) for _ in range(60)})
    rows = [(k, c, float(rng.randint(1, 5))) for k, c in rows if keys or k == 0]
    got = P.select_heavy(spark.createDataFrame(rows, "k long, key int, weight double").select(*keys, "key", "weight"), 9, keys)
    want = []
    for k in range(3 if keys else 1):
        own = sorted((-w, c) for q, c, w in rows if q == k)
        cell = lambda c: (c >> 19 & 15) * 256 + (c >> 11 & 15) * 16 + (c >> 3 & 15)
        more = [0.0] * 9
        for w, c in own[9:]:
            near = [r for b in (-1, 0, 1) for g in (-1, 0, 1) for d in (-1, 0, 1) for r in range(9) if cell(own[r][1]) == cell(c) + b * 256 + g * 16 + d]
            more[near[0] if near else 0] -= w
        want += [(*((k,) if keys else ()), c, round(-w + m * 0.05, 6)) for (w, c), m in zip(own[:9], more, strict=True)]
    assert sorted((*r[:-1], round(r[-1], 6)) for r in got.collect()) == sorted(want)
    optimized = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("<= 9" in part for part in optimized.split("Generate ")[1:])  # only of what is kept
