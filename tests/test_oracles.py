"""Every query that has SQL gives the SQL's rows."""

from __future__ import annotations

import duckdb
import pytest

from frameweave.operators import temporal
from frameweave.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, (bytes, bytearray)) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck, sf):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() >= 0


@pytest.mark.parametrize("stretch", [1, 3])
@pytest.mark.parametrize("name", ["composite", "composite_dirty_rect", "frame_diff_stats", "trails", "cursor_echo", "crossfade", "wipe_left", "dirty_rect"])
def test_clips_longer_than_a_stretch(name, stretch, spark, monkeypatch):
    """Forty frames in stretches of a few."""
    monkeypatch.setattr(temporal, "STRETCH", stretch)
    con = duckdb.connect()
    con.execute("create view events as select * from '/root/testdata/sf0.01/events.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    want = con.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_flags_of_codecs(spark, sf):
    assert all(r.round_trip for r in QUERIES["lzw_bytes"](spark, sf).collect())
    assert all(r.same_pictures for r in QUERIES["optimize_clip"](spark, sf).collect())
