"""Streams with state."""

from __future__ import annotations

from frameweave.operators.samples import Replay
from frameweave.streaming import state


def run(spark, tmp_path, make, batches, schema=state.FRAME):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]


def test_reorder(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: state.reorder(s, 2), [[(1, 20, 2.0), (1, 10, 1.0), (1, 10, 1.0), (1, 30, 3.0)], [(1, 50, 5.0), (1, 40, 4.0), (1, 60, 6.0), (2, 5, 0.5)]])
    assert sorted(got) == [(1, 10, 1.0), (1, 20, 2.0), (1, 30, 3.0), (1, 40, 4.0)]


def test_running_mean(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: state.running_mean(s, 0.5), [[(1, 1, 10.0), (1, 2, 20.0)], [(1, 3, 5.0)]])
    assert sorted(got) == [(1, 1, 10.0), (1, 2, 15.0), (1, 3, 10.0)]


def test_trails_and_stabilizer_over_triggers(spark, tmp_path):
    rows = [[(1, i, float(v)) for i, v in part] for part in ([(0, 8), (1, 1)], [(2, 1), (3, 1)])]
    assert sorted(run(spark, tmp_path / "t", lambda s: state.trails(s, 2, 0.5), rows)) == [(1, 0, 8.0), (1, 1, 4.0), (1, 2, 2.0), (1, 3, 1.0)]
    got = sorted(run(spark, tmp_path / "s", lambda s: state.stabilizer(s, 0.5), rows))
    at, smooth, want = 0.0, 0.0, []
    for i, v in enumerate((8, 1, 1, 1)):
        at += v
        smooth = (smooth + at) / 2
        want.append((1, i, at - smooth))
    assert got == want


def test_replay_over_triggers(spark, tmp_path):
    """The state of a decoder outlives the trigger: a failure in the second replays samples of the first."""
    schema = "track_id bigint, sample_idx bigint, pts bigint, key boolean, size bigint, ok boolean"
    rows = [(1, i, i * 10, i % 6 == 0, 5, i not in (4, 9)) for i in range(14)]
    got = run(spark, tmp_path, lambda s: state.replay(s, 2, 9), [rows[:3], rows[3:8], rows[8:]], schema)
    fold = Replay(2, 9)
    want = [p for _, *r in rows for p in fold.feed(*r)]
    assert sorted((s, p) for _, s, p in got) == sorted(want) and fold.stats["replays"] == 2 and len(want) == 10
