"""Streams of frames with state by clip: a bounded reorder buffer that drops repeats, a running mean, trails, a stabilizer, and
decoding with replay after failures.

All are ``transformWithState`` processors: state is kept by key, written to the checkpoint and found again after a failure.
Rows: ``clip_id``, ``pts`` (bigint), ``value`` (double); samples as ``operators.samples`` has them. Within a trigger a clip's rows are
taken in the order of their time (samples: of decoding); the reorder buffer alone takes them as they come.
"""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.samples import Replay

FRAME = "clip_id bigint, pts bigint, value double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reorder(StatefulProcessor):
    """Emits the smallest time once more than ``window`` frames wait; times that were emitted or repeat are dropped."""

    def __init__(self, window: int = 4) -> None:
        self.window = max(2, window)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "pts bigint", "value double")
        self.last = handle.getValueState("last", "pts bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        held = {k[0]: v[0] for k, v in self.waiting.iterator()}
        out = []
        for batch in rows:
            for pts, value in zip(batch["pts"].tolist(), batch["value"].tolist(), strict=True):
                if pts in held or (last is not None and pts <= last):
                    continue
                held[pts] = value
                self.waiting.updateValue((pts,), (value,))
                if len(held) > self.window:
                    last = min(held)
                    out.append((key[0], last, held.pop(last)))
                    self.waiting.removeKey((last,))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["clip_id", "pts", "value"]).astype({"clip_id": "int64", "pts": "int64", "value": "float64"})

    def close(self) -> None:
        pass


class RunningMean(StatefulProcessor):
    """Exponential mean of a clip's values in order of arrival."""

    def __init__(self, weight: float = 0.35) -> None:
        self.weight = weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mean = handle.getValueState("mean", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mean = self.mean.get()[0] if self.mean.exists() else None
        out = []
        for pts, value in sorted(p for batch in rows for p in zip(batch["pts"].tolist(), batch["value"].tolist(), strict=True)):
            mean = value if mean is None else mean + (value - mean) * self.weight
            out.append((key[0], pts, mean))
        if mean is not None:
            self.mean.update((float(mean),))
        yield pd.DataFrame(out, columns=["clip_id", "pts", "value"]).astype({"clip_id": "int64", "pts": "int64", "value": "float64"})

    def close(self) -> None:
        pass


class Trails(StatefulProcessor):
    """The decayed maximum of a clip's last values: state is as many values as the trail is long."""

    def __init__(self, frames: int = 3, decay: float = 0.5) -> None:
        self.frames, self.decay = frames, decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "past array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = list(self.past.get()[0]) if self.past.exists() else []
        out = []
        for pts, value in sorted(p for batch in rows for p in zip(batch["pts"].tolist(), batch["value"].tolist(), strict=True)):
            out.append((key[0], pts, max(value, *(v * self.decay ** (k + 1) for k, v in enumerate(past)), value)))
            past = [value, *past][: self.frames]
        self.past.update(([float(v) for v in past],))
        yield pd.DataFrame(out, columns=["clip_id", "pts", "value"]).astype({"clip_id": "int64", "pts": "int64", "value": "float64"})

    def close(self) -> None:
        pass


class Stabilizer(StatefulProcessor):
    """How far each frame is to be shifted: the sum of the motions so far less its smoothed run. State: both numbers."""

    def __init__(self, weight: float = 0.65) -> None:
        self.weight = weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.path = handle.getValueState("path", "at double, smooth double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, smooth = (float(v) for v in self.path.get()) if self.path.exists() else (0.0, 0.0)
        out = []
        for pts, moved in sorted(p for batch in rows for p in zip(batch["pts"].tolist(), batch["value"].tolist(), strict=True)):
            at += moved
            smooth = smooth * self.weight + at * (1 - self.weight)
            out.append((key[0], pts, at - smooth))
        self.path.update((at, smooth))
        yield pd.DataFrame(out, columns=["clip_id", "pts", "value"]).astype({"clip_id": "int64", "pts": "int64", "value": "float64"})

    def close(self) -> None:
        pass


class ReplayState(StatefulProcessor):
    """``operators.samples.Replay`` over a stream: the samples since the last key frame, and what waits for its turn, are the state."""

    def __init__(self, window: int = 4, most_replays: int = 4) -> None:
        self.window, self.most_replays = window, most_replays

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("replay", "replay binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(bytes(self.held.get()[0])) if self.held.exists() else Replay(self.window, self.most_replays)
        names = ["sample_idx", "pts", "key", "size", "ok"]
        samples = sorted(x for batch in rows for x in zip(*(batch[n].tolist() for n in names), strict=True))
        out = [(key[0], s, p) for x in samples for s, p in fold.feed(*x)]
        self.held.update((pickle.dumps(fold),))
        yield pd.DataFrame(out, columns=["track_id", "sample_idx", "pts"]).astype("int64")

    def close(self) -> None:
        pass


def replay(stream: DataFrame, window: int = 4, most_replays: int = 4) -> DataFrame:
    """Pictures of a stream of samples (``track_id``, ``sample_idx``, ``pts``, ``key``, ``size``, ``ok``) as a decoder delivers them."""
    return stream.groupBy("track_id").transformWithStateInPandas(ReplayState(window, most_replays), "track_id bigint, sample_idx bigint, pts bigint", "Append", "None")


def trails(stream: DataFrame, frames: int = 3, decay: float = 0.5) -> DataFrame:
    return stream.groupBy("clip_id").transformWithStateInPandas(Trails(frames, decay), FRAME, "Append", "None")


def stabilizer(stream: DataFrame, weight: float = 0.65) -> DataFrame:
    return stream.groupBy("clip_id").transformWithStateInPandas(Stabilizer(weight), FRAME, "Append", "None")


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, one of this machine's if all runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="frameweave-")
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame) -> DataFrame:
    """All that a stream has now, run to its end with its state in a checkpoint, as a written table."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    at = folder(spark)
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def reorder(stream: DataFrame, window: int = 4) -> DataFrame:
    return stream.groupBy("clip_id").transformWithStateInPandas(Reorder(window), FRAME, "Append", "None")


def running_mean(stream: DataFrame, weight: float = 0.35) -> DataFrame:
    return stream.groupBy("clip_id").transformWithStateInPandas(RunningMean(weight), FRAME, "Append", "None")
