"""Shared plumbing of the training-data operators: tables, the shared folder, chunking of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder, read by Spark (any scheme that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of one's own is made if all runs in this one process (master ``local``); on a cluster each
    executor would write to its own disk and rows would be lost, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="frameweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of a table that a task writes at least, where the number of rows is known beforehand.
ROWS_A_TASK = 20_000


def stash(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and return the written table.

    Unlike ``localCheckpoint`` the copy outlives the executors that made it. ``unstash`` removes it. ``rows``: about how many
    there are; a small table is written by as few tasks as they need, a large one by as many as there are shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if rows is not None:
        tasks = max(8, -(-rows // ROWS_A_TASK))
        df = df.coalesce(tasks) if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is; one that is gone already is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unstash(*written: DataFrame) -> None:
    """Delete the tables that ``stash`` wrote, once all that was made from them is written itself."""
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


#: Bytes of an Arrow batch that goes to a Python worker, where the session says nothing else.
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have ``ARROW_BYTES`` instead of the usual 64 MB, so that neither side of a worker's pipe holds
    much; a session that sets the limit itself keeps its own. The limit is read when a query runs, so it stays set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(ARROW_BYTES))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of every value; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds ``most`` bytes of ``column`` at most, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def trim() -> None:
    """Hand memory that is free in this process back to the system; where the C library can't do it, nothing happens."""
    import ctypes

    pa.default_memory_pool().release_unused()
    of_system = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if of_system is not None:
        of_system(0)


def give_back() -> None:
    """``trim`` after what lies in circles is collected. Workers are kept for other tasks, and a heap that once was large stays
    so."""
    import gc

    gc.collect()
    trim()


def scored_by(df: DataFrame, run: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], text: str, into: str) -> DataFrame:
    """``df`` with the double column ``into`` (the last one, in place of any of that name) that ``run`` makes of the texts.

    The other columns wait beside the worker and are not sent to it. A filter on the column must not be pushed below, which
    would compute it twice: so the function counts as one that isn't deterministic.
    """
    from pyspark.sql import functions as F

    made = F.arrow_udf(run, "double").asNondeterministic()(F.col(f"`{text}`"))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != into), made.alias(into))
