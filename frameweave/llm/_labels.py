"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import stash, unstash


def in_fold(mod: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == remainder, F.lit(False))


#: Bytes of text that a sample has of either class at most.
SAMPLE_BYTES = 48 << 20


def smallest_hashes(rows: DataFrame, hashed: Column, of_all: int, most: int) -> DataFrame:
    """Those ``rows`` (``of_all`` of them) that the ``most`` with the smallest 64-bit hashes are among: half as many again
    are expected, however many partitions there are, so that few rows go to whoever sorts them."""
    share = (1.5 * most + 100) / max(1, of_all)
    return rows if share >= 1 else rows.where(hashed < int(-(2**63) + share * 2**64))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, most_bytes: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``per_class`` (text, label) pairs of either class, and how many labels either class has in all.

    The bound: ``per_class`` rows of ``most_bytes`` at most and ``SAMPLE_BYTES`` in all, of either class; longer texts are
    left out of the fit (not of the scoring). Rows are taken in the order of a hash of their key, so the sample doesn't
    depend on partitions. Labels other than 0 and 1, and keys that are null, are left out; of a key with several labels
    or texts the smallest counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(train & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    totals = {int(y): int(n) for y, n in known.groupBy("y").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked: dict = {}
    for y, n in totals.items():
        near = smallest_hashes(known.where(F.col("y") == y), order[0], n, per_class)
        picked |= {key: y for key, _ in near.orderBy(*order).limit(per_class).collect()}
    if not picked:
        return [], totals
    spark = docs.sparkSession
    # 2 * per_class rows of a key and a label: small enough to be sent everywhere
    few = spark.createDataFrame(list(picked.items()), f"doc_id {known.schema['doc_id'].dataType.simpleString()}, y int")
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= most_bytes).join(F.broadcast(few), "doc_id")
    texts = stash(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
    held, left = {0: 0, 1: 0}, []
    for key, y, n in texts.select("doc_id", "y", F.octet_length("text")).orderBy(*order).collect():
        held[y] += n
        if held[y] <= SAMPLE_BYTES:
            left.append(key)
    rows = texts.where(F.col("doc_id").isin(left)).orderBy("doc_id").collect() if len(left) < len(picked) else texts.orderBy("doc_id").collect()
    unstash(texts)
    return [(r["text"], r["y"]) for r in rows], totals


def class_weights(ys: list[int], totals: dict[int, int]) -> dict[int, float]:
    """Weights that give the classes of a sample the shares that they have among all labels."""
    n = {y: max(1, ys.count(y)) for y in (0, 1)}
    all_labels = max(1, sum(totals.values()))
    return {y: totals.get(y, 0) / all_labels * max(1, len(ys)) / n[y] for y in (0, 1)}
