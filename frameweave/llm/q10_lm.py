"""Query op10: the log probability of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm
from ._io import table
from ._labels import in_fold


def scored(docs: DataFrame) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10, F.lit(1))
    counted = lm.counted(docs, fold)
    out = lm.score(counted, lm.learn(counted), docs.schema["doc_id"].dataType).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", in_fold(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm": op10_lm}
