"""Query op7: the quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from ._io import table
from ._labels import in_fold

#: A document is good from this score on.
THRESHOLD = 0.3


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality.score(docs, quality.fit(docs, labels, ~in_fold(5, 0)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", in_fold(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op7_quality": op7_quality}
