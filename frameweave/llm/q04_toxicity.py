"""Query op4: the toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from ._io import table
from ._labels import in_fold

#: A document is toxic from this score on.
THRESHOLD = 0.3


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    lexicon = toxicity.fit(docs, labels, ~in_fold(4, 2))
    return toxicity.score(docs, lexicon)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", in_fold(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op4_toxicity": op4_toxicity}
