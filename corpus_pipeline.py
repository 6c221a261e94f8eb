"""The corpus pipeline: filters, deduplication, decontamination and tokens, stage by stage.

A stage is a function ``(spark, docs, sf_dir) -> DataFrame``. What a stage returns is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents, and rows only ever go:

1. toxicity: documents scored 0.3 and more go;
2. quality: documents scored less than 0.3 go;
3. near copies: of each group (five-word shingles, similarity 0.8) the document with the smallest id stays, once
   (several texts of one id in a group: the one with the smallest digest; rows without an id are a group's last choice);
4. decontamination: documents that contain a window of ten words of a benchmark item go;
5. tokens: ids and digests of what is left.

Documents without a text are scored like empty ones; those without words are in no group and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameweave.llm import decontaminate, nearjoin, q04_toxicity, q06_bpe, q07_quality
from frameweave.llm._io import remove, shared_dir, table

ORACLE_SQL = None


def _beside(docs: DataFrame) -> DataFrame:
    """``docs`` as its id, its text and a struct of all else, so that no column can clash with a new one; ``_back`` takes it
    apart. The text stands there once, since it is what is large."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]
    return docs.select(F.struct(*others).alias("_row"), "doc_id", "text")


def _back(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c).alias(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = q04_toxicity.scored(_beside(docs), table(spark, sf_dir, "labels"))
    return _back(scored.where(F.col("score") < q04_toxicity.THRESHOLD), docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = q07_quality.scored(_beside(docs), table(spark, sf_dir, "labels"))
    return _back(scored.where(F.col("score") >= q07_quality.THRESHOLD), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which rows stay is found with ids and digests; whole rows are dealt out once, by the digest of id and text."""
    mark = F.sha2(F.concat_ws("\0", F.col("doc_id").isNull().cast("string"), F.col("doc_id").cast("string"), "text"), 256)
    found = nearjoin.join(docs.select("doc_id", mark.alias("_mark"), "text"))
    # of each group one text of the smallest id, and of rows with that id and text one
    first = found.where("component is not null").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = first.groupBy("component").agg(F.min(F.struct("doc_id", "_mark")).alias("k")).select(F.col("k._mark").alias("_mark"))
    marked = _beside(docs).withColumn("_mark", mark)
    kept = marked.join(stay, "_mark", "left_semi").dropDuplicates(["_mark"])
    wordless = marked.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return _back(kept.unionByName(wordless), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_beside(docs), table(spark, sf_dir, "benchmark"))
    return _back(found.where(F.size("hit_spans") == 0), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return q06_bpe.digests(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is in the shared folder until the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
