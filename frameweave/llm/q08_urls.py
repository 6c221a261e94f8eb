"""Query op8: a verdict on the URL of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import urls
from ._io import table

RULES: list[urls.Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def verdicts(pages: DataFrame) -> DataFrame:
    """Rules first; the URLs that a rule judges are the labelled ones from which the trees learn to judge the others."""
    ruled = pages.select("page_id", "url", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    ruled = ruled.withColumn("fit", urls.rule(F.col("host"), F.col("path"), RULES))
    labelled = ruled.where("fit is not null").select("url", (F.col("fit.verdict") == "block").cast("int").alias("block"))
    judged = urls.judge(ruled, urls.fit(labelled))
    own = F.when(F.col("blocked") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "blocked")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"))


QUERIES = {"op8_urls": op8_urls}
