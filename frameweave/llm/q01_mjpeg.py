"""Query op1: documents as AVI motion-JPEG files and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mjpeg
from ._io import table


def digests(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back; what remains are counts, digests and a line on the shots."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    stored = mjpeg.store(sized).select("doc_id", "n_bytes", "media")
    sealed = stored.select("*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    frames = F.aggregate("clips", F.lit(0), lambda a, c: a + c["frames"])
    luma = F.aggregate("clips", F.lit(0.0), lambda a, c: a + c["mean_luma"] * c["frames"]) / frames
    cuts = F.array_join(F.transform("clips", lambda c: c["first_frame"].cast("string")), ",")
    return mjpeg.read_back(sealed).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.format_string("frames=%d shots=%d luma=%.3f at=%s", frames, F.size("clips"), luma, cuts).alias("feature"),
    )


def op1_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mjpeg": op1_mjpeg}
