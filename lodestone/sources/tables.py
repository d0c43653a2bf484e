"""Readers for the given parquet tables, shaped for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A scan below this many bytes per core has fewer splits than cores.
SPLIT_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Give a small input one partition per core; large inputs stay as read.

    A file with one row group is read by one task however many splits it has.
    """
    if not hasattr(frame, "_jdf"):
        return frame
    cores = frame.sparkSession.sparkContext.defaultParallelism
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) >= cores * SPLIT_BYTES:
        return frame
    return frame.repartition(cores, *keys)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, doc_order, text, title, uri, metadata)`` of the documents table."""
    raw = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(raw, "doc_id").select(
        "doc_id",
        F.col("doc_id").alias("doc_order"),
        "text",
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("uri"),
        F.create_map(
            F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")
        ).alias("metadata"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vector, label)`` of the embeddings table."""
    raw = table(spark, sf_dir, "embeddings")
    return spread(raw, "vec_id").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )
