"""Registry of queries over the given tables, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import chunking as C
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_held: list[DataFrame] = []
#: The given documents are numbered from 0 and have far fewer chunks than this each,
#: so their positions show as one number; the operators never need that.
CHUNKS_SHOWN = 1 << 24

#: Chunk size of the retrieval queries.
SIZE = 300


def query(sql: str | None = None):
    """Register a query under its function name, with its oracle if it has one."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release()
            return shown(build(spark, sf_dir))

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def shown(frame: DataFrame) -> DataFrame:
    """``frame`` with positions of the given documents as numbers."""
    if "position" not in frame.columns or not isinstance(frame.schema["position"].dataType, StructType):
        return frame
    number = F.get("position.doc_order", F.lit(0)) * CHUNKS_SHOWN + F.col("position.chunk_index")
    return frame.withColumn("position", number)


def hold(frame: DataFrame) -> DataFrame:
    """Keep a table that several steps of one query read."""
    _held.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
    return frame


def release() -> None:
    """Drop what the previous query kept."""
    while _held:
        _held.pop().unpersist()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir)


def chunks(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    return C.build_index(documents(spark, sf_dir), size)


def mixed_chunks(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    """Chunks of the documents, then of the conversation turns, as one index."""
    raw = tables.spread(tables.table(spark, sf_dir, "conversations"), "conv_id", "turn")
    turns = raw.select(
        F.concat_ws("/", "conv_id", "turn").alias("doc_id"),
        F.array("conv_id", "turn").alias("doc_order"),
        "text",
        F.create_map(F.lit("kind"), F.lit("conversations")).alias("metadata"),
    )
    docs = documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn(
        "metadata", F.create_map(F.lit("kind"), F.lit("documents"))
    )
    return C.union_chunks(C.build_index(docs, size), C.build_index(turns, size))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage asks for its own first sentence."""
    raw = tables.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    first = F.coalesce(F.get("s", F.lit(0))["text"], F.lit(""))
    return C.with_sentences(raw, "query", "s").select("query_id", "query", first.alias("answer"))


def rounded(frame: DataFrame, *names: str) -> DataFrame:
    for name in names:
        frame = frame.withColumn(name, F.round(F.col(name).cast("double"), 6))
    return frame
