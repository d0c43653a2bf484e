"""Appending to an index as rows arrive.

Chunking and normalizing vectors are stateless, so the batch operators apply to
a stream unchanged; only the append itself is a streaming sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.chunking import build_index
from ..operators.dense import VectorStore


def append_chunks(documents: DataFrame, path: str, checkpoint: str, size: int, strategy="sentence"):
    """Writer of a streaming document source into a parquet chunk table."""
    chunks = build_index(documents, size, strategy)
    return _parquet(chunks, path, checkpoint)


def append_vectors(rows: DataFrame, path: str, checkpoint: str, dimension: int):
    """Writer of a streaming ``(id, vector)`` source into a parquet vector table."""
    return _parquet(VectorStore(dimension).add(rows).rows, path, checkpoint)


def _parquet(frame: DataFrame, path: str, checkpoint: str):
    return frame.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint
    ).option("path", path)
