"""Dense retrieval: exact cosine search over vector tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.models import HashingEmbedder
from .blocks import Keep, select_best, top_k

KINDS = {"float": 4, "double": 8}


def matrix_of(column) -> np.ndarray:
    """A list column as a dense matrix, without copying row by row."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    rows = len(values)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


class CosineKernel:
    columns = ("vector",)

    def prepare(self, block: pa.Table) -> np.ndarray:
        asked = matrix_of(block.column("vector"))
        sizes = np.linalg.norm(asked, axis=1, keepdims=True)
        return (asked / np.maximum(sizes, V.TINY)).T

    def load(self, batch: pa.Table) -> np.ndarray:
        return matrix_of(batch.column("vector"))

    def score(self, state: np.ndarray, loaded: np.ndarray) -> np.ndarray:
        return loaded @ state


class EncodingKernel:
    """Cosine scores of texts encoded where they lie, each once."""

    columns = ("text",)

    def __init__(self, embedder):
        self.embedder = embedder

    prepare = CosineKernel.prepare

    def load(self, batch: pa.Table) -> np.ndarray:
        return unit_rows(self.embedder.encode(batch.column("text").to_pylist()))

    score = CosineKernel.score


def unit_rows(vectors) -> np.ndarray:
    vectors = np.asarray(vectors, dtype=float)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), V.TINY)


class VectorStore:
    """Exact nearest neighbours over ``(id, vector)`` rows, normalized on entry."""

    def __init__(self, dimension: int, kind: str = "float", rows: DataFrame | None = None):
        if dimension < 1:
            raise ValueError(f"dimension must be positive, got {dimension}")
        if kind not in KINDS:
            raise ValueError(f"unknown number kind {kind!r}")
        self.dimension, self.kind, self.rows = dimension, kind, rows

    def add(self, frame: DataFrame, *keep: str) -> "VectorStore":
        """A store that also holds ``frame``; rows of another dimension fail."""
        size = F.size("vector")
        checked = F.when(size == self.dimension, V.unit(F.col("vector"), self.kind)).otherwise(
            F.raise_error(
                F.concat(F.lit(f"expected dimension {self.dimension}, got "), size.cast("string"))
            )
        )
        added = frame.select("id", checked.alias("vector"), *keep)
        rows = added if self.rows is None else self.rows.unionByName(added)
        return VectorStore(self.dimension, self.kind, rows)

    def count(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def memory_bytes(self) -> DataFrame:
        width = KINDS[self.kind]
        return self.rows.agg((F.coalesce(F.sum(F.size("vector")), F.lit(0)) * width).alias("bytes"))

    def search(self, queries: DataFrame, k: int = 5, payload=(), **options) -> DataFrame:
        """``(query_id, rank, id, score)`` for ``(query_id, vector)`` queries."""
        return select_best(
            self.rows, queries.select("query_id", "vector"), CosineKernel(), Keep(k=k),
            order=("id",), payload=tuple(payload),
            query_size=F.size("vector") * 8 + 16, **options,
        )

    search_batch = search

    def search_naive(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The same answers from a term-by-term join: every coordinate becomes a
        row. It exists to check ``search`` on small data."""
        mine = self.rows.select("id", F.posexplode("vector").alias("axis", "x"))
        asked = queries.select("query_id", V.unit(F.col("vector"), "double").alias("vector"))
        theirs = asked.select("query_id", F.posexplode("vector").alias("axis", "y"))
        scored = (
            mine.join(theirs, "axis")
            .groupBy("query_id", "id")
            .agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("score"))
        )
        return top_k(scored, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k)


def random_vectors(
    spark: SparkSession, count: int, dimension: int = 384, seed: int = 0, kind: str = "float"
) -> DataFrame:
    """Gaussian vectors; each coordinate has its own seed."""
    values = [F.randn(seed * dimension + axis).cast(kind) for axis in range(dimension)]
    return spark.range(count).select("id", F.array(*values).alias("vector"))


def random_store(spark, count, dimension=384, seed=0, kind="float") -> VectorStore:
    return VectorStore(dimension, kind).add(random_vectors(spark, count, dimension, seed, kind))


def encode(text: Column, embedder) -> Column:
    """Unit vectors of a text column; equal texts in a batch are encoded once."""

    @F.pandas_udf("array<double>")
    def apply(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts)
        vectors = unit_rows(embedder.encode(list(distinct)))
        return pd.Series(list(vectors[codes]), index=texts.index)

    return apply(text)


def token_count(text: Column, model) -> Column:
    @F.pandas_udf("int")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(model.count_tokens(list(texts)), index=texts.index)

    return apply(text)


class DenseIndex:
    """Cosine search over the embeddings of a chunk table.

    A chunk table that already has a ``vector`` column (see ``vectors``) is
    searched as it is; other chunks are encoded in the task that scores them.
    """

    def __init__(self, chunks: DataFrame, embedder=None):
        self.embedder = embedder or HashingEmbedder()
        self.chunks = chunks
        self.items = chunks.withColumn("size", F.length("text"))
        stored = "vector" in chunks.columns
        self.kernel = CosineKernel() if stored else EncodingKernel(self.embedder)

    def vectors(self) -> DataFrame:
        """The chunk table with unit vectors, ready to be written and reused."""
        return self.chunks.withColumn("vector", encode(F.col("text"), self.embedder))

    @property
    def dimension(self) -> int:
        return self.embedder.dimension

    @property
    def token_limit(self) -> int:
        return self.embedder.token_limit

    def token_counts(self) -> DataFrame:
        return self.chunks.select(
            "position", token_count(F.col("text"), self.embedder).alias("tokens")
        )

    def truncated_chunks(self) -> DataFrame:
        """Chunks the embedder cannot see the end of."""
        return self.token_counts().where(F.col("tokens") > self.token_limit)

    def _select(self, queries, keep, payload, **options):
        asked = queries.select("query_id", encode(F.col("query"), self.embedder).alias("vector"))
        return select_best(
            self.items, asked, self.kernel, keep, payload=tuple(payload),
            query_size=F.lit(self.dimension * 8 + 16), **options,
        )

    def search(self, queries: DataFrame, k: int = 3, payload=(), **options) -> DataFrame:
        return self._select(queries, Keep(k=k), payload, **options)

    def search_within_budget(self, queries, budget: int = 600, payload=(), **options) -> DataFrame:
        return self._select(queries, Keep(budget=budget), payload, **options)


# --- scaling reports -------------------------------------------------------


def recall_at_k(approximate: DataFrame, exact: DataFrame, k: int, item: str = "id") -> DataFrame:
    """``(query_id, recall)``: share of the true top ``k`` that was found."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    truth = exact.where(F.col("rank") <= k).select("query_id", item)
    found = approximate.where(F.col("rank") <= k).select("query_id", item, F.lit(1).alias("_found"))
    return (
        truth.join(found, ["query_id", item], "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("_found", F.lit(0))).alias("recall"))
    )


def extrapolate(rows: DataFrame, count: int, dimension: int = 384, width: int = 4) -> DataFrame:
    """Latency and memory at ``count`` vectors, linear from the largest measured size."""
    per_vector = F.max_by(F.col("ms") / F.col("count"), F.col("count"))
    return rows.agg(
        F.lit(count).alias("count"),
        (per_vector * count).alias("ms"),
        F.lit(count * dimension * width / 1e9).alias("gigabytes"),
    )


def scaling_exponent(rows: DataFrame) -> DataFrame:
    """Slope of ln(latency) over ln(count)."""
    return rows.agg(F.regr_slope(F.ln("ms"), F.ln("count")).alias("slope"))


def time_search(store: VectorStore, queries: DataFrame, k: int = 5, repeats: int = 5) -> float:
    """Milliseconds per query of whole batches, after a warm-up."""
    import time

    asked = queries.count()
    store.search(queries, k).count()
    begun = time.perf_counter()
    for _ in range(repeats):
        store.search(queries, k).count()
    return (time.perf_counter() - begun) / (repeats * asked) * 1000


def scaling_table(
    spark: SparkSession, sizes, dimension: int = 384, queries: int = 8, seed: int = 0
) -> DataFrame:
    """``(count, ms, megabytes)`` of exact search over growing collections."""
    probes = random_vectors(spark, queries, dimension, seed + 1).withColumnRenamed("id", "query_id")
    rows = []
    for size in sizes:
        store = random_store(spark, size, dimension, seed)
        rows.append((size, time_search(store, probes, repeats=3), size * dimension * 4 / 1e6))
    return spark.createDataFrame(rows, "count bigint, ms double, megabytes double")
