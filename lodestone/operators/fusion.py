"""Fusing rankings, hybrid search, reranking.

Rankings are ``(query_id, rank, item, score)`` rows; ``item`` is ``position``
unless named otherwise.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.models import OverlapPairScorer
from .blocks import DECIMALS, top_k
from .chunking import with_ordinals
from .dense import DenseIndex
from .lexical import BM25

METHODS = ("sparse", "dense", "score", "rrf")


def min_max_normalized(ranking: DataFrame) -> DataFrame:
    """``ranking`` with ``score`` rescaled to [0, 1] within each query."""
    whole = W.partitionBy("query_id")
    value = T.min_max(F.col("score"), F.min("score").over(whole), F.max("score").over(whole))
    return ranking.withColumn("score", value)


def score_fusion(
    sparse: DataFrame, dense: DataFrame, alpha: float = 0.5, k: int = 5, item: str = "position"
) -> DataFrame:
    """Weighted sum of rescaled scores; an item missing from a list adds zero.
    Ties keep the order of first appearance, the sparse list first."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must be between 0 and 1, got {alpha}")
    lists = [
        min_max_normalized(ranking).select(
            "query_id", item, (F.col("score") * weight).alias("score"),
            F.lit(place).alias("_list"), F.col("rank").alias("_rank"),
        )
        for place, (ranking, weight) in enumerate(((sparse, 1.0 - alpha), (dense, alpha)))
    ]
    combined = lists[0].unionByName(lists[1]).groupBy("query_id", item).agg(
        F.sum("score").alias("score"), F.min(F.struct("_list", "_rank")).alias("_first")
    )
    order = [F.round("score", DECIMALS).desc(), F.col("_first")]
    return top_k(combined, ["query_id"], order, k).drop("_first")


def reciprocal_rank_fusion(
    rankings, k: int = 5, constant: int = 60, item: str = "position", ordinals=None
) -> DataFrame:
    """Sum of ``1 / (constant + rank)``; ties go by the item read as text.

    ``ordinals`` gives rows an ``ordinal`` that is read instead. Only rows whose
    score another row of the query shares are asked for one.
    """
    if constant < 0:
        raise ValueError(f"constant must not be negative, got {constant}")
    union = reduce(lambda a, b: a.unionByName(b), [r.select("query_id", item, "rank") for r in rankings])
    combined = union.groupBy("query_id", item).agg(
        F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score")
    )
    equal = F.round("score", 15)
    if ordinals is None:
        combined = combined.withColumn("_tie", F.col(item).cast("string"))
    else:
        same = W.partitionBy("query_id", equal)
        combined = combined.withColumn("_tied", F.count(F.lit(1)).over(same) > 1)
        tied = ordinals(combined.where("_tied").select(item).distinct())
        tied = tied.select(F.col(item).alias("_item"), F.col("ordinal").cast("string").alias("_tie"))
        combined = combined.join(tied, F.col(item) == F.col("_item"), "left").drop("_item", "_tied")
    return top_k(combined, ["query_id"], [equal.desc(), F.col("_tie")], k).drop("_tie")


class HybridRetriever:
    """BM25 and dense search over one chunk table, combined either way."""

    def __init__(self, chunks: DataFrame, dense: DenseIndex | None = None, k1=1.5, b=0.75, keep=None):
        self.chunks = chunks
        self.sparse = BM25(chunks, k1=k1, b=b)
        self.dense = dense or DenseIndex(chunks)
        self.keep = keep or (lambda frame: frame.persist(StorageLevel.MEMORY_AND_DISK))
        self._halves: dict = {}

    def half(self, queries: DataFrame, depth: int, method: str) -> DataFrame:
        """One retriever's top ``depth``; kept, since fusions reuse it."""
        key = (id(queries), depth, method)
        if key not in self._halves:
            index = self.sparse if method == "sparse" else self.dense
            found = index.search(queries, depth, payload=("text",))
            # The queries are kept too, so that their id cannot be reused.
            self._halves[key] = (queries, self.keep(found))
        return self._halves[key][1]

    def search(
        self,
        queries: DataFrame,
        k: int = 5,
        method: str = "rrf",
        alpha: float = 0.5,
        depth: int = 20,
        constant: int = 60,
    ) -> DataFrame:
        """``(query_id, rank, position, score, text)``."""
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        if method in ("sparse", "dense"):
            # A prefix of the deeper list the fusions read is the same ranking.
            return self.half(queries, max(k, depth), method).where(F.col("rank") <= k)
        sparse = self.half(queries, depth, "sparse")
        dense = self.half(queries, depth, "dense")
        if method == "score":
            fused = score_fusion(sparse, dense, alpha, k)
        else:
            # Ties follow the digits of a chunk's ordinal in the whole index.
            fused = reciprocal_rank_fusion(
                (sparse, dense), k, constant, ordinals=lambda rows: with_ordinals(rows, self.chunks)
            )
        texts = (
            sparse.select("query_id", "position", "text")
            .unionByName(dense.select("query_id", "position", "text"))
            .dropDuplicates(["query_id", "position"])
        )
        return fused.join(texts, ["query_id", "position"])


class Reranker:
    """Reorders a shortlist by a pair scorer that reads query and text together."""

    def __init__(self, model=None):
        self.model = model or OverlapPairScorer()

    def score(self, pairs: DataFrame) -> DataFrame:
        """Add ``pair_score`` to rows with ``query`` and ``text``; equal pairs in a
        batch are scored once."""
        model = self.model

        @F.pandas_udf("double")
        def predict(queries: pd.Series, texts: pd.Series) -> pd.Series:
            frame = pd.DataFrame({"q": queries, "t": texts})
            distinct = frame.drop_duplicates()
            scores = model.predict(list(distinct.itertuples(index=False, name=None)))
            known = dict(zip(distinct.itertuples(index=False, name=None), scores))
            return pd.Series(
                [float(known[pair]) for pair in frame.itertuples(index=False, name=None)],
                index=queries.index,
            )

        return pairs.withColumn("pair_score", predict("query", "text"))

    def rerank(self, queries: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
        """The best ``k`` candidates per query; ties keep the candidate order."""
        if k < 1:
            raise ValueError(f"k must be at least 1, got {k}")
        pairs = candidates.join(queries.select("query_id", "query"), "query_id")
        scored = self.score(pairs).withColumnRenamed("rank", "_first_stage")
        order = [F.round("pair_score", DECIMALS).desc(), F.col("_first_stage")]
        best = top_k(scored, ["query_id"], order, k)
        return best.withColumn("score", F.col("pair_score")).drop(
            "pair_score", "_first_stage", "query"
        )


def complementarity(retriever: HybridRetriever, questions: DataFrame, k: int = 3) -> DataFrame:
    """How many questions each half answers, and how many only one of them does."""
    parts = [
        judged(retriever.search(questions, k, method), questions)
        .groupBy("query_id")
        .agg((F.max("rel") == 1).alias(method))
        for method in ("sparse", "dense")
    ]
    table = questions.select("query_id")
    for part in parts:
        table = table.join(part, "query_id", "left")
    table = table.fillna(False)
    sparse, dense = F.col("sparse"), F.col("dense")
    return table.agg(
        F.count_if(sparse).alias("sparse"),
        F.count_if(dense).alias("dense"),
        F.count_if(sparse | dense).alias("union"),
        F.count_if(sparse & ~dense).alias("sparse_only"),
        F.count_if(dense & ~sparse).alias("dense_only"),
        F.count(F.lit(1)).alias("total"),
    )


def judged(results: DataFrame, questions: DataFrame) -> DataFrame:
    """``results`` with ``rel``: 1 where the text holds the question's answer."""
    answers = questions.select("query_id", "answer")
    return results.join(answers, "query_id").withColumn(
        "rel", F.contains("text", "answer").cast("int")
    ).drop("answer")
