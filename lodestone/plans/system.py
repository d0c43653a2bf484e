"""The whole loop over one corpus: retrieve, rerank, pack, answer, ground."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answering, metrics
from ..operators.chunking import build_index
from ..operators.dense import DenseIndex
from ..operators.fusion import HybridRetriever, Reranker, judged


class RAGSystem:
    """Questions arrive as a DataFrame and are answered in one plan."""

    def __init__(
        self, documents: DataFrame, chunk_size: int = 80, strategy: str = "sentence",
        embedder=None, pair_scorer=None, generator=None, rerank: bool = True,
        depth: int = 20, context_chunks: int = 3,
    ):
        self.documents = documents
        self.chunks = build_index(documents, chunk_size, strategy).persist(
            StorageLevel.MEMORY_AND_DISK
        )
        self.dense = DenseIndex(self.chunks, embedder)
        self.retriever = HybridRetriever(self.chunks, self.dense)
        self.reranker = Reranker(pair_scorer) if rerank else None
        self.generator = answering.Generator(generator)
        self.depth, self.context_chunks = depth, context_chunks

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Shortlist, rerank, keep what the generator will read."""
        payload = ("doc_id", "chunk_index", "start", "end", "text")
        depth = self.depth if self.reranker else self.context_chunks
        found = self.dense.search(questions, depth, payload=payload)
        if self.reranker:
            found = self.reranker.rerank(questions, found, self.context_chunks)
        return found

    def ask(self, questions: DataFrame) -> DataFrame:
        """Answers with ``abstained``, ``supported``, ``citation`` and ``verified``."""
        context = self.retrieve(questions).persist(StorageLevel.MEMORY_AND_DISK)
        return answering.answer_with_citation(self.generator, context, questions, self.documents)

    def evaluate(self, questions: DataFrame) -> DataFrame:
        """Retrieval and generation quality on one question set."""
        context = self.retrieve(questions).persist(StorageLevel.MEMORY_AND_DISK)
        ranks = judged(context, questions).groupBy("query_id").agg(
            metrics.reciprocal_rank().alias("mrr"),
            metrics.hit_at_k(self.context_chunks).alias("hit"),
        )
        answers = answering.ground(
            answering.answered(self.generator, context, questions), context
        )
        rows = answers.join(ranks, "query_id", "left").fillna(0.0, ["mrr", "hit"])
        right = T.answer_is_correct(F.col("answer_text"), F.col("answer"))
        return rows.agg(
            F.count(F.lit(1)).alias("questions"),
            F.avg("hit").alias("retrieval_hit"),
            F.avg("mrr").alias("retrieval_mrr"),
            F.avg(right.cast("int")).alias("answer_correct"),
            F.avg(F.col("supported").cast("int")).alias("answer_grounded"),
            F.avg(F.col("abstained").cast("int")).alias("abstained"),
        )

    def describe(self) -> DataFrame:
        """What is in the index."""
        size = F.length("text")
        limit = self.dense.token_limit
        tokens = F.size(T.tokens(F.col("text")))
        return self.chunks.agg(
            F.count_distinct("doc_id").alias("documents"),
            F.count(F.lit(1)).alias("chunks"),
            F.min(size).alias("shortest"),
            F.max(size).alias("longest"),
            F.avg(size).alias("mean"),
            (F.count(F.lit(1)) * self.dense.dimension * 8).alias("dense_bytes"),
            F.count_if(tokens > limit).alias("past_token_limit"),
        )
