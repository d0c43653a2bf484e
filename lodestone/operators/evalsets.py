"""Building evaluation sets from documents, and pooling judgements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .fusion import judged

SHORTEST_LINE = 30


def _lines(documents: DataFrame) -> DataFrame:
    rows = documents.select(
        "doc_id", "doc_order", F.posexplode(F.split("text", "\n")).alias("line", "_raw")
    )
    return rows.select("doc_id", "doc_order", "line", T.strip(F.col("_raw")).alias("sentence"))


def _limited(questions: DataFrame, limit: int | None) -> DataFrame:
    if not limit:
        return questions.drop("doc_order")
    return questions.orderBy("doc_order", "line").limit(limit).drop("doc_order")


def known_item_questions(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """``(doc_id, line, query, answer)``: every line of 30 characters or more
    asks for itself."""
    rows = _lines(documents).where(F.length("sentence") >= SHORTEST_LINE)
    return _limited(
        rows.select("doc_id", "doc_order", "line", F.col("sentence").alias("query"),
                    F.col("sentence").alias("answer")),
        limit,
    )


def cloze_questions(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """``(doc_id, line, query, answer)``: a line without its first fact asks for it."""
    rows = _lines(documents).withColumn("answer", F.get(T.facts(F.col("sentence")), F.lit(0)))
    at = F.instr(F.col("sentence"), F.col("answer"))
    query = F.concat(
        F.substring(F.col("sentence"), F.lit(1), at - 1),
        F.lit("____"),
        F.substring(F.col("sentence"), at + F.length("answer"), F.length("sentence")),
    )
    asked = rows.where(F.col("answer").isNotNull())
    return _limited(
        asked.select("doc_id", "doc_order", "line",
                     F.rtrim(query, F.lit(".")).alias("query"), "answer"),
        limit,
    )


def vocabulary_overlap(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """``(query_id, overlap)``: share of a question's words that the first line
    holding its answer also has; NULL when no line of its document does."""
    matched = questions.join(documents.select("doc_id", "text"), "doc_id", "left")
    line = F.get(
        F.filter(F.split("text", "\n"), lambda part: F.contains(part, F.col("answer"))), F.lit(0)
    )
    asked = F.array_distinct(T.tokens(F.col("query")))
    shared = F.size(F.array_intersect(asked, T.tokens(F.col("_line"))))
    share = F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(shared / F.size(asked))
    return matched.withColumn("_line", line).select(
        "query_id", F.when(F.col("_line").isNotNull(), share).alias("overlap")
    )


def vocabulary_overlap_of_set(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Mean overlap over the questions whose answer line exists; 0 for none."""
    return vocabulary_overlap(questions, documents).agg(
        F.coalesce(F.avg("overlap"), F.lit(0.0)).alias("overlap")
    )


def pooled_judgements(rankings: dict[str, DataFrame], depth: int = 5) -> DataFrame:
    """``(query_id, position, text, systems)``: whatever any system ranked within
    ``depth``, with the systems that did."""
    tagged = [
        ranking.where(F.col("rank") <= depth).select(
            "query_id", "position", "text", F.lit(name).alias("system")
        )
        for name, ranking in rankings.items()
    ]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    return union.groupBy("query_id", "position").agg(
        F.first("text").alias("text"), F.array_sort(F.collect_set("system")).alias("systems")
    )


def pool_coverage(pool: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, covered)``: does the pool hold the answer at all?"""
    found = judged(pool, questions).groupBy("query_id").agg((F.max("rel") == 1).alias("covered"))
    return questions.select("query_id").join(found, "query_id", "left").fillna(False)


def exclusion_penalty(
    rankings: dict[str, DataFrame], questions: DataFrame, depth: int = 5, k: int = 3
) -> DataFrame:
    """``(system, by_pool, by_truth, penalty)``: each system judged by a pool built
    without it, and by the truth."""
    total = F.count(F.lit(1))
    rows = []
    for name, ranking in rankings.items():
        others = {other: r for other, r in rankings.items() if other != name}
        pool = judged(pooled_judgements(others, depth), questions).where("rel = 1")
        top = judged(ranking.where(F.col("rank") <= k), questions).where("rel = 1")
        pooled = pool.select("query_id", "position", F.lit(1).alias("pooled"))
        hits = (
            top.join(pooled, ["query_id", "position"], "left")
            .groupBy("query_id")
            .agg(F.max(F.coalesce("pooled", F.lit(0))).alias("pool"), F.lit(1).alias("truth"))
        )
        full = questions.select("query_id").join(hits, "query_id", "left").fillna(0)
        rows.append(
            full.agg(
                F.lit(name).alias("system"),
                (F.sum("pool") / total).alias("by_pool"),
                (F.sum("truth") / total).alias("by_truth"),
                ((F.sum("truth") - F.sum("pool")) / total).alias("penalty"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), rows)
