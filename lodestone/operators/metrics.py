"""Ranking metrics over judged results ``(query_id, rank, rel)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fusion import judged

METRICS = ("hit", "recall", "precision", "mrr", "map", "ndcg")


def _check(k: int) -> None:
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")


def hit_at_k(k: int) -> Column:
    _check(k)
    return F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("rel"))), F.lit(0)).cast("double")


def recall_at_k_judged(k: int, total_relevant: int) -> Column:
    if total_relevant < 0:
        raise ValueError("total_relevant must not be negative")
    if not total_relevant:
        return F.lit(1.0)
    return F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("rel"))), F.lit(0)) / total_relevant


def precision_at_k(k: int) -> Column:
    _check(k)
    return F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("rel"))), F.lit(0)) / k


def first_hit() -> Column:
    """Rank of the first relevant result, NULL if there is none."""
    return F.min(F.when(F.col("rel") == 1, F.col("rank")))


def reciprocal_rank() -> Column:
    return F.coalesce(1.0 / first_hit(), F.lit(0.0))


def dcg_at_k(k: int) -> Column:
    _check(k)
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    return F.coalesce(F.sum(F.when(F.col("rank") <= k, gain)), F.lit(0.0))


def ideal_dcg(k: int, total: Column) -> Column:
    ranks = F.sequence(F.lit(1), F.least(total, F.lit(k)).cast("int"))
    best = F.aggregate(ranks, F.lit(0.0), lambda acc, rank: acc + 1.0 / F.log2(rank + 1))
    return F.when(total >= 1, best).otherwise(0.0)


def average_precision_terms(results: DataFrame) -> DataFrame:
    """Add ``precision_here``: precision at every relevant rank, else zero."""
    so_far = W.partitionBy("query_id").orderBy("rank").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    found = F.sum("rel").over(so_far)
    return results.withColumn(
        "precision_here", F.when(F.col("rel") == 1, found / F.col("rank")).otherwise(0.0)
    )


def per_query(results: DataFrame, k: int, total_relevant: int | None = 1) -> DataFrame:
    """All metrics per query. ``total_relevant=None`` counts what was retrieved."""
    _check(k)
    total = F.lit(total_relevant) if total_relevant is not None else F.sum("rel")
    recall = (
        recall_at_k_judged(k, total_relevant)
        if total_relevant is not None
        else F.coalesce(
            F.try_divide(F.sum(F.when(F.col("rank") <= k, F.col("rel"))), F.sum("rel")), F.lit(1.0)
        )
    )
    table = average_precision_terms(results).groupBy("query_id").agg(
        hit_at_k(k).alias("hit"),
        recall.alias("recall"),
        precision_at_k(k).alias("precision"),
        reciprocal_rank().alias("mrr"),
        F.coalesce(F.try_divide(F.sum("precision_here"), total), F.lit(0.0)).alias("map"),
        dcg_at_k(k).alias("_dcg"),
        total.alias("_total"),
    )
    ideal = ideal_dcg(k, F.col("_total"))
    return table.withColumn(
        "ndcg", F.when(ideal > 0, F.col("_dcg") / ideal).otherwise(0.0)
    ).drop("_dcg", "_total")


def evaluate_all(results: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """Mean of every metric over all questions; those without results score zero."""
    table = per_query(judged(results, questions), k)
    full = questions.select("query_id").join(table, "query_id", "left").fillna(0.0)
    return full.agg(*[F.avg(name).alias(name) for name in METRICS])


def answer_ranks(results: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, answer_rank)``; NULL where the answer never appears."""
    ranks = judged(results, questions).groupBy("query_id").agg(first_hit().alias("answer_rank"))
    return questions.select("query_id").join(ranks, "query_id", "left")


def rank_histogram(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("answer_rank").agg(F.count(F.lit(1)).alias("queries"))


def hit_rate(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Share of questions whose answer is among the results, and mean context."""
    table = judged(results, questions).groupBy("query_id").agg(
        F.max("rel").alias("rel"), F.sum(F.length("text")).alias("context")
    )
    full = questions.select("query_id").join(table, "query_id", "left").fillna(0)
    return full.agg(F.avg("rel").alias("hit"), F.avg("context").alias("context"))


def first_stage_recall(retriever, questions, depth: int, method: str = "sparse", **options):
    """Share of answers anywhere in the first ``depth`` results."""
    found = retriever.search(questions, depth, method=method, **options)
    return hit_rate(found, questions).select("hit")


def evaluate_hybrid(retriever, questions, k: int = 3, **options) -> DataFrame:
    """``(hit,)`` at ``k`` of one way to search; ``options`` are those of ``search``."""
    return hit_rate(retriever.search(questions, k, **options), questions).select("hit")


def evaluate_reranked(retriever, reranker, questions, depth=20, k=3, method="sparse", **options):
    found = retriever.search(questions, depth, method=method, **options)
    return hit_rate(reranker.rerank(questions, found, k), questions).select("hit")


def confidence_interval(successes: Column, total: Column, z: float = 1.96) -> Column:
    """``struct(low, high)`` of the normal approximation, not clipped to [0, 1]."""
    share = successes / total
    spread = F.lit(z) * F.sqrt(share * (1 - share) / total)
    bounds = F.struct((share - spread).alias("low"), (share + spread).alias("high"))
    return F.when(total > 0, bounds).otherwise(F.raise_error(F.lit("total must be positive")))


def resolving_power(scores: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Share of system pairs whose scores differ, from ``(name, score)`` rows.

    Sorted scores make it a window problem: a pair is tied exactly when the
    later score lies within the tolerance of the earlier, so counting each
    row's tied predecessors replaces comparing all pairs.
    """
    near = F.expr(
        "count(1) OVER (ORDER BY score RANGE BETWEEN "
        f"{tolerance!r}D PRECEDING AND CURRENT ROW)"
    )
    tied = scores.select(near.alias("near"), "score")
    alike = W.partitionBy("score")
    counted = tied.select("near", F.count(F.lit(1)).over(alike).alias("same"))
    # Peers with an equal score each count the whole group; halve the double count.
    pairs = F.sum(F.col("near") - F.col("same")) + F.sum((F.col("same") - 1) / 2)
    n = F.count(F.lit(1))
    possible = n * (n - 1) / 2
    return counted.agg(
        F.when(possible > 0, 1 - pairs / possible).otherwise(0.0).alias("resolving_power")
    )


def agreement(first: DataFrame, second: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Pairs of systems two evaluations order alike, oppositely, or not at all.

    Systems are the rows of an experiment, so the pairing is over a handful of
    names; ``rate`` is NaN when no pair is resolved by both.
    """
    both = first.select("name", F.col("score").alias("x")).join(
        second.select("name", F.col("score").alias("y")), "name"
    )
    left = both.select(F.col("name").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    pairs = left.join(both, left["a"] < both["name"])
    dx, dy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    unresolved = (F.abs(dx) <= tolerance) | (F.abs(dy) <= tolerance)
    same = (dx > 0) == (dy > 0)
    agreed, disagreed = F.count_if(~unresolved & same), F.count_if(~unresolved & ~same)
    return pairs.agg(
        agreed.alias("agreed"),
        disagreed.alias("disagreed"),
        F.count_if(unresolved).alias("unresolved"),
        F.when(agreed + disagreed > 0, agreed / (agreed + disagreed))
        .otherwise(F.lit(float("nan")))
        .alias("rate"),
    )
