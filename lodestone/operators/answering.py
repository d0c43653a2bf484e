"""Packing context, generating, grounding answers, and probing faithfulness.

Contexts are ``(query_id, rank, doc_id, position, text, start, end)`` rows; a
query's context is the few chunks retrieval kept, so collecting it per query is
bounded by ``k``.
"""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.models import ExtractiveGenerator
from .citations import cite, verify
from .fusion import judged

ORDERS = ("relevance", "reversed", "edges")
SEPARATOR = "\n\n"
CELLS = (
    "grounded_correct", "grounded_wrong", "ungrounded_correct", "ungrounded_wrong", "abstained",
)
OUTCOMES = ("abstained_without", "changed_without", "unchanged_without", "no_support")


def _place(order: str) -> Column:
    """Sort key that puts ranks in packing order."""
    rank = F.col("rank")
    if order == "relevance":
        return rank
    if order == "reversed":
        return -rank
    if order == "edges":
        # Odd ranks ascend from the front, even ranks follow in descending order.
        return F.when(rank % 2 == 1, rank).otherwise(F.lit(2**30) - rank)
    raise ValueError(f"unknown order {order!r}")


def pack(context: DataFrame, order: str = "relevance", separator: str = SEPARATOR) -> DataFrame:
    """``(query_id, context)``: the chunk texts of a query joined in ``order``."""
    entry = F.struct(_place(order).cast("bigint").alias("place"), F.col("text"))
    gathered = context.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_parts"))
    return gathered.select(
        "query_id",
        F.array_join(F.transform("_parts", lambda part: part["text"]), separator).alias("context"),
    )


def pack_with_answer_at(
    context: DataFrame, gold: DataFrame, position: int, separator: str = SEPARATOR
) -> DataFrame:
    """``(query_id, context)`` with the gold chunk at ``position``, clamped to the
    context; ``gold`` is ``(query_id, position, text)``."""
    marked = context.join(
        gold.select("query_id", F.col("position").alias("_gold")), "query_id", "left"
    )
    others = (
        marked.where(~F.col("position").eqNullSafe(F.col("_gold")))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_parts"))
    )
    joined = gold.select("query_id", F.col("text").alias("_answer")).join(others, "query_id", "left")
    empty = F.array().cast("array<string>")
    texts = F.coalesce(F.transform("_parts", lambda part: part["text"]), empty)
    at = F.greatest(F.lit(0), F.least(F.lit(position), F.size(texts)))
    return joined.select(
        "query_id",
        F.array_join(F.array_insert(texts, at + 1, F.col("_answer")), separator).alias("context"),
    )


def pool_with_gold(context: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """The top ``k`` with the gold chunk forced in: if it is missing, it takes the
    last place."""
    top = context.where(F.col("rank") <= k)
    present = top.join(gold.select("query_id", "position"), ["query_id", "position"], "left_semi")
    missing = gold.join(present.select("query_id").distinct(), "query_id", "left_anti")
    kept = top.join(missing.select("query_id", F.lit(1).alias("_forced")), "query_id", "left").where(
        F.col("_forced").isNull() | (F.col("rank") < k)
    )
    forced = missing.select("query_id", F.lit(k).alias("rank"), "position", "text")
    return kept.select("query_id", "rank", "position", "text").unionByName(forced)


class Generator:
    """Applies a generator model to ``(question, context)`` columns."""

    def __init__(self, model=None):
        self.model = model or ExtractiveGenerator()

    @property
    def max_input_tokens(self) -> int:
        return self.model.max_input_tokens

    def answer(self, question: Column, context: Column) -> Column:
        model = self.model

        @F.pandas_udf("string")
        def generate(questions: pd.Series, contexts: pd.Series) -> pd.Series:
            pairs = list(zip(questions, contexts))
            distinct = list(dict.fromkeys(pairs))
            known = dict(zip(distinct, model.generate(distinct)))
            return pd.Series([known[pair] for pair in pairs], index=questions.index)

        return generate(question, context)

    def prompt_tokens(self, question: Column, context: Column) -> Column:
        model = self.model

        @F.pandas_udf("int")
        def count(prompts: pd.Series) -> pd.Series:
            return pd.Series(model.count_tokens(list(prompts)), index=prompts.index)

        return count(T.prompt(question, context))


def answered(
    generator: Generator, context: DataFrame, questions: DataFrame, order: str = "relevance"
) -> DataFrame:
    """``questions`` with ``context`` and ``answer``."""
    packed = questions.join(pack(context, order), "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )
    return packed.withColumn("answer_text", generator.answer(F.col("query"), F.col("context")))


def answer_questions(generator, context, questions, order: str = "relevance") -> DataFrame:
    """Correct and abstained shares, mean and largest prompt."""
    table = answered(generator, context, questions, order).withColumn(
        "tokens", generator.prompt_tokens(F.col("query"), F.col("context"))
    )
    return table.agg(
        F.avg(T.answer_is_correct(F.col("answer_text"), F.col("answer")).cast("int")).alias("correct"),
        F.avg(T.abstained(F.col("answer_text")).cast("int")).alias("abstained"),
        F.avg("tokens").alias("mean_tokens"),
        F.max("tokens").alias("max_tokens"),
    )


def supporting_chunks(answers: DataFrame, context: DataFrame) -> DataFrame:
    """``(query_id, support)``: the first context chunk, in rank order, whose
    normalized text holds the normalized answer."""
    target = answers.select("query_id", T.normalize_answer(F.col("answer_text")).alias("_target"))
    matched = context.join(target, "query_id").where(
        (F.col("_target") != "") & F.contains(T.normalize_answer(F.col("text")), F.col("_target"))
    )
    fields = [c for c in ("doc_id", "position", "chunk_index", "start", "end", "text") if c in context.columns]
    return matched.groupBy("query_id").agg(F.min_by(F.struct(*fields), "rank").alias("support"))


def ground(answers: DataFrame, context: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``answers`` with ``abstained``, ``supported``, ``support`` and ``citation``."""
    declined = T.abstained(F.col("answer_text"))
    claims = answers.where(~declined)
    joined = answers.join(supporting_chunks(claims, context), "query_id", "left")
    grounded = joined.withColumn("abstained", declined).withColumn(
        "supported", F.col("support").isNotNull()
    )
    if documents is None:
        return grounded
    cited = grounded.where("supported").select("query_id", "support.*")
    links = cite(cited, documents).select("query_id", "citation")
    checks = verify(cited, documents).select("query_id", "verified")
    return grounded.join(links, "query_id", "left").join(checks, "query_id", "left")


def answer_with_citation(generator, context, questions, documents) -> DataFrame:
    return ground(answered(generator, context, questions), context, documents)


def grounding_report(generator, context, questions, documents) -> DataFrame:
    """Correctness crossed with groundedness; abstention is tested first."""
    rows = answer_with_citation(generator, context, questions, documents)
    correct = T.answer_is_correct(F.col("answer_text"), F.col("answer"))
    cell = F.when(F.col("abstained"), "abstained").otherwise(
        F.concat(
            F.when(F.col("supported"), "grounded_").otherwise("ungrounded_"),
            F.when(correct, "correct").otherwise("wrong"),
        )
    )
    total = F.count(F.lit(1))
    return rows.withColumn("cell", cell).agg(
        *[(F.count_if(F.col("cell") == name) / total).alias(name) for name in CELLS],
        F.count_if(F.coalesce("verified", F.lit(False))).alias("citations_verified"),
        total.alias("total"),
    )


def remove_supporting_chunk(context: DataFrame, support: DataFrame) -> DataFrame:
    """The context without each query's supporting chunk, and only that one."""
    removed = support.select("query_id", F.col("support.position").alias("position"))
    return context.join(removed, ["query_id", "position"], "left_anti")


def counterfactual_outcomes(generator, context, questions) -> DataFrame:
    """Per question: what happens to the answer once its evidence is gone."""
    first = answered(generator, context, questions).persist(StorageLevel.MEMORY_AND_DISK)
    claims = first.where(~T.abstained(F.col("answer_text")))
    support = supporting_chunks(claims, context)
    probed = claims.join(support.select("query_id"), "query_id", "left_semi")
    rest = remove_supporting_chunk(context, support)
    again = answered(generator, rest, probed.select("query_id", "query")).select(
        "query_id", F.col("answer_text").alias("without")
    )
    joined = first.join(again, "query_id", "left")
    same = T.normalize_answer(F.col("without")) == T.normalize_answer(F.col("answer_text"))
    outcome = (
        F.when(F.col("without").isNull(), "no_support")
        .when(T.abstained(F.col("without")), "abstained_without")
        .when(same, "unchanged_without")
        .otherwise("changed_without")
    )
    return joined.withColumn("outcome", outcome)


def counterfactual_faithfulness(generator, context, questions) -> DataFrame:
    rows = counterfactual_outcomes(generator, context, questions)
    total = F.count(F.lit(1))
    right = T.answer_is_correct(F.col("answer_text"), F.col("answer"))
    return rows.agg(
        *[(F.count_if(F.col("outcome") == name) / total).alias(name) for name in OUTCOMES],
        F.count_if((F.col("outcome") == "unchanged_without") & right).alias("recited_and_correct"),
        total.alias("total"),
    )


def poisoned_verdicts(generator, context, contradictions) -> DataFrame:
    """Per contradiction ``(query_id, query, false_sentence, false_answer)``: which
    source wins when a false sentence leads the context."""
    poison = contradictions.select(
        "query_id", F.lit(0).alias("rank"), F.col("false_sentence").alias("text")
    )
    mixed = context.join(contradictions.select("query_id"), "query_id", "left_semi").select(
        "query_id", "rank", "text"
    ).unionByName(poison)
    rows = answered(generator, mixed, contradictions)
    followed = T.answer_is_correct(F.col("answer_text"), F.col("false_answer"))
    verdict = (
        F.when(followed, "followed the context")
        .when(T.abstained(F.col("answer_text")), "abstained")
        .otherwise("kept the true fact")
    )
    return rows.withColumn("verdict", verdict)


def poisoning_report(generator, context, contradictions) -> DataFrame:
    total = F.count(F.lit(1))

    def share(name):
        return F.count_if(F.col("verdict") == name) / total

    return poisoned_verdicts(generator, context, contradictions).agg(
        share("followed the context").alias("followed"),
        share("kept the true fact").alias("overruled"),
        share("abstained").alias("other"),
    )


def abstention_report(generator, context, questions, unanswerable) -> DataFrame:
    """Abstaining where the context has the answer, and answering where nothing
    could. ``context`` covers both sets of queries."""
    holding = judged(context, questions).groupBy("query_id").agg(F.max("rel").alias("rel"))
    able = questions.join(holding.where("rel = 1").select("query_id"), "query_id", "left_semi")
    one = answered(generator, context, able).select(
        F.lit("able").alias("kind"), T.abstained(F.col("answer_text")).alias("declined")
    )
    other = answered(generator, context, unanswerable).select(
        F.lit("unable").alias("kind"), T.abstained(F.col("answer_text")).alias("declined")
    )
    is_able = F.col("kind") == "able"
    able_count, unable_count = F.count_if(is_able), F.count_if(~is_able)
    return one.unionByName(other).agg(
        able_count.alias("answerable"),
        (F.count_if(is_able & F.col("declined")) / F.greatest(able_count, F.lit(1))).alias(
            "wrongly_abstained"
        ),
        unable_count.alias("unanswerable"),
        F.try_divide(F.count_if(~is_able & ~F.col("declined")), unable_count).alias(
            "wrongly_answered"
        ),
    )
