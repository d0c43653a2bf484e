import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.operators import answering as A
from lodestone.operators import evalsets, fusion, metrics
from lodestone.operators.chunking import build_index
from lodestone.plans import experiment as E
from lodestone.plans.system import RAGSystem
from lodestone.sources import handbook as H

# The scripted generators below run in Python workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, position bigint, score double")


def judgements(spark, *lists):
    rows = [(q, r + 1, rel) for q, values in enumerate(lists) for r, rel in enumerate(values)]
    return spark.createDataFrame(rows, "query_id int, rank int, rel int")


def test_metrics_by_hand(spark):
    rows = metrics.per_query(judgements(spark, [0, 1, 0, 1, 0], [1, 0, 1], [0, 0]), 3, None)
    got = {r["query_id"]: r for r in rows.collect()}
    assert got[0]["hit"] == 1 and got[0]["mrr"] == 0.5 and got[0]["recall"] == 0.5
    assert math.isclose(got[0]["precision"], 1 / 3)
    assert round(got[1]["map"], 4) == 0.8333
    assert got[2]["hit"] == 0 and got[2]["mrr"] == 0 and got[2]["map"] == 0 and got[2]["ndcg"] == 0
    assert got[2]["recall"] == 1.0
    two = metrics.per_query(judgements(spark, [0, 1]), 2, None).first()
    assert round(two["ndcg"], 4) == 0.6309
    four = metrics.per_query(judgements(spark, [1, 0, 1]), 3, 4).first()
    assert four["recall"] == 0.5
    with pytest.raises(ValueError):
        metrics.per_query(judgements(spark, [1]), 0)
    with pytest.raises(ValueError):
        metrics.recall_at_k_judged(3, -1)


def test_rank_averages_can_disagree(spark):
    a = [1] * 14 + [2] * 3
    b = [1] * 15 + [2, 15]
    means = {}
    for name, ranks in (("a", a), ("b", b)):
        rows = judgements(spark, *[[0] * (r - 1) + [1] for r in ranks])
        means[name] = metrics.per_query(rows, 15).agg(F.avg("mrr"), F.avg("ndcg")).first()
    assert means["a"][0] < means["b"][0] + 0.02 and len(means) == 2


def test_confidence_interval(spark):
    bounds = metrics.confidence_interval(F.lit(16), F.lit(17))
    row = spark.range(1).select(bounds["low"], bounds["high"]).first()
    assert [round(100 * x) for x in row] == [83, 105]
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(metrics.confidence_interval(F.lit(0), F.lit(0))).collect()


def scores(spark, **values):
    return spark.createDataFrame(list(values.items()), "name string, score double")


@pytest.mark.parametrize(
    "values,expected",
    [({"a": 1.0, "b": 1.0}, 0.0), ({"a": 1.0, "b": 0.5}, 1.0), ({"a": 1.0}, 0.0),
     ({"a": 1.0, "b": 1.0, "c": 0.5, "d": 0.5 + 1e-12}, 4 / 6)],
)
def test_resolving_power(spark, values, expected):
    got = metrics.resolving_power(scores(spark, **values)).first()["resolving_power"]
    assert math.isclose(got, expected)


def test_agreement(spark):
    first = scores(spark, a=1.0, b=0.5, c=0.5, x=9.0)
    row = metrics.agreement(first, scores(spark, a=0.2, b=0.1, c=0.3)).first()
    assert (row["agreed"], row["disagreed"], row["unresolved"]) == (1, 1, 1) and row["rate"] == 0.5
    tied = metrics.agreement(scores(spark, a=1.0, b=1.0), scores(spark, a=1.0, b=0.0)).first()
    assert tied["unresolved"] == 1 and math.isnan(tied["rate"])


def test_rrf(spark):
    one = ranking(spark, [(0, 1, 10, 9.0), (0, 2, 2, 8.0)])
    two = ranking(spark, [(0, 1, 2, 0.5), (0, 2, 10, 0.4)])
    rows = fusion.reciprocal_rank_fusion([one, two], k=2).orderBy("rank").collect()
    # Ties go by the item read as text, so 10 comes before 2.
    assert [r["position"] for r in rows] == [10, 2]
    assert all(math.isclose(r["score"], 1 / 61 + 1 / 62) for r in rows)
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion([one, two], constant=-1)


def test_score_fusion(spark):
    sparse = ranking(spark, [(0, 1, 1, 3.0), (0, 2, 2, 2.0), (0, 3, 3, 1.0)])
    dense = ranking(spark, [(0, 1, 4, 0.9), (0, 2, 3, 0.1)])
    got = fusion.score_fusion(sparse, dense, 0.5, 4).orderBy("rank").collect()
    assert [(r["position"], r["score"]) for r in got] == [(1, 0.5), (4, 0.5), (2, 0.25), (3, 0.0)]
    flat = fusion.min_max_normalized(ranking(spark, [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]))
    assert {r["score"] for r in flat.collect()} == {1.0}
    with pytest.raises(ValueError):
        fusion.score_fusion(sparse, dense, 1.5)


@pytest.fixture(scope="module")
def system(spark):
    return RAGSystem(H.documents(spark))


@pytest.fixture(scope="module")
def asked(spark):
    return H.questions(spark, "original", "paraphrased").persist()


@pytest.fixture(scope="module")
def context(system, asked):
    return system.retrieve(asked).persist()


def test_hybrid_and_rerank(system, asked):
    hybrid = system.retriever
    for method in fusion.METHODS:
        rows = hybrid.search(asked, 3, method)
        assert {"query_id", "rank", "position", "score", "text"} <= set(rows.columns)
        assert rows.groupBy("query_id").count().agg(F.max("count")).first()[0] == 3
    with pytest.raises(ValueError):
        hybrid.search(asked, 3, "best")
    found = hybrid.search(asked, 20, "sparse")
    best = fusion.Reranker().rerank(asked, found, 3)
    assert best.join(found, ["query_id", "position"], "left_anti").count() == 0
    ceiling = metrics.first_stage_recall(hybrid, asked, 20).first()["hit"]
    assert metrics.evaluate_reranked(hybrid, fusion.Reranker(), asked).first()["hit"] <= ceiling
    row = fusion.complementarity(hybrid, asked).first()
    assert row["union"] == row["sparse"] + row["dense_only"] == row["dense"] + row["sparse_only"]
    assert row["total"] == 34


def test_bm25_metrics_reproduce_published_values(spark, system):
    original = H.questions(spark)
    row = metrics.evaluate_all(system.retriever.search(original, 3, "sparse"), original, 3).first()
    assert round(row["mrr"], 3) == 0.814 and round(row["ndcg"], 3) == 0.847
    para = H.questions(spark, "paraphrased")
    row = metrics.evaluate_all(system.retriever.search(para, 3, "sparse"), para, 3).first()
    assert round(row["mrr"], 3) == 0.118


def test_vocabulary_overlap_of_sets(spark):
    docs = H.documents(spark)
    got = [
        round(100 * evalsets.vocabulary_overlap_of_set(H.questions(spark, s), docs).first()["overlap"])
        for s in ("original", "paraphrased")
    ]
    assert got == [45, 9]


def test_generated_sets(spark):
    docs = H.documents(spark)
    lines = [l for text in H.HANDBOOK.values() for l in text.split("\n")]
    known = evalsets.known_item_questions(docs)
    assert known.count() == sum(len(l) >= 30 for l in lines)
    assert evalsets.known_item_questions(docs, 3).count() == 3
    assert evalsets.known_item_questions(docs, 0).count() == known.count()
    for row in evalsets.cloze_questions(docs).collect():
        line = H.HANDBOOK[row["doc_id"]].split("\n")[row["line"]]
        assert row["query"] == line.replace(row["answer"], "____", 1).rstrip(".")


def test_pooling(spark, system, asked):
    ranks = {m: system.retriever.search(asked, 5, m) for m in ("sparse", "dense")}
    pool = evalsets.pooled_judgements(ranks, 5)
    assert set(pool.select(F.explode("systems").alias("s")).distinct().toPandas()["s"]) == {"sparse", "dense"}
    assert evalsets.pool_coverage(pool, asked).count() == 34
    rows = evalsets.exclusion_penalty(ranks, asked).collect()
    assert all(0 <= r["by_pool"] <= r["by_truth"] <= 1 for r in rows)


def contexts(spark, *texts):
    rows = [(0, i + 1, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id bigint, rank int, position bigint, text string")


def test_pack_orders(spark):
    five = contexts(spark, *"abcde")
    got = {o: A.pack(five, o, "").first()["context"] for o in A.ORDERS}
    assert got == {"relevance": "abcde", "reversed": "edcba", "edges": "acedb"}
    with pytest.raises(ValueError):
        A.pack(five, "random")


def test_pack_with_answer_at(spark):
    four = contexts(spark, *"abcd")
    gold = four.where("position = 2").select("query_id", "position", "text")
    got = [A.pack_with_answer_at(four, gold, p, "").first()["context"] for p in (-1, 0, 2, 9)]
    assert got == ["cabd", "cabd", "abcd", "abdc"]
    other = spark.createDataFrame([(0, 77, "z")], "query_id bigint, position bigint, text string")
    forced = A.pool_with_gold(four, other, 3).orderBy("rank").collect()
    assert "".join(r["text"] for r in forced) == "abz"
    assert A.pool_with_gold(four, gold, 3).count() == 3


class Fixed:
    """A generator with scripted answers."""

    max_input_tokens = 512

    def __init__(self, answers, default="not stated"):
        self.answers, self.default = answers, default

    def count_tokens(self, prompts):
        return [len(p) for p in prompts]

    def generate(self, pairs):
        return [self.answers(q, c) for q, c in pairs]


def test_grounding_cells(spark):
    context = contexts(spark, "The limit is ten days.", "Other text.").withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    context = context.select(
        F.col("query_id").cast("bigint"), "rank", "position", "text", F.lit("d0").alias("doc_id"),
        F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(0).alias("chunk_index"),
    )
    docs = H.text_documents(spark, "The limit is ten days.")
    told = {"a": "ten days", "b": "limit", "c": "it is ten days surely", "d": "nonsense", "e": "Not stated."}
    asked = spark.createDataFrame(
        [(i, q, "ten days") for i, q in enumerate(told)], "query_id bigint, query string, answer string"
    )
    generator = A.Generator(Fixed(lambda q, c: told[q]))
    row = A.grounding_report(generator, context, asked, docs).first()
    assert [row[c] for c in A.CELLS] == [0.2] * 5
    assert row["citations_verified"] == 2 and row["total"] == 5
    first = A.answer_with_citation(generator, context, asked, docs).orderBy("query_id").first()
    assert first["citation"]["quote"] == "The limit is ten days." and first["verified"]


def test_counterfactual(spark):
    context = contexts(spark, "ten days", "b").withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    context = context.withColumn("query_id", F.col("query_id").cast("bigint"))
    asked = spark.createDataFrame(
        [(0, "stops", "ten days"), (1, "changes", "ten days"), (2, "recites", "ten days"), (3, "none", "x")],
        "query_id bigint, query string, answer string",
    )

    def say(q, c):
        gone = "ten days" not in c
        return {"stops": "not stated" if gone else "ten days", "changes": "b" if gone else "ten days",
                "recites": "The ten days.", "none": "absent"}[q]

    row = A.counterfactual_faithfulness(A.Generator(Fixed(say)), context, asked).first()
    assert [row[o] for o in A.OUTCOMES] == [0.25] * 4 and row["recited_and_correct"] == 1
    support = A.supporting_chunks(
        asked.select("query_id", F.lit("ten days").alias("answer_text")), context
    )
    rest = A.remove_supporting_chunk(context, support)
    assert rest.count() == 4 and rest.where("text = 'ten days'").count() == 0


def test_poisoning_and_abstention(spark, system, asked, context):
    wrong = H.contradictions(spark)
    first = A.Generator(Fixed(lambda q, c: c.split("\n\n")[0]))
    kept = A.Generator(Fixed(lambda q, c: c.split("\n\n")[-1]))
    mixed = system.retrieve(wrong)
    row = A.poisoning_report(first, mixed, wrong).first()
    assert (row["followed"], row["overruled"], row["other"]) == (1, 0, 0)
    assert A.poisoning_report(kept, mixed, wrong).first()["overruled"] == 1
    nobody = H.unanswerable(spark)
    both = context.unionByName(system.retrieve(nobody))
    quiet = A.abstention_report(A.Generator(Fixed(lambda q, c: "not stated")), both, asked, nobody).first()
    assert quiet["wrongly_abstained"] == 1 and quiet["wrongly_answered"] == 0
    loud = A.abstention_report(first, both, asked, nobody).first()
    assert loud["wrongly_abstained"] == 0 and loud["wrongly_answered"] == 1 and loud["unanswerable"] == 6


def test_fixed_probe_sets(spark):
    text = " ".join(H.HANDBOOK.values())
    assert all(answer not in text for _, _, answer in H.CONTRADICTIONS)
    assert set(H.YES_NO_MISMATCH) <= {q[1] for q in H.QUESTIONS}
    assert all(answer in H.HANDBOOK[doc] for _, _, answer, doc in H.QUESTIONS)


def test_system(spark, system, asked):
    row = system.evaluate(asked).first()
    assert row["questions"] == 34 and 0 < row["retrieval_mrr"] <= row["retrieval_hit"] <= 1
    again = system.evaluate(asked).first()
    assert row == again
    about = system.describe().first()
    assert about["documents"] == 5 and about["chunks"] == 26 and about["past_token_limit"] == 0
    answers = system.ask(asked).collect()
    assert len(answers) == 34
    assert all(a["verified"] for a in answers if a["supported"])


def test_ablations(spark, asked):
    runner = E.Runner(H.documents(spark), asked)
    chosen = {n: E.ABLATIONS[n] for n in ("full pipeline", "no reranker", "no embeddings (BM25)")}
    rows = E.ablate(runner, ablations=chosen).orderBy("place").collect()
    assert rows[0]["delta"] == 0 and rows[0]["label"] == "sentence(80) + dense + rerank"
    assert rows[1]["label"] == "sentence(80) + dense"
    row = E.interaction(runner, {"rerank": False}, {"method": "sparse"}).first()
    expected = row["without_first"] + row["without_second"] - row["full"]
    assert math.isclose(row["additive_prediction"], expected)
    assert all(len([f for f in change]) <= 1 for change in E.ABLATIONS.values())
    dense = E.evaluate_dense(runner.retriever(E.Pipeline()).dense, asked).first()
    assert 0 <= dense["hit"] <= 1
