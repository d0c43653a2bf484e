"""Queries that pack context, answer, ground and probe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answering, dense, fusion, lexical
from ..operators.containment import containing
from ..plans.system import RAGSystem
from . import sql as S
from .base import SIZE, chunks, documents, hold, query, questions, rounded

K = 4
BASE = (S.DOCS, S.QUESTIONS, S.sentence_chunks("docs", SIZE), S.TERMS, S.bm25())
CONTEXT = f"ctx AS MATERIALIZED (SELECT query_id, position, rank, c.text FROM bm25 JOIN chunks c USING (position) WHERE rank <= {K})"
PACKED = S.packed_context("ctx", "packed_ctx")
ASKED = "asked AS (SELECT query_id, query, answer, coalesce(context, '') AS context FROM questions LEFT JOIN packed_ctx USING (query_id))"
ANSWERED = (*BASE, CONTEXT, PACKED, ASKED, S.generated("asked", "ans"))
PAYLOAD = ("doc_id", "chunk_index", "start", "end", "text")
RIGHT = f"contains({S.normalized('answer_text')}, {S.normalized('answer')})"
DECLINED = "contains(lower(answer_text), 'not stated')"


def _read(spark, sf_dir):
    """What the steps of a query read of the chunks, cut once."""
    return hold(chunks(spark, sf_dir).select("position", *PAYLOAD))


def _setup(spark, sf_dir, read=None):
    asked = hold(questions(spark, sf_dir))
    index = lexical.BM25(_read(spark, sf_dir) if read is None else read)
    return hold(index.search(asked, K, payload=PAYLOAD)), asked, answering.Generator()


def _place(order):
    return {
        "relevance": "rank",
        "reversed": "-rank",
        "edges": "CASE WHEN rank % 2 = 1 THEN rank ELSE 1000 - rank END",
    }[order]


@query(
    S.with_(*BASE, CONTEXT, *[S.packed_context("ctx", "p_" + o, _place(o)) for o in answering.ORDERS])
    + " UNION ALL ".join(f"SELECT '{o}' AS packing, * FROM p_{o}" for o in answering.ORDERS)
)
def context_pack(spark, sf_dir):
    context, _, _ = _setup(spark, sf_dir)
    rows = [
        answering.pack(context, order).withColumn("packing", F.lit(order)) for order in answering.ORDERS
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


GOLD = "gold AS (SELECT query_id, position, c.text FROM (SELECT query_id, min(position) AS position FROM questions q JOIN chunks c ON contains(c.text, q.answer) AND q.answer <> '' GROUP BY query_id) JOIN chunks c USING (position))"
FORCED = f"""
forced AS (
  SELECT ctx.query_id, rank, position, text FROM ctx
  WHERE rank < {K} OR EXISTS (SELECT 1 FROM gold g JOIN ctx c USING (query_id, position) WHERE g.query_id = ctx.query_id)
     OR NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = ctx.query_id)
  UNION ALL
  SELECT query_id, {K}, position, text FROM gold
  WHERE NOT EXISTS (SELECT 1 FROM ctx c WHERE c.query_id = gold.query_id AND c.position = gold.position)
)"""


def _gold(read, asked):
    """The first chunk holding each answer."""
    found = containing(read, asked.where("answer <> ''"), ("position", "text"))
    return found.groupBy("query_id").agg(
        F.min("position").alias("position"), F.min_by("text", "position").alias("text")
    )


@query(
    S.with_(
        *BASE, CONTEXT, GOLD, FORCED,
        f"""others AS (SELECT f.query_id, f.text, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) - 1 AS o
        FROM forced f JOIN gold g USING (query_id) WHERE f.position <> g.position),
        dial AS (SELECT unnest([0, 2, 9]) AS slot),
        n AS (SELECT query_id, count(o.o) AS n FROM gold LEFT JOIN others o USING (query_id) GROUP BY query_id),
        placed AS (
          SELECT slot, query_id, text, o + 0.0 AS k FROM others CROSS JOIN dial
          UNION ALL SELECT slot, query_id, text, least(slot, n) - 0.5 FROM gold JOIN n USING (query_id) CROSS JOIN dial)""",
    )
    + "SELECT slot, query_id, string_agg(text, chr(10) || chr(10) ORDER BY k) AS context FROM placed GROUP BY slot, query_id"
)
def pack_with_answer_at(spark, sf_dir):
    """The same context with the gold chunk first, third, and last."""
    read = _read(spark, sf_dir)
    context, asked, _ = _setup(spark, sf_dir, read)
    gold = hold(_gold(read, asked))
    pool = answering.pool_with_gold(context, gold, K)
    rows = [
        answering.pack_with_answer_at(pool, gold, at).withColumn("slot", F.lit(at)) for at in (0, 2, 9)
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(S.with_(*ANSWERED) + "SELECT query_id, answer_text FROM ans")
def generate_answers(spark, sf_dir):
    context, asked, generator = _setup(spark, sf_dir)
    return answering.answered(generator, context, asked).select("query_id", "answer_text")


PROMPT = (
    "'Answer the question using only the context. If the context does not contain the answer, say \"not stated\".' || chr(10)"
    " || 'Context: ' || context || chr(10) || 'Question: ' || query || chr(10) || 'Answer:'"
)


@query(
    S.with_(*ANSWERED)
    + f"""SELECT round(avg(CAST({RIGHT} AS INT)), 6) AS correct, round(avg(CAST({DECLINED} AS INT)), 6) AS abstained,
    round(avg(t), 6) AS mean_tokens, max(t) AS max_tokens
    FROM ans JOIN (SELECT *, len(list_filter(string_split_regex({PROMPT}, '[{S.SPACE_CLASS}]+'), lambda w: w <> '')) AS t FROM asked) USING (query_id)"""
)
def answer_questions(spark, sf_dir):
    context, asked, generator = _setup(spark, sf_dir)
    row = answering.answer_questions(generator, context, asked)
    return rounded(row, "correct", "abstained", "mean_tokens")


@query(
    S.with_(*ANSWERED)
    + f"""SELECT query_id, {RIGHT} AS correct, {DECLINED} AS abstained,
    (NOT {RIGHT} AND contains({S.normalized('answer')}, {S.normalized('answer_text')}) AND {S.normalized('answer_text')} <> '') AS terse
    FROM ans JOIN questions USING (query_id)"""
)
def answer_checks(spark, sf_dir):
    context, asked, generator = _setup(spark, sf_dir)
    got, want = F.col("answer_text"), F.col("answer")
    return answering.answered(generator, context, asked).select(
        "query_id",
        T.answer_is_correct(got, want).alias("correct"),
        T.abstained(got).alias("abstained"),
        T.terse_but_right(got, want).alias("terse"),
    )


CELLS = f"""
cells AS (
  SELECT query_id, CASE WHEN {DECLINED} THEN 'abstained' ELSE
    (CASE WHEN sup.position IS NOT NULL THEN 'grounded_' ELSE 'ungrounded_' END) || (CASE WHEN {RIGHT} THEN 'correct' ELSE 'wrong' END) END AS cell
  FROM ans JOIN questions USING (query_id) LEFT JOIN sup USING (query_id)
)"""


@query(
    S.with_(*ANSWERED, S.supported("ans", "ctx", "sup"), CELLS)
    + "SELECT "
    + ", ".join(f"round(count(*) FILTER (WHERE cell = '{c}') / count(*), 6) AS {c}" for c in answering.CELLS)
    + ", count(*) FILTER (WHERE cell LIKE 'grounded%') AS citations_verified, count(*) AS total FROM cells"
)
def grounding_cells(spark, sf_dir):
    context, asked, generator = _setup(spark, sf_dir)
    row = answering.grounding_report(generator, context, asked, documents(spark, sf_dir))
    return rounded(row, *answering.CELLS)


@query(
    S.with_(
        *ANSWERED,
        S.supported("ans", "ctx", "sup"),
        "rest AS (SELECT ctx.* FROM ctx LEFT JOIN sup ON sup.query_id = ctx.query_id AND sup.position = ctx.position WHERE sup.position IS NULL)",
        S.packed_context("rest", "packed_rest"),
        "again AS (SELECT query_id, query, coalesce(context, '') AS context FROM questions JOIN sup USING (query_id) LEFT JOIN packed_rest USING (query_id))",
        S.generated("again", "wo"),
        f"""outs AS (SELECT CASE WHEN wo.answer_text IS NULL THEN 'no_support'
          WHEN contains(lower(wo.answer_text), 'not stated') THEN 'abstained_without'
          WHEN {S.normalized('wo.answer_text')} = {S.normalized('ans.answer_text')} THEN 'unchanged_without'
          ELSE 'changed_without' END AS outcome, contains({S.normalized('ans.answer_text')}, {S.normalized('answer')}) AS ok
        FROM ans JOIN questions USING (query_id) LEFT JOIN wo USING (query_id))""",
    )
    + "SELECT "
    + ", ".join(f"round(count(*) FILTER (WHERE outcome = '{o}') / count(*), 6) AS {o}" for o in answering.OUTCOMES)
    + ", count(*) FILTER (WHERE outcome = 'unchanged_without' AND ok) AS recited_and_correct, count(*) AS total FROM outs"
)
def counterfactual(spark, sf_dir):
    context, asked, generator = _setup(spark, sf_dir)
    row = answering.counterfactual_faithfulness(generator, context, asked)
    return rounded(row, *answering.OUTCOMES)


@query(
    S.with_(
        *BASE, CONTEXT,
        "mixed AS (SELECT query_id, rank, text FROM ctx UNION ALL SELECT query_id, 0, replace(query, answer, reverse(answer)) FROM questions)",
        S.packed_context("mixed", "packed_mixed"),
        "asked AS (SELECT query_id, query, context FROM questions JOIN packed_mixed USING (query_id))",
        S.generated("asked", "ans"),
        f"""v AS (SELECT CASE WHEN contains({S.normalized('answer_text')}, {S.normalized('reverse(answer)')}) THEN 'f'
          WHEN {DECLINED} THEN 'a' ELSE 'k' END AS v FROM ans JOIN questions USING (query_id))""",
    )
    + """SELECT round(count(*) FILTER (WHERE v = 'f') / count(*), 6) AS followed,
    round(count(*) FILTER (WHERE v = 'k') / count(*), 6) AS overruled, round(count(*) FILTER (WHERE v = 'a') / count(*), 6) AS other FROM v"""
)
def poisoning(spark, sf_dir):
    """Every passage is contradicted by a copy whose answer is spelled backwards."""
    context, asked, generator = _setup(spark, sf_dir)
    false = asked.select(
        "query_id", "query",
        F.replace("query", F.col("answer"), F.reverse("answer")).alias("false_sentence"),
        F.reverse("answer").alias("false_answer"),
    )
    row = answering.poisoning_report(generator, context, false)
    return rounded(row, "followed", "overruled", "other")


@query(
    S.with_(
        S.DOCS,
        """questions AS (
          SELECT query_id, query, answer FROM q0 UNION ALL
          SELECT query_id + 1000000, reverse(query), NULL FROM q0)""".replace("q0", "base_questions"),
        S.sentence_chunks("docs", SIZE), S.TERMS, S.bm25(), CONTEXT, PACKED, ASKED, S.generated("asked", "ans"),
        "able AS (SELECT DISTINCT query_id FROM ctx JOIN questions USING (query_id) WHERE contains(text, answer))",
    ).replace("WITH RECURSIVE ", "WITH RECURSIVE " + S.QUESTIONS.strip().replace("questions AS", "base_questions AS", 1) + ",\n", 1)
    + f"""SELECT count(able.query_id) AS answerable,
    round(count(*) FILTER (WHERE able.query_id IS NOT NULL AND {DECLINED}) / greatest(count(able.query_id), 1), 6) AS wrongly_abstained,
    count(*) FILTER (WHERE answer IS NULL) AS unanswerable,
    round(count(*) FILTER (WHERE answer IS NULL AND NOT {DECLINED}) / count(*) FILTER (WHERE answer IS NULL), 6) AS wrongly_answered
    FROM ans JOIN questions USING (query_id) LEFT JOIN able USING (query_id)"""
)
def abstention(spark, sf_dir):
    """Passages are answerable where retrieved; passages spelled backwards are not."""
    asked = hold(questions(spark, sf_dir))
    nobody = hold(asked.select((-1 - F.col("query_id")).alias("query_id"), F.reverse("query").alias("query")))
    both = asked.select("query_id", "query").unionByName(nobody)
    context = hold(lexical.BM25(chunks(spark, sf_dir)).search(both, K, payload=("text",)))
    row = answering.abstention_report(answering.Generator(), context, asked, nobody)
    return rounded(row, "wrongly_abstained", "wrongly_answered")


SYSTEM = (
    S.DOCS, S.QUESTIONS, S.sentence_chunks("docs", SIZE), S.dense(),
    f"""pairs AS (
  SELECT d.query_id, d.position, d.rank AS first,
         len(list_intersect(list_distinct({S.tokens('q.query')}), list_distinct({S.tokens('c.text')})))
         / (greatest(len(list_distinct({S.tokens('q.query')})), 1) + 0.01::DOUBLE * len({S.tokens('c.text')})) AS score
  FROM dense d JOIN chunks c USING (position) JOIN questions q USING (query_id) WHERE d.rank <= 20),
  ctx AS MATERIALIZED (SELECT query_id, position, rank, c.text FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first) AS rank FROM pairs)
    JOIN chunks c USING (position) WHERE rank <= 3)""",
    PACKED, ASKED, S.generated("asked", "ans"), S.supported("ans", "ctx", "sup"),
)


def _system(spark, sf_dir):
    system = RAGSystem(documents(spark, sf_dir), SIZE)
    hold(system.chunks)
    return system


@query(
    S.with_(
        *SYSTEM,
        "j AS (SELECT query_id, min(CASE WHEN contains(text, answer) THEN rank END) AS first FROM ctx JOIN questions USING (query_id) GROUP BY query_id)",
    )
    + f"""SELECT count(*) AS questions, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 6) AS retrieval_hit,
    round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS retrieval_mrr, round(avg(CAST({RIGHT} AS INT)), 6) AS answer_correct,
    round(avg(CASE WHEN sup.position IS NULL THEN 0 ELSE 1 END), 6) AS answer_grounded, round(avg(CAST({DECLINED} AS INT)), 6) AS abstained
    FROM ans JOIN questions USING (query_id) LEFT JOIN sup USING (query_id) LEFT JOIN j USING (query_id)"""
)
def system_evaluate(spark, sf_dir):
    row = _system(spark, sf_dir).evaluate(questions(spark, sf_dir))
    return rounded(row, *row.columns[1:])


@query(
    S.with_(*SYSTEM)
    + """SELECT query_id, answer_text, (sup.position IS NOT NULL) AS supported, c.doc_id AS cited_doc,
    c.chunk_index AS cited_index, CASE WHEN sup.position IS NOT NULL THEN true END AS verified
    FROM ans LEFT JOIN sup USING (query_id) LEFT JOIN chunks c ON c.position = sup.position"""
)
def system_ask(spark, sf_dir):
    rows = _system(spark, sf_dir).ask(questions(spark, sf_dir))
    return rows.select(
        "query_id", "answer_text", "supported", F.col("support.doc_id").alias("cited_doc"),
        F.col("support.chunk_index").alias("cited_index"), "verified",
    )


@query(
    S.with_(S.DOCS, S.sentence_chunks("docs", SIZE))
    + f"""SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, min(length(text)) AS shortest, max(length(text)) AS longest,
    round(avg(length(text)), 6) AS mean, count(*) * 512 AS dense_bytes,
    count(*) FILTER (WHERE len({S.tokens('text')}) > 256) AS past_token_limit FROM chunks"""
)
def index_report(spark, sf_dir):
    return rounded(_system(spark, sf_dir).describe(), "mean")
