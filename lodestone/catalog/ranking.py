"""Queries that fuse, rerank and judge rankings, and experiments over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import evalsets, fusion, metrics
from ..plans import experiment as E
from . import sql as S
from .base import SIZE, chunks, documents, hold, mixed_chunks, query, questions, rounded

BASE = (S.DOCS, S.QUESTIONS, S.sentence_chunks("docs", SIZE), S.TERMS, S.bm25(), S.dense())
HITS = "query_id, position, rank, round(score, 6) AS score"
SYSTEMS = ("sparse", "dense", "score", "rrf")
RANKINGS = dict(zip(SYSTEMS, ("bm25", "dense", "fused", "rrf")))
ALL_SYSTEMS = (*BASE, S.fused(0.5), S.rrf())


def _hits(found):
    return rounded(found.select("query_id", "position", "rank", "score"), "score")


#: What a retriever reads of a chunk; nothing else of it is kept.
READ = ("position", "text")


def _setup(spark, sf_dir):
    retriever = fusion.HybridRetriever(hold(chunks(spark, sf_dir).select(*READ)), keep=hold)
    return retriever, hold(questions(spark, sf_dir))


def union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@query(
    S.with_(*BASE)
    + """SELECT query_id, position, rank, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0
      ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score
    FROM bm25 WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id)"""
)
def min_max_normalized(spark, sf_dir):
    retriever, asked = _setup(spark, sf_dir)
    return _hits(fusion.min_max_normalized(retriever.search(asked, 10, "sparse")))


@query(S.with_(*BASE, S.fused(0.3)) + f"SELECT {HITS} FROM fused WHERE rank <= 10")
def score_fusion(spark, sf_dir):
    retriever, asked = _setup(spark, sf_dir)
    return _hits(retriever.search(asked, 10, "score", alpha=0.3))


@query(S.with_(*BASE, S.rrf()) + f"SELECT {HITS} FROM rrf WHERE rank <= 10")
def rrf(spark, sf_dir):
    retriever, asked = _setup(spark, sf_dir)
    return _hits(retriever.search(asked, 10, "rrf"))


MIXED = (
    "docs AS (SELECT doc_id, text FROM documents)",
    "turns AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS doc_id, conv_id, turn, text FROM conversations)",
    S.QUESTIONS,
    S.sentence_chunks("docs", SIZE, "doc_chunks"),
    S.sentence_chunks("turns", SIZE, "turn_chunks"),
    """chunks AS MATERIALIZED (
      SELECT 'documents' AS kind, doc_id AS major, NULL::BIGINT AS minor, chunk_index, text, row_number() OVER (ORDER BY position) AS position
      FROM doc_chunks
      UNION ALL
      SELECT 'conversations', conv_id, turn, chunk_index, c.text,
             (SELECT count(*) FROM doc_chunks) + row_number() OVER (ORDER BY position)
      FROM turn_chunks c JOIN turns USING (doc_id))""",
    S.TERMS, S.bm25(), S.dense(), S.rrf(),
)


@query(
    S.with_(*MIXED)
    + " UNION ALL ".join(
        f"""SELECT '{method}' AS method, query_id, rank, kind, major, minor, chunk_index, round(score, 6) AS score
        FROM {method} JOIN chunks USING (position) WHERE rank <= 10"""
        for method in ("bm25", "rrf")
    )
)
def mixed_search(spark, sf_dir):
    """One index over documents and conversation turns, asked both ways."""
    retriever = fusion.HybridRetriever(hold(mixed_chunks(spark, sf_dir).select(*READ)), keep=hold)
    asked = hold(questions(spark, sf_dir))
    order = F.col("position.doc_order")
    found = union(
        retriever.search(asked, 10, method).withColumn("method", F.lit(name))
        for name, method in (("bm25", "sparse"), ("rrf", "rrf"))
    ).select(
        "method", "query_id", "rank",
        F.when(F.col("position.source") == "0" * 8, "documents").otherwise("conversations").alias("kind"),
        F.get(order, F.lit(0)).alias("major"), F.get(order, F.lit(1)).alias("minor"),
        "position.chunk_index", "score",
    )
    return rounded(found, "score")


@query(
    S.with_(*ALL_SYSTEMS)
    + " UNION ALL ".join(
        f"""SELECT '{method}' AS method, round(avg(coalesce(r, 0)), 6) AS hit FROM questions
        LEFT JOIN (SELECT query_id, max(rel) AS r FROM {S.judged(source, 3)} GROUP BY query_id) USING (query_id)"""
        for method, source in RANKINGS.items()
    )
)
def evaluate_hybrid(spark, sf_dir):
    """Hit rate at 3 of every way to search."""
    retriever, asked = _setup(spark, sf_dir)
    rows = [
        metrics.evaluate_hybrid(retriever, asked, 3, method=m).select(F.lit(m).alias("method"), "hit") for m in SYSTEMS
    ]
    return rounded(union(rows), "hit")


@query(
    S.with_(
        *BASE,
        f"s AS (SELECT query_id, max(rel) AS s FROM {S.judged('bm25', 3)} GROUP BY query_id)",
        f"d AS (SELECT query_id, max(rel) AS d FROM {S.judged('dense', 3)} GROUP BY query_id)",
        "t AS (SELECT coalesce(s, 0) = 1 AS s, coalesce(d, 0) = 1 AS d FROM questions LEFT JOIN s USING (query_id) LEFT JOIN d USING (query_id))",
    )
    + """SELECT count(*) FILTER (WHERE s) AS sparse, count(*) FILTER (WHERE d) AS dense,
    count(*) FILTER (WHERE s OR d) AS union, count(*) FILTER (WHERE s AND NOT d) AS sparse_only,
    count(*) FILTER (WHERE d AND NOT s) AS dense_only, count(*) AS total FROM t"""
)
def complementarity(spark, sf_dir):
    return fusion.complementarity(*_setup(spark, sf_dir), k=3)


RERANKED = f"""
short AS (SELECT * FROM bm25 WHERE rank <= 20),
pairs AS (
  SELECT s.query_id, s.position, s.rank AS first,
         len(list_intersect(list_distinct({S.tokens('q.query')}), list_distinct({S.tokens('c.text')})))
         / (greatest(len(list_distinct({S.tokens('q.query')})), 1) + 0.01::DOUBLE * len({S.tokens('c.text')})) AS score
  FROM short s JOIN chunks c USING (position) JOIN questions q USING (query_id)
), reranked AS (
  SELECT query_id, position, score, row_number() OVER (
    PARTITION BY query_id ORDER BY round(score, 9) DESC, first) AS rank FROM pairs
)"""


@query(S.with_(*BASE, RERANKED) + f"SELECT {HITS} FROM reranked WHERE rank <= 5")
def rerank(spark, sf_dir):
    retriever, asked = _setup(spark, sf_dir)
    found = retriever.search(asked, 20, "sparse")
    return _hits(fusion.Reranker().rerank(asked, found, 5))


@query(
    S.with_(
        *BASE, RERANKED,
        f"a AS (SELECT query_id, max(rel) AS r FROM {S.judged('bm25', 20)} GROUP BY query_id)",
        f"b AS (SELECT query_id, max(rel) AS r FROM {S.judged('reranked', 3)} GROUP BY query_id)",
    )
    + """SELECT round(avg(coalesce(a.r, 0)), 6) AS ceiling, round(avg(coalesce(b.r, 0)), 6) AS hit
    FROM questions LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)"""
)
def first_stage_ceiling(spark, sf_dir):
    """What a reranker could reach, and what it reaches."""
    retriever, asked = _setup(spark, sf_dir)
    ceiling = metrics.first_stage_recall(retriever, asked, 20).select(
        F.col("hit").alias("ceiling"), F.lit(None).cast("double").alias("hit")
    )
    reached = metrics.evaluate_reranked(retriever, fusion.Reranker(), asked, 20, 3).select(
        F.lit(None).cast("double").alias("ceiling"), "hit"
    )
    row = ceiling.unionByName(reached).agg(F.max("ceiling").alias("ceiling"), F.max("hit").alias("hit"))
    return rounded(row, "ceiling", "hit")


# --- metrics ---------------------------------------------------------------


def metrics_sql(ranking: str, depth: int = 3, k: int = 3) -> str:
    """Mean metrics of a ranking cut at ``depth``, one relevant chunk assumed."""
    return f"""
  SELECT avg(coalesce(hit, 0)) AS hit, avg(coalesce(found, 0) / 1.0) AS recall, avg(coalesce(found, 0) / {k}::DOUBLE) AS precision,
         avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr, avg(coalesce(ap, 0)) AS map, avg(coalesce(dcg, 0)) AS ndcg
  FROM questions LEFT JOIN (
    SELECT query_id, max(CASE WHEN rank <= {k} THEN rel END) AS hit, sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS found,
           min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rel = 1 THEN seen / rank::DOUBLE ELSE 0 END) AS ap,
           sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) AS dcg
    FROM (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM {S.judged(ranking, depth)})
    GROUP BY query_id) USING (query_id)"""


NAMES = ("hit", "recall", "precision", "mrr", "map", "ndcg")
ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in NAMES)
SCORES_SQL = "scores AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{name}' AS name, * FROM ({metrics_sql(source, 10, 5)})" for name, source in RANKINGS.items()
) + ")"


def _scores(retriever, asked):
    return union(
        [
            metrics.evaluate_all(retriever.search(asked, 10, name), asked, 5).withColumn("name", F.lit(name))
            for name in SYSTEMS
        ]
    )


@query(S.with_(*ALL_SYSTEMS, SCORES_SQL) + f"SELECT name, {ROUNDED} FROM scores")
def rank_metrics(spark, sf_dir):
    return rounded(_scores(*_setup(spark, sf_dir)), *NAMES)


@query(
    S.with_(*BASE)
    + f"""SELECT query_id, answer_rank FROM questions LEFT JOIN (
    SELECT query_id, min(rank) AS answer_rank FROM {S.judged('bm25', 50)} WHERE rel = 1 GROUP BY query_id) USING (query_id)"""
)
def answer_ranks(spark, sf_dir):
    retriever, asked = _setup(spark, sf_dir)
    return metrics.answer_ranks(retriever.search(asked, 50, "sparse"), asked)


@query(
    S.with_(*BASE)
    + f"""SELECT answer_rank, count(*) AS queries FROM questions LEFT JOIN (
    SELECT query_id, min(rank) AS answer_rank FROM {S.judged('bm25', 50)} WHERE rel = 1 GROUP BY query_id) USING (query_id)
    GROUP BY answer_rank"""
)
def rank_histogram(spark, sf_dir):
    retriever, asked = _setup(spark, sf_dir)
    found = metrics.answer_ranks(retriever.search(asked, 50, "sparse"), asked)
    return metrics.rank_histogram(found)


@query(
    S.with_(
        *BASE,
        f"h AS (SELECT query_id, max(rel) AS rel FROM {S.judged('bm25', 3)} GROUP BY query_id)",
        "p AS (SELECT count(*) AS n, avg(coalesce(rel, 0)) AS p FROM questions LEFT JOIN h USING (query_id))",
    )
    + """SELECT CAST(n AS BIGINT) AS total, round(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS low,
    round(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS high FROM p"""
)
def wald_interval(spark, sf_dir):
    retriever, asked = _setup(spark, sf_dir)
    ranks = metrics.answer_ranks(retriever.search(asked, 3, "sparse"), asked)
    counts = ranks.agg(F.count("answer_rank").alias("hits"), F.count(F.lit(1)).alias("total"))
    bounds = metrics.confidence_interval(F.col("hits"), F.col("total"))
    return rounded(counts.select("total", bounds["low"].alias("low"), bounds["high"].alias("high")), "low", "high")


POOL = "pool AS (" + " UNION ALL ".join(
    f"SELECT query_id, position, '{name}' AS system FROM {source} WHERE rank <= 5"
    for name, source in list(RANKINGS.items())[:3]
) + ")"


def _rankings(retriever, asked, depth):
    return {name: retriever.search(asked, depth, name) for name in SYSTEMS[:3]}


@query(
    S.with_(*ALL_SYSTEMS, POOL)
    + """SELECT query_id, position, array_to_string(list_sort(list(DISTINCT system)), ',') AS systems
    FROM pool GROUP BY query_id, position"""
)
def pooled_judgements(spark, sf_dir):
    retriever, asked = _setup(spark, sf_dir)
    pool = evalsets.pooled_judgements(_rankings(retriever, asked, 5), 5)
    return pool.select("query_id", "position", F.array_join("systems", ",").alias("systems"))


@query(
    S.with_(*ALL_SYSTEMS, POOL)
    + """SELECT q.query_id, coalesce(bool_or(contains(c.text, q.answer)), false) AS covered
    FROM questions q LEFT JOIN pool p USING (query_id) LEFT JOIN chunks c USING (position) GROUP BY q.query_id"""
)
def pool_coverage(spark, sf_dir):
    retriever, asked = _setup(spark, sf_dir)
    return evalsets.pool_coverage(
        evalsets.pooled_judgements(_rankings(retriever, asked, 5), 5), asked
    )


def _penalty_sql(name, source):
    return f"""SELECT '{name}' AS system, round(sum(coalesce(by_pool, 0)) / count(*), 6) AS by_pool,
    round(sum(coalesce(by_truth, 0)) / count(*), 6) AS by_truth,
    round((sum(coalesce(by_truth, 0)) - sum(coalesce(by_pool, 0))) / count(*), 6) AS penalty
    FROM questions LEFT JOIN (
      SELECT query_id, max(rel) AS by_truth, max(CASE WHEN rel = 1 AND position IN (
        SELECT position FROM pool WHERE pool.query_id = j.query_id AND system <> '{name}') THEN 1 ELSE 0 END) AS by_pool
      FROM {S.judged(source, 3)} j GROUP BY query_id) USING (query_id)"""


@query(
    S.with_(*ALL_SYSTEMS, POOL)
    + " UNION ALL ".join(_penalty_sql(n, s) for n, s in list(RANKINGS.items())[:3])
)
def pool_penalty(spark, sf_dir):
    retriever, asked = _setup(spark, sf_dir)
    rows = evalsets.exclusion_penalty(_rankings(retriever, asked, 5), asked, 5, 3)
    return rounded(rows, "by_pool", "by_truth", "penalty")


@query(
    S.with_(*ALL_SYSTEMS, SCORES_SQL)
    + """SELECT round(avg(CASE WHEN abs(a.mrr - b.mrr) > 1e-9 THEN 1 ELSE 0 END), 6) AS resolving_power
    FROM scores a JOIN scores b ON a.name < b.name"""
)
def resolving_power(spark, sf_dir):
    rows = _scores(*_setup(spark, sf_dir)).select("name", F.col("mrr").alias("score"))
    return rounded(metrics.resolving_power(rows), "resolving_power")


@query(
    S.with_(*ALL_SYSTEMS, SCORES_SQL)
    + """, d AS (SELECT a.mrr - b.mrr AS x, a.ndcg - b.ndcg AS y FROM scores a JOIN scores b ON a.name < b.name),
    c AS (SELECT count(*) FILTER (WHERE abs(x) > 1e-9 AND abs(y) > 1e-9 AND (x > 0) = (y > 0)) AS agreed,
      count(*) FILTER (WHERE abs(x) > 1e-9 AND abs(y) > 1e-9 AND (x > 0) <> (y > 0)) AS disagreed,
      count(*) FILTER (WHERE abs(x) <= 1e-9 OR abs(y) <= 1e-9) AS unresolved FROM d)
    SELECT agreed, disagreed, unresolved, CASE WHEN agreed + disagreed > 0
      THEN round(agreed / (agreed + disagreed), 6) ELSE 'NaN'::DOUBLE END AS rate FROM c"""
)
def system_agreement(spark, sf_dir):
    """Do MRR and nDCG order the systems alike?"""
    rows = hold(_scores(*_setup(spark, sf_dir)))
    first = rows.select("name", F.col("mrr").alias("score"))
    second = rows.select("name", F.col("ndcg").alias("score"))
    return rounded(metrics.agreement(first, second), "rate")


# --- experiments -----------------------------------------------------------

ABLATED = {
    "full": {},
    "no reranker": {"rerank": False},
    "dense only": {"method": "dense"},
    "fixed chunks": {"strategy": "fixed"},
    "shallow": {"depth": 5},
}
BASELINE = E.Pipeline(chunk_size=SIZE, method="sparse", k=3)


def _reranked_sql(source: str, depth: int, name: str) -> str:
    return (
        RERANKED.replace("short AS (SELECT * FROM bm25 WHERE rank <= 20)",
                         f"short AS (SELECT * FROM {source} WHERE rank <= {depth})")
        .replace("reranked AS", f"{name} AS")
        .replace("pairs", f"{name}_pairs")
        .replace("short", f"{name}_short")
    )


def _config_sql(source="bm25", depth=20, rerank=True, strategy="sentence"):
    chunked = S.sentence_chunks("docs", SIZE) if strategy == "sentence" else S.fixed_chunks("docs", SIZE)
    parts = [S.DOCS, S.QUESTIONS, chunked, S.TERMS, S.bm25(), S.dense()]
    if rerank:
        return S.with_(*parts, _reranked_sql(source, depth, "best")) + metrics_sql("best", depth, 3)
    return S.with_(*parts) + metrics_sql(source, 3, 3)


CONFIG_SQL = (
    _config_sql(), _config_sql(rerank=False), _config_sql("dense"), _config_sql(strategy="fixed"),
    _config_sql(depth=5),
)


@query(
    "WITH rows AS ("
    + " UNION ALL ".join(f"SELECT {i} AS place, mrr, hit FROM ({s})" for i, s in enumerate(CONFIG_SQL))
    + ") SELECT place, round(mrr, 6) AS mrr, round(hit, 6) AS hit, round(mrr - first_value(mrr) OVER (ORDER BY place), 6) AS delta FROM rows"
)
def ablation_delta(spark, sf_dir):
    runner = E.Runner(documents(spark, sf_dir), hold(questions(spark, sf_dir)), keep=hold)
    rows = E.ablate(runner, BASELINE, ABLATED)
    return rounded(rows.select("place", "mrr", "hit", "delta"), "mrr", "hit", "delta")


def _labels():
    """Names of the configurations of CONFIG_SQL, spelled out."""
    best, plain = f"sentence({SIZE})", f"fixed({SIZE})"
    return (f"{best} + sparse + rerank", f"{best} + sparse", f"{best} + dense + rerank", f"{plain} + sparse + rerank", f"{best} + sparse + rerank")


@query(
    " UNION ALL ".join(
        f"SELECT {i} AS place, '{name}' AS label, round(hit, 6) AS hit FROM ({s})"
        for i, (name, s) in enumerate(zip(_labels(), CONFIG_SQL))
    )
)
def ablation_labels(spark, sf_dir):
    """The same configurations by what they are called."""
    runner = E.Runner(documents(spark, sf_dir), hold(questions(spark, sf_dir)), keep=hold)
    rows = E.ablate(runner, BASELINE, ABLATED)
    return rounded(rows.select("place", "label", "hit"), "hit")


@query(
    "WITH v AS (SELECT "
    + ", ".join(
        f"(SELECT mrr FROM ({sql})) AS {name}"
        for name, sql in zip(
            ("a", "b", "c", "d"),
            (_config_sql(), _config_sql(rerank=False), _config_sql("dense"), _config_sql("dense", rerank=False)),
        )
    )
    + """) SELECT round(a, 6) AS full, round(b, 6) AS without_first, round(c, 6) AS without_second,
    round(d, 6) AS without_both, round(b + c - a, 6) AS additive_prediction, round(d - (b + c - a), 6) AS interaction FROM v"""
)
def ablation_interaction(spark, sf_dir):
    runner = E.Runner(documents(spark, sf_dir), hold(questions(spark, sf_dir)), keep=hold)
    row = E.interaction(runner, {"rerank": False}, {"method": "dense"}, BASELINE)
    return rounded(row, *row.columns)
