"""Queries that retrieve: lexical search, vector search, approximate search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import dense, lexical
from ..operators.ann import IVFIndex, NSWIndex, recall_curve
from ..operators.containment import containing
from ..operators.evalsets import vocabulary_overlap, vocabulary_overlap_of_set
from ..operators.postings import StoredBM25
from ..plans import experiment as E
from ..session import use_checkpoints
from ..sources import tables
from . import sql as S
from .base import SIZE, chunks, documents, hold, query, questions, rounded

BASE = (S.DOCS, S.QUESTIONS, S.sentence_chunks("docs", SIZE))
HITS = "query_id, position, rank, round(score, 6) AS score"


def _hits(found, key="position"):
    return rounded(found.select("query_id", key, "rank", "score"), "score")


@query(
    S.with_(*BASE, S.TERMS)
    + "SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN coll"
)
def document_frequency(spark, sf_dir):
    return rounded(lexical.BM25(chunks(spark, sf_dir)).idf(), "idf")


@query(S.with_(*BASE, S.TERMS) + "SELECT term, position, tf FROM tf")
def postings(spark, sf_dir):
    return lexical.BM25(chunks(spark, sf_dir)).postings()


@query(S.with_(*BASE, S.TERMS, S.overlap("occurrences")) + f"SELECT {HITS} FROM overlap WHERE rank <= 3")
def retrieve_occurrences(spark, sf_dir):
    index = lexical.Overlap(chunks(spark, sf_dir), "occurrences")
    return _hits(index.search(questions(spark, sf_dir), 3))


@query(S.with_(*BASE, S.TERMS, S.overlap("coverage")) + f"SELECT {HITS} FROM overlap WHERE rank <= 3")
def retrieve_coverage(spark, sf_dir):
    return _hits(lexical.Overlap(chunks(spark, sf_dir)).search(questions(spark, sf_dir), 3))


@query(
    S.with_(*BASE, S.TERMS, S.overlap("coverage"), S.budgeted("overlap", 900))
    + f"SELECT {HITS} FROM packed"
)
def retrieve_budget(spark, sf_dir):
    index = lexical.Overlap(chunks(spark, sf_dir))
    return _hits(index.search_within_budget(questions(spark, sf_dir), 900))


@query(S.with_(*BASE, S.TERMS, S.bm25()) + f"SELECT {HITS} FROM bm25 WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _hits(lexical.BM25(chunks(spark, sf_dir)).search(questions(spark, sf_dir), 10))


def _stored(spark, sf_dir):
    """The index of the sentence chunks, laid out in the shared folder."""
    path = f"{use_checkpoints(spark)}/bm25-{uuid.uuid4().hex}"
    return StoredBM25.write(lexical.BM25(chunks(spark, sf_dir)), path)


@query(S.with_(*BASE, S.TERMS, S.bm25()) + f"SELECT {HITS} FROM bm25 WHERE rank <= 10")
def bm25_stored_topk(spark, sf_dir):
    """The same ranking from stored postings, most of whose blocks are skipped."""
    return _hits(_stored(spark, sf_dir).search(questions(spark, sf_dir), 10))


@query(
    S.with_(*BASE, S.TERMS)
    + "SELECT query_id, CAST(sum(df) AS BIGINT) AS postings, true AS fewer_read FROM (SELECT DISTINCT query_id, term FROM qt) JOIN df USING (term) GROUP BY query_id"
)
def bm25_stored_work(spark, sf_dir):
    """Postings of each query's terms, and whether a search for its best chunk reads fewer."""
    work = _stored(spark, sf_dir).work(questions(spark, sf_dir), 1)
    return work.select("query_id", "postings", (F.col("read") < F.col("postings")).alias("fewer_read"))


@query(
    S.with_(*BASE, S.TERMS, S.bm25(b=0.25), S.budgeted("bm25", 900)) + f"SELECT {HITS} FROM packed"
)
def bm25_budget(spark, sf_dir):
    index = lexical.BM25(chunks(spark, sf_dir), b=0.25)
    return _hits(index.search_within_budget(questions(spark, sf_dir), 900))


@query(
    S.with_(
        *BASE,
        """words AS (SELECT position, doc_id, chunk_index, text, list_distinct(string_split(lower(text), ' ')) AS b FROM chunks),
        scored AS (
          SELECT query_id, position, doc_id, chunk_index, len(list_intersect(list_distinct(string_split(lower(query), ' ')), b)) / length(text) AS score
          FROM questions CROSS JOIN words)""",
    )
    + """SELECT query_id, position, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, chunk_index) AS rank FROM scored)
    WHERE rank <= 3"""
)
def retrieve_custom(spark, sf_dir):
    """A scorer of the caller's own: shared words for each character of the chunk."""

    def words(text):
        return F.split(F.lower(text), " ")

    def density(asked, length, shared):
        return shared / length

    return _hits(lexical.overlap(chunks(spark, sf_dir), density, F.length, words).search(questions(spark, sf_dir), 3))


@query(
    S.with_(*BASE, S.TERMS)
    + "SELECT term, position, round(tf * 2.5 / (tf + 1.5), 6) AS saturated FROM tf WHERE tf > 1"
)
def saturation(spark, sf_dir):
    """What repeats of a term are worth."""
    rows = lexical.BM25(chunks(spark, sf_dir)).postings().where("tf > 1")
    return rounded(rows.select("term", "position", T.saturation(F.col("tf")).alias("saturated")), "saturated")


EVALUATED = """
found AS (SELECT query_id, max(rel) AS rel, sum(length(text)) AS context FROM {ranked} GROUP BY query_id),
whole AS (SELECT q.query_id, bool_or(contains(c.text, q.answer)) AS intact FROM questions q CROSS JOIN chunks c GROUP BY ALL)"""
EVALUATION = """SELECT (SELECT CAST(count(*) AS DOUBLE) FROM chunks) AS chunks,
  (SELECT round(avg(length(text)), 6) FROM chunks) AS mean_chunk,
  (SELECT round(avg(CAST(intact AS INT)), 6) FROM whole) AS intact,
  round(avg(coalesce(rel, 0)), 6) AS hit, round(avg(coalesce(context, 0)), 6) AS context
  FROM questions LEFT JOIN found USING (query_id)"""


@query(
    S.with_(
        *BASE, S.TERMS, S.bm25(), S.budgeted("bm25", 900),
        EVALUATED.format(ranked=S.judged("packed", 10**9)),
    )
    + EVALUATION
)
def evaluate_bm25(spark, sf_dir):
    index = hold(chunks(spark, sf_dir))
    row = E.evaluate_bm25(index, questions(spark, sf_dir), budget=900)
    return rounded(row, *row.columns)


SWEPT = (120, 240, 480)


def _sweep_sql(size):
    return (
        S.with_(
            S.DOCS, S.QUESTIONS, S.sentence_chunks("docs", size), S.TERMS, S.overlap("coverage"),
            EVALUATED.format(ranked=S.judged("overlap", 3)),
        )
        + EVALUATION
    )


@query(
    " UNION ALL ".join(f"SELECT {size} AS size, * FROM ({_sweep_sql(size)})" for size in SWEPT)
)
def sweep_sizes(spark, sf_dir):
    rows = E.sweep(documents(spark, sf_dir), questions(spark, sf_dir), SWEPT)
    return rounded(rows, *rows.columns[:-1])


@query(
    "SELECT arg_min(size, (-hit, size)) AS best_size FROM ("
    + " UNION ALL ".join(f"SELECT {size} AS size, hit FROM ({_sweep_sql(size)})" for size in SWEPT)
    + ")"
)
def best_size(spark, sf_dir):
    return E.best_size(E.sweep(documents(spark, sf_dir), questions(spark, sf_dir), SWEPT))


@query("SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_containment(spark, sf_dir):
    """Which documents hold which benchmark passage, whole and literally."""
    passages = tables.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("answer")
    )
    return containing(documents(spark, sf_dir), passages, ("doc_id",))


@query(
    S.with_(*BASE)
    + """SELECT query_id, bool_or(contains(c.text, answer)) AS intact
    FROM questions CROSS JOIN chunks c GROUP BY query_id"""
)
def answer_intact(spark, sf_dir):
    from ..operators.containment import intact

    return intact(chunks(spark, sf_dir), questions(spark, sf_dir))


@query(
    S.with_(
        S.QUESTIONS,
        "homes AS (SELECT query_id, query, answer, min(doc_id) AS doc_id FROM questions q JOIN documents d ON contains(d.text, q.answer) GROUP BY ALL)",
        """lines AS (SELECT query_id, query, list_filter(string_split(text, chr(10)), lambda l: contains(l, answer))[1] AS line
      FROM homes JOIN documents USING (doc_id))""",
        f"""sets AS (SELECT query_id, line, list_distinct({S.tokens('query')}) AS a, list_distinct({S.tokens('line')}) AS b FROM lines)""",
    )
    + """SELECT query_id, CASE WHEN line IS NULL THEN NULL WHEN len(a) = 0 THEN 0.0
    ELSE round(len(list_intersect(a, b)) / len(a), 6) END AS overlap FROM sets"""
)
def vocabulary_overlap_by_question(spark, sf_dir):
    asked, docs = questions(spark, sf_dir), documents(spark, sf_dir)
    homes = containing(docs, asked, ("doc_id",)).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return rounded(vocabulary_overlap(asked.join(homes, "query_id"), docs), "overlap")


@query(
    S.with_(
        S.QUESTIONS,
        "homes AS (SELECT query_id, query, answer, min(doc_id) AS doc_id FROM questions q JOIN documents d ON contains(d.text, q.answer) GROUP BY ALL)",
        """lines AS (SELECT query_id, query, list_filter(string_split(text, chr(10)), lambda l: contains(l, answer))[1] AS line
      FROM homes JOIN documents USING (doc_id))""",
        f"""sets AS (SELECT query_id, line, list_distinct({S.tokens('query')}) AS a, list_distinct({S.tokens('line')}) AS b FROM lines)""",
    )
    + """SELECT round(coalesce(avg(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END), 0), 6) AS overlap
    FROM sets WHERE line IS NOT NULL"""
)
def vocabulary_overlap_mean(spark, sf_dir):
    asked, docs = questions(spark, sf_dir), documents(spark, sf_dir)
    homes = containing(docs, asked, ("doc_id",)).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return rounded(vocabulary_overlap_of_set(asked.join(homes, "query_id"), docs), "overlap")


@query(
    S.with_(S.DOCS, S.fixed_chunks("docs", 120))
    + """SELECT doc_id, bool_or(contains(text, phrase)) AS inside FROM (
      SELECT c.doc_id, c.text, substring(d.text, 101, 40) AS phrase FROM chunks c JOIN docs d USING (doc_id) WHERE length(d.text) >= 140)
    GROUP BY doc_id"""
)
def boundary_phrase(spark, sf_dir):
    """Whether a phrase across the first chunk boundary is inside any chunk."""
    docs = documents(spark, sf_dir).where(F.length("text") >= 140)
    cut = C.with_fixed_chunks(docs, "text", "chunks", 120)
    phrase = F.substring("text", 101, 40)
    return cut.select("doc_id", C.spans_a_boundary(F.col("chunks"), phrase).alias("inside"))


# --- vectors ---------------------------------------------------------------

UNIT = """
unit AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(e, lambda x: CAST(x / greatest(sqrt(list_dot_product(e, e)), 1e-12) AS FLOAT))::DOUBLE[] AS v
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
)"""
CENTRES = """
asked AS MATERIALIZED (
  SELECT query_id, list_transform(q, lambda x: x / greatest(sqrt(list_dot_product(q, q)), 1e-12)) AS q
  FROM (SELECT label AS query_id, list(m ORDER BY axis) AS q FROM (
    SELECT label, axis, avg(x) AS m FROM (
      SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS axis FROM embeddings)
    GROUP BY ALL) GROUP BY label)
)"""
NEAREST = """
near AS MATERIALIZED (
  SELECT query_id, id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank
  FROM (SELECT query_id, id, list_dot_product(q, v) AS s FROM asked CROSS JOIN unit)
)"""
EVERY = "asked AS (SELECT id AS query_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS q FROM unit)"


def _store(spark, sf_dir):
    return dense.VectorStore(64).add(tables.vectors(spark, sf_dir), "label")


def _centres(spark, sf_dir):
    """One query per label: the mean vector of its members, axis by axis."""
    rows = tables.vectors(spark, sf_dir)
    means = [F.avg(F.get("vector", F.lit(axis)).cast("double")) for axis in range(64)]
    return rows.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.array(*means).alias("vector")
    )


@query(S.with_(UNIT, CENTRES, NEAREST) + "SELECT query_id, id, rank, round(score, 6) AS score FROM near WHERE rank <= 10")
def knn_exact(spark, sf_dir):
    return _hits(_store(spark, sf_dir).search(_centres(spark, sf_dir), 10), "id")


@query(S.with_(UNIT, EVERY, NEAREST) + "SELECT query_id, id, rank, round(score, 6) AS score FROM near WHERE rank <= 5")
def knn_batch(spark, sf_dir):
    """Every vector asks for its nearest neighbours."""
    store = _store(spark, sf_dir)
    asked = store.rows.select(F.col("id").alias("query_id"), "vector")
    return _hits(store.search_batch(asked, 5), "id")


@query(S.with_(UNIT, CENTRES, NEAREST) + "SELECT query_id, id, rank, round(score, 6) AS score FROM near WHERE rank <= 10")
def knn_naive(spark, sf_dir):
    """The same neighbours, coordinate by coordinate."""
    return _hits(_store(spark, sf_dir).search_naive(_centres(spark, sf_dir), 10), "id")


@query(
    S.with_(UNIT, CENTRES, NEAREST)
    + """SELECT CAST(query_id AS BIGINT) AS query_id, round(avg(CASE WHEN label = query_id THEN 1 ELSE 0 END), 6) AS purity
    FROM near JOIN unit USING (id) WHERE rank <= 10 GROUP BY query_id"""
)
def knn_by_label(spark, sf_dir):
    """Share of each centre's neighbours that carry its label."""
    found = _store(spark, sf_dir).search(_centres(spark, sf_dir), 10, payload=("label",))
    same = (F.col("label") == F.col("query_id")).cast("int")
    return rounded(found.groupBy("query_id").agg(F.avg(same).alias("purity")), "purity")


@query("SELECT CAST(sum(len(embedding)) * 4 AS BIGINT) AS bytes FROM embeddings")
def vector_memory(spark, sf_dir):
    return _store(spark, sf_dir).memory_bytes()


LISTS, ROUNDS = 8, 4


def _kmeans_sql():
    """Lloyd's rounds unrolled; every cluster keeps members on the given data."""
    scaled = "list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12))"
    parts = [
        UNIT,
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(id || ':0'), id) - 1 AS list_id, v AS c
        FROM unit QUALIFY list_id < {LISTS})""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT id, v, arg_min(list_id, (-s, list_id)) AS list_id
            FROM (SELECT id, v, list_id, list_dot_product(v, c) AS s FROM unit CROSS JOIN c{i}) GROUP BY id, v)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT list_id, {scaled} AS c FROM (
                SELECT list_id, list(m ORDER BY axis) AS c FROM (
                  SELECT list_id, axis, avg(x) AS m FROM (
                    SELECT list_id, unnest(v) AS x, generate_subscripts(v, 1) AS axis FROM a{i}) GROUP BY ALL)
                GROUP BY list_id))"""
            )
    return parts


def _ivf(spark, sf_dir):
    index = IVFIndex(64, LISTS).fit(tables.vectors(spark, sf_dir), iterations=ROUNDS)
    hold(index.rows)
    return index


@query(
    S.with_(*_kmeans_sql()) + f"SELECT list_id, count(*) AS members FROM a{ROUNDS} GROUP BY list_id"
)
def kmeans_lists(spark, sf_dir):
    return _ivf(spark, sf_dir).list_sizes()


@query(S.with_(UNIT, CENTRES, NEAREST) + "SELECT query_id, id, rank, round(score, 6) AS score FROM near WHERE rank <= 10")
def ivf_probe_all(spark, sf_dir):
    """Probing every list is exact search."""
    index = _ivf(spark, sf_dir)
    return _hits(index.search(_centres(spark, sf_dir), 10, n_probe=LISTS), "id")


PROBES = 2
PROBED = (
    *_kmeans_sql(), CENTRES, NEAREST,
    f"""probe AS (SELECT query_id, list_id, row_number() OVER (
      PARTITION BY query_id ORDER BY round(list_dot_product(q, c), 9) DESC, list_id) AS p FROM asked CROSS JOIN c{ROUNDS}),
    probed AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY near.rank) AS rank
      FROM probe JOIN a{ROUNDS} USING (list_id) JOIN near USING (query_id, id) WHERE p <= {PROBES})""",
)


@query(S.with_(*PROBED) + "SELECT query_id, id, rank, round(score, 6) AS score FROM probed WHERE rank <= 10")
def ivf_stored_search(spark, sf_dir):
    """The nearest lists of an index laid out in segments; other lists are not read."""
    path = f"{use_checkpoints(spark)}/ivf-{uuid.uuid4().hex}"
    _ivf(spark, sf_dir).write(path, segment_bytes=1 << 14)
    stored = IVFIndex(64, LISTS).read(spark, path)
    return _hits(stored.search(_centres(spark, sf_dir), 10, n_probe=PROBES), "id")


@query(S.with_(*PROBED) + "SELECT query_id, id, rank, round(score, 6) AS score FROM probed WHERE rank <= 10")
def ivf_gathered(spark, sf_dir):
    """The same from joining the queries to the segments of their lists."""
    return _hits(_ivf(spark, sf_dir).search_gathered(_centres(spark, sf_dir), 10, PROBES), "id")


@query(
    S.with_(*PROBED)
    + f"SELECT query_id, count(*) AS scanned FROM probe JOIN a{ROUNDS} USING (list_id) WHERE p <= {PROBES} GROUP BY query_id"
)
def ivf_scanned(spark, sf_dir):
    """How many vectors such a search scores."""
    return _ivf(spark, sf_dir).vectors_scanned(_centres(spark, sf_dir), PROBES)


DIAL = (1, 2, 4, 8)


@query(
    S.with_(
        *_kmeans_sql(), CENTRES, NEAREST,
        f"""probe AS (SELECT query_id, list_id, row_number() OVER (
          PARTITION BY query_id ORDER BY round(list_dot_product(q, c), 9) DESC, list_id) AS p FROM asked CROSS JOIN c{ROUNDS}),
        dial AS (SELECT unnest({list(DIAL)}) AS n_probe),
        cand AS (SELECT n_probe, query_id, id FROM dial JOIN probe ON p <= n_probe JOIN a{ROUNDS} USING (list_id)),
        hit AS (SELECT n_probe, query_id, id FROM (
          SELECT n_probe, query_id, id, row_number() OVER (PARTITION BY n_probe, query_id ORDER BY near.rank) AS r
          FROM cand JOIN near USING (query_id, id)) WHERE r <= 10),
        truth AS (SELECT n_probe, query_id, id FROM near CROSS JOIN dial WHERE rank <= 10),
        rec AS (SELECT n_probe, query_id, avg(CASE WHEN hit.id IS NULL THEN 0 ELSE 1 END) AS recall
          FROM truth LEFT JOIN hit USING (n_probe, query_id, id) GROUP BY ALL),
        work AS (SELECT n_probe, query_id, count(*) AS scanned FROM cand GROUP BY ALL)""",
    )
    + """SELECT n_probe, round(avg(recall), 6) AS recall, round(avg(scanned), 6) AS scanned
    FROM rec JOIN work USING (n_probe, query_id) GROUP BY n_probe"""
)
def ivf_recall_curve(spark, sf_dir):
    asked = hold(_centres(spark, sf_dir))
    curve = recall_curve(_store(spark, sf_dir), _ivf(spark, sf_dir), asked, 10, DIAL)
    return rounded(curve, "recall", "scanned")


LINKS, BEAM = 6, 32
EDGES = (
    UNIT,
    f"""forward AS MATERIALIZED (SELECT src, dst FROM (
      SELECT a.id AS src, b.id AS dst, row_number() OVER (
        PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v)), 1e-12), 9) DESC, b.id) AS r
      FROM unit a JOIN unit b ON b.id < a.id) WHERE r <= {LINKS}),
    own AS (SELECT src, count(*) AS n FROM forward GROUP BY src),
    back AS (SELECT dst AS src, f.src AS dst, row_number() OVER (PARTITION BY dst ORDER BY f.src) AS r FROM forward f),
    edges AS MATERIALIZED (
      SELECT src, dst FROM forward UNION ALL
      SELECT back.src, back.dst FROM back LEFT JOIN own USING (src) WHERE r <= {2 * LINKS} - coalesce(n, 0))""",
)
#: The walk: the best open node is expanded until it is worse than a full beam.
WALK = (
    *EDGES, CENTRES,
    "adjacent AS MATERIALIZED (SELECT src, list_sort(list(DISTINCT dst)) AS links FROM edges GROUP BY src)",
    """scored AS MATERIALIZED (
      SELECT query_id, list({'score': round(list_dot_product(q, v), 9), 'node': id} ORDER BY id) AS s, list(id ORDER BY id) AS ids
      FROM asked CROSS JOIN unit GROUP BY query_id)""",
    f"""walk AS (
      SELECT query_id, 0 AS step, [ids[1]] AS visited, [s[1]] AS frontier, [s[1]] AS best FROM scored
      UNION ALL
      SELECT query_id, step + 1, visited || list_transform(fresh, lambda x: x.node),
             list_filter(frontier, lambda x: x.node <> top.node) || fresh, list_reverse_sort(best || fresh)[1:{BEAM}]
      FROM (
        SELECT w.*, list_transform(list_filter(links, lambda n: NOT list_contains(visited, n)), lambda n: s[list_position(ids, n)]) AS fresh
        FROM (SELECT *, list_reverse_sort(frontier)[1] AS top FROM walk WHERE len(frontier) > 0) w
        JOIN scored USING (query_id) JOIN adjacent ON src = top.node
        WHERE len(best) < {BEAM} OR top.score >= best[len(best)].score))""",
    """walked AS (SELECT query_id, arg_max(visited, step) AS visited, arg_max(best, step) AS best FROM walk GROUP BY query_id)""",
)


@query(S.with_(*EDGES) + "SELECT src, dst FROM edges")
def nsw_edges(spark, sf_dir):
    return NSWIndex(64, m=LINKS).fit(tables.vectors(spark, sf_dir)).edges


@query(
    S.with_(*WALK)
    + """SELECT query_id, i AS rank, best[i].node AS id, round(best[i].score, 6) AS score
    FROM (SELECT query_id, best, unnest(range(1, least(len(best), 10) + 1)) AS i FROM walked)"""
)
def nsw_search(spark, sf_dir):
    index = NSWIndex(64, m=LINKS).fit(tables.vectors(spark, sf_dir))
    return _hits(index.search(_centres(spark, sf_dir), 10, ef=BEAM), "id")


@query(S.with_(*WALK) + "SELECT query_id, len(visited) AS scanned FROM walked")
def nsw_scanned(spark, sf_dir):
    """How many vectors a walk scores."""
    index = NSWIndex(64, m=LINKS).fit(tables.vectors(spark, sf_dir))
    return index.vectors_scanned(_centres(spark, sf_dir), ef=BEAM)


@query(S.with_(*BASE, S.dense()) + f"SELECT {HITS} FROM dense WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return _hits(dense.DenseIndex(chunks(spark, sf_dir)).search(questions(spark, sf_dir), 10))


@query(
    S.with_(*BASE, S.dense(), S.budgeted("dense", 900)) + f"SELECT {HITS} FROM packed"
)
def dense_budget(spark, sf_dir):
    index = dense.DenseIndex(chunks(spark, sf_dir))
    return _hits(index.search_within_budget(questions(spark, sf_dir), 900))


@query(
    S.with_(
        *BASE, S.dense(), S.budgeted("dense", 900),
        f"found AS (SELECT query_id, max(rel) AS rel, sum(length(text)) AS context FROM {S.judged('packed', 10**9)} GROUP BY query_id)",
    )
    + """SELECT round(avg(coalesce(rel, 0)), 6) AS hit, round(avg(coalesce(context, 0)), 6) AS context
    FROM questions LEFT JOIN found USING (query_id)"""
)
def evaluate_dense(spark, sf_dir):
    index = dense.DenseIndex(chunks(spark, sf_dir))
    return rounded(E.evaluate_dense(index, questions(spark, sf_dir), 900), "hit", "context")


@query(
    S.with_(S.DOCS, S.fixed_chunks("docs", 2500))
    + f"SELECT position, len({S.tokens('text')}) AS tokens FROM chunks WHERE len({S.tokens('text')}) > 256"
)
def truncated_chunks(spark, sf_dir):
    from ..operators.chunking import build_index

    return dense.DenseIndex(build_index(documents(spark, sf_dir), 2500, "fixed")).truncated_chunks()
