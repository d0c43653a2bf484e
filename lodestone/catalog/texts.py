"""Queries over documents: chunking, measuring, citing, structured text."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..operators import chunking as C
from ..operators import citations, evalsets, structured
from ..sources import tables
from . import sql as S
from .base import documents, hold, mixed_chunks, query, rounded

SPAN = "doc_id, chunk_index, s AS begin_at, e AS end_at, text"


def _spans(chunks):
    return chunks.select(
        "doc_id", "chunk_index", F.col("start").alias("begin_at"), F.col("end").alias("end_at"), "text"
    )


@query(S.with_(S.DOCS, S.fixed_chunks("docs", 200)) + f"SELECT {SPAN} FROM chunks")
def chunk_fixed(spark, sf_dir):
    return _spans(C.chunk_documents(documents(spark, sf_dir), 200))


@query(S.with_(S.DOCS, S.fixed_chunks("docs", 200, 50)) + f"SELECT {SPAN} FROM chunks")
def chunk_fixed_overlap(spark, sf_dir):
    return _spans(C.chunk_documents(documents(spark, sf_dir), 200, 50))


@query(S.with_(S.DOCS, S.sentence_chunks("docs", 200)) + f"SELECT {SPAN} FROM chunks")
def chunk_sentences(spark, sf_dir):
    return _spans(C.chunk_documents(documents(spark, sf_dir), 200, strategy="sentence"))


@query(
    S.with_(S.DOCS, S.sentences("docs"))
    + """SELECT doc_id, n - 1 AS sentence_index, s AS begin_at, e AS end_at,
    substring(text, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)) AS text
    FROM sent JOIN docs USING (doc_id)"""
)
def sentence_split(spark, sf_dir):
    rows = C.split_sentences(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "sentence_index", F.col("start").alias("begin_at"), F.col("end").alias("end_at"), "text"
    )


def _abbreviated(text):
    """Text in which every comma ends an abbreviation, so that the guard has work."""
    return F.replace(text, F.lit(","), F.lit(" approx."))


@query(
    S.with_(
        "docs AS (SELECT doc_id, replace(text, ',', ' approx.') AS text FROM documents)",
        S.sentences("docs"),
        f"""flags AS (
  SELECT doc_id, n, s, e, CASE WHEN regexp_extract(lower(lag(t) OVER w), '[^{S.SPACE_CLASS}]+$') IN
      ({', '.join(S.q(a) for a in C.ABBREVIATIONS)}) THEN 0 ELSE 1 END AS opens
  FROM (SELECT *, substring(text, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)) AS t
        FROM sent JOIN docs USING (doc_id)) WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM flags)""",
    )
    + """SELECT doc_id, CAST(island - 1 AS BIGINT) AS sentence_index, min(s) AS begin_at, max(e) AS end_at,
    any_value(substring(text, CAST(a + 1 AS INTEGER), CAST(b - a AS INTEGER))) AS text
    FROM islands JOIN docs USING (doc_id)
    JOIN (SELECT doc_id, island, min(s) AS a, max(e) AS b FROM islands GROUP BY ALL) USING (doc_id, island)
    GROUP BY doc_id, island"""
)
def sentence_split_guarded(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("text", _abbreviated(F.col("text")))
    rows = C.split_sentences(docs, guarded=True)
    return rows.select(
        "doc_id", "sentence_index", F.col("start").alias("begin_at"), F.col("end").alias("end_at"), "text"
    )


@query(
    S.with_(
        S.DOCS,
        S.fixed_chunks("docs", 200, 50, "fc"),
        S.sentence_chunks("docs", 200, "sc"),
        """cover AS (
  SELECT doc_id, sum(greatest(0, e - greatest(s, reach))) AS covered, sum(e - s) AS total, count(*) AS n
  FROM (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY chunk_index
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM fc) GROUP BY doc_id)""",
        "scov AS (SELECT doc_id, sum(e - s) AS total, count(*) AS n FROM sc GROUP BY doc_id)",
        "ns AS (SELECT doc_id, count(*) AS n FROM sc_sent GROUP BY doc_id)",
    )
    + """SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 1.0 ELSE coalesce(cover.covered, 0) / length(text) END, 6) AS coverage,
    round(CASE WHEN length(text) = 0 THEN 0.0 ELSE coalesce(cover.total, 0) / length(text) END, 6) AS duplication,
    round(CASE WHEN length(text) = 0 THEN 1.0 ELSE coalesce(scov.total, 0) / length(text) END, 6) AS sentence_coverage,
    round(coalesce(scov.total, 0) / nullif(length(text), 0), 6) AS index_growth,
    round(CASE WHEN coalesce(ns.n, 0) = 0 THEN 0.0 ELSE length(text) / ns.n END, 6) AS density,
    round(CASE WHEN coalesce(scov.n, 0) = 0 THEN 0.0 ELSE ns.n / scov.n END, 6) AS facts_per_chunk
    FROM docs LEFT JOIN cover USING (doc_id) LEFT JOIN scov USING (doc_id) LEFT JOIN ns USING (doc_id)"""
)
def chunk_measures(spark, sf_dir):
    frame = documents(spark, sf_dir).select("doc_id", "text")
    frame = C.with_fixed_chunks(frame, "text", "f", 200, 50)
    frame = C.with_sentence_chunks(frame, "text", "c", 200)
    frame = C.with_sentences(frame, "text", "s")
    n = F.length("text")
    table = frame.select(
        "doc_id",
        C.coverage(n, F.col("f")).alias("coverage"),
        C.duplication(n, F.col("f")).alias("duplication"),
        C.coverage(n, F.col("c")).alias("sentence_coverage"),
        C.index_growth(n, F.col("c")).alias("index_growth"),
        C.density(n, F.col("s")).alias("density"),
        C.facts_per_chunk(F.col("s"), F.col("c")).alias("facts_per_chunk"),
    )
    return rounded(table, *table.columns[1:])


# --- decomposed text -------------------------------------------------------


def _decomposed(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.withColumn("text", U.normalized(F.col("text"), "NFD"))


@query(f"SELECT doc_id, length(text) - length({S.nfd('text')}) AS drift FROM documents")
def offset_drift(spark, sf_dir):
    """How far NFC shortens the documents stored decomposed."""
    return _decomposed(spark, sf_dir).select("doc_id", U.offset_drift(F.col("text")).alias("drift"))


MARKED = "[^" + "".join(
    chr(code) for code in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(code))) == 2
) + "]"


@query(
    S.with_(S.DOCS, S.fixed_chunks("docs", 200))
    + f"""SELECT doc_id, chunk_index, CAST(s + sum(marks) OVER w - marks AS BIGINT) AS begin_at,
    CAST(e + sum(marks) OVER w AS BIGINT) AS end_at, text
    FROM (SELECT *, length(regexp_replace(text, '{MARKED}', '', 'g')) AS marks FROM chunks)
    WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)"""
)
def chunk_decomposed(spark, sf_dir):
    """Chunks of decomposed text: NFC text, raw offsets."""
    return _spans(C.chunk_documents(_decomposed(spark, sf_dir), 200))


@query(
    S.with_(
        f"docs AS (SELECT doc_id, text, lang, {S.nfd('text')} AS raw FROM documents)",
        S.fixed_chunks("docs", 200),
    )
    + """SELECT lang, count(*) AS chunks, count(*) AS mapped_verified,
    count(*) FILTER (WHERE nfc_normalize(substring(raw, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER))) = c.text) AS unmapped_verified
    FROM chunks c JOIN docs d USING (doc_id) GROUP BY lang"""
)
def citation_verify(spark, sf_dir):
    """Citations that verify with mapped offsets, and with offsets left unmapped."""
    docs = hold(_decomposed(spark, sf_dir))
    parts = []
    for name, mapped in (("mapped_verified", True), ("unmapped_verified", False)):
        checked = citations.verify(C.chunk_documents(docs, 200, mapped=mapped), docs)
        parts.append(
            checked.groupBy(F.col("metadata").getItem("lang").alias("lang")).agg(
                F.count(F.lit(1)).alias("chunks"), F.count_if("verified").alias(name)
            )
        )
    return parts[0].join(parts[1].drop("chunks"), "lang")


@query(
    S.with_(
        "docs AS (SELECT doc_id, text, source FROM documents)", S.sentence_chunks("docs", 200)
    )
    + f"""SELECT doc_id, chunk_index,
    length(before) - length(replace(before, chr(10), '')) + 1 AS line,
    length(regexp_extract(before, '[^\n]*$')) + 1 AS column_at,
    CASE WHEN length(text) > 60 THEN rtrim(substring(text, 1, 60), {S.WS}) || '...' ELSE text END AS quote,
    'Document ' || doc_id AS title, source || '/' || doc_id AS uri
    FROM (SELECT c.doc_id, chunk_index, c.text, source, substring(d.text, 1, CAST(s AS INTEGER)) AS before
          FROM chunks c JOIN docs d USING (doc_id))"""
)
def citation_build(spark, sf_dir):
    cited = citations.cited_chunks(documents(spark, sf_dir), 200)
    return cited.select(
        "doc_id", "chunk_index", "citation.line", F.col("citation.column").alias("column_at"),
        "citation.quote", "citation.title", "citation.uri",
    )


# --- structured text derived from documents --------------------------------


def _lines_table(spark, sf_dir):
    """Every document as a markdown table of its line lengths."""
    row = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.lit("| "), (i + 1).cast("string"), F.lit(" | "), F.length(line).cast("string"), F.lit(" |")
        ),
    )
    head = F.lit("| line | characters |\n| --- | ---: |\n")
    return documents(spark, sf_dir).select(
        "doc_id", F.concat(head, F.array_join(row, "\n")).alias("text")
    )


LINES_TABLE = r"""
docs AS (
  SELECT doc_id, '| line | characters |' || chr(10) || '| --- | ---: |' || chr(10) || string_agg(r, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, i, '| ' || i || ' | ' || length(line) || ' |' AS r
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
  GROUP BY doc_id
), trows AS (
  SELECT doc_id, i - 3 AS i, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS BIGINT) AS o
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)
), tchunks AS (
  SELECT doc_id, i // 4 AS chunk_index, min(o) AS s, max(o + length(line)) AS e,
         '| line | characters |' || chr(10) || '| --- | ---: |' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text
  FROM trows WHERE i >= 0 GROUP BY doc_id, i // 4
)"""


@query(S.with_(LINES_TABLE) + f"SELECT {SPAN} FROM tchunks")
def table_chunks(spark, sf_dir):
    frame = structured.with_table_chunks(_lines_table(spark, sf_dir), "text", "c", 4)
    rows = frame.select("doc_id", F.inline_outer("c"))
    return _spans(rows)


@query(
    S.with_(LINES_TABLE, S.fixed_chunks("docs", 120, 0, "fixed"))
    + """SELECT doc_id, round(t.kept, 6) AS table_retention, round(f.kept, 6) AS fixed_retention,
    round(t.total / length(text), 6) AS table_growth, round(f.total / length(text), 6) AS fixed_growth
    FROM docs JOIN (SELECT doc_id, avg(CAST(contains(text, '| line | characters |') AS INT)) AS kept, sum(length(text)) AS total
                    FROM tchunks GROUP BY doc_id) t USING (doc_id)
    JOIN (SELECT doc_id, avg(CAST(contains(text, '| line | characters |') AS INT)) AS kept, sum(length(text)) AS total
          FROM fixed GROUP BY doc_id) f USING (doc_id)"""
)
def header_retention(spark, sf_dir):
    frame = structured.with_table_chunks(_lines_table(spark, sf_dir), "text", "t", 4)
    frame = C.with_fixed_chunks(frame, "text", "f", 120)
    n, header = F.length("text"), F.lit("| line | characters |")
    table = frame.select(
        "doc_id",
        C.header_retention(F.col("t"), header).alias("table_retention"),
        C.header_retention(F.col("f"), header).alias("fixed_retention"),
        C.index_growth(n, F.col("t")).alias("table_growth"),
        C.index_growth(n, F.col("f")).alias("fixed_growth"),
    )
    return rounded(table, *table.columns[1:])


def _as_source(spark, sf_dir):
    """Every document as Python source with one statement per line of text."""
    statement = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(
            i % 2 == 0, F.concat(F.lit("line_"), i.cast("string"), F.lit(" = "), F.length(line).cast("string"), F.lit("\n"))
        ).otherwise(
            F.concat(
                F.lit("@cached\ndef line_"), i.cast("string"), F.lit("():\n    return "),
                F.length(line).cast("string"), F.lit("\n"),
            )
        ),
    )
    return documents(spark, sf_dir).select("doc_id", F.array_join(statement, "").alias("text"))


@query(
    """WITH parts AS (
  SELECT doc_id, i - 1 AS chunk_index, CASE WHEN (i - 1) % 2 = 0
      THEN 'line_' || (i - 1) || ' = ' || length(line) || chr(10)
      ELSE '@cached' || chr(10) || 'def line_' || (i - 1) || '():' || chr(10) || '    return ' || length(line) || chr(10) END AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
SELECT doc_id, chunk_index, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS begin_at,
  CAST(sum(length(text)) OVER w AS BIGINT) AS end_at, text
FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)"""
)
def python_chunks(spark, sf_dir):
    frame = _as_source(spark, sf_dir).select(
        "doc_id", structured.python_chunks(F.col("text")).alias("c")
    )
    return _spans(frame.select("doc_id", F.inline_outer("c")))


@query()
def parses_as_python(spark, sf_dir):
    """Source chunks that still parse: cut by statement, and cut every 60 characters."""
    source = hold(_as_source(spark, sf_dir))
    pieces = {
        "statement": source.withColumn("c", structured.python_chunks(F.col("text"))),
        "fixed": C.with_fixed_chunks(source, "text", "c", 60),
    }
    rows = [
        frame.select(F.inline_outer("c")).agg(
            F.lit(name).alias("strategy"),
            F.count(F.lit(1)).alias("chunks"),
            F.count_if(structured.parses_as_python(F.col("text"))).alias("parses"),
        )
        for name, frame in pieces.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


# --- metadata, unions, tokens ----------------------------------------------


@query(
    S.with_(S.DOCS, S.sentence_chunks("docs", 200))
    + """SELECT lang, source, count(*) AS chunks, CAST(sum(length(c.text)) AS BIGINT) AS characters
    FROM chunks c JOIN docs USING (doc_id) WHERE lang = 'fr' AND source IN ('src1', 'src4', 'src8')
    GROUP BY lang, source"""
)
def metadata_select(spark, sf_dir):
    picked = C.select(
        C.build_index(documents(spark, sf_dir), 200), lang="fr", source=["src1", "src4", "src8"], absent=None
    )
    keys = [F.col("metadata").getItem(name).alias(name) for name in ("lang", "source")]
    return picked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("characters")
    )


@query(
    S.with_(
        S.DOCS,
        "turns AS (SELECT conv_id * 4096 + turn AS doc_id, text FROM conversations)",
        S.sentence_chunks("docs", 200, "a"),
        S.sentence_chunks("turns", 200, "b"),
        "pool AS (SELECT 'documents' AS kind, text FROM a UNION ALL SELECT 'conversations', text FROM b)",
    )
    + """SELECT kind, count(*) AS chunks, round(stddev_pop(length(text)) / avg(length(text)), 6) AS cv
    FROM pool GROUP BY kind UNION ALL
    SELECT 'all', count(*), round(stddev_pop(length(text)) / avg(length(text)), 6) FROM pool"""
)
def mixed_sources(spark, sf_dir):
    """One index over documents and conversation turns, and its length spread."""
    mixed = mixed_chunks(spark, sf_dir, 200)
    n = F.length("text")
    table = mixed.rollup(F.col("metadata").getItem("kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("chunks"), (F.stddev_pop(n) / F.avg(n)).alias("cv")
    )
    return rounded(table.withColumn("kind", F.coalesce("kind", F.lit("all"))), "cv")


@query(
    f"""SELECT doc_id, len(ts) AS tokens, len(list_distinct(ts)) AS distinct_tokens
    FROM (SELECT doc_id, {S.tokens('text')} AS ts FROM documents)"""
)
def tokenize_counts(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return words.select(
        "doc_id", F.size("ts").alias("tokens"), F.size(F.array_distinct("ts")).alias("distinct_tokens")
    )


@query(
    S.with_(S.DOCS, S.sentences("docs"))
    + f"""SELECT doc_id, n - 1 AS sentence_index,
    {S.normalized('substring(text, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER))')} AS answer
    FROM sent JOIN docs USING (doc_id)"""
)
def normalize_answer(spark, sf_dir):
    rows = C.split_sentences(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "sentence_index", T.normalize_answer(F.col("text")).alias("answer")
    )


# --- evaluation sets -------------------------------------------------------


@query(
    f"""SELECT doc_id, i - 1 AS line, s AS query, s AS answer FROM (
    SELECT doc_id, i, trim(line, {S.WS}) AS s FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
    WHERE length(s) >= 30"""
)
def known_item(spark, sf_dir):
    return evalsets.known_item_questions(documents(spark, sf_dir))


def _order_notes(spark, sf_dir):
    """A short note per order, as policy prose with amounts, days and times."""
    orders = tables.spread(tables.table(spark, sf_dir, "orders"), "o_orderkey")
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    text = F.concat(
        F.lit("Order "), key.cast("string"), F.lit(" costs "), cents.cast("string"),
        F.lit(" won and ships within "), (key % 9 + 1).cast("string"), F.lit(" days.\n"),
        F.lit("Pickup opens at "), (key % 14 + 8).cast("string"), F.lit(":30, or on 5 May.\n"),
        F.lit("Nothing else is known."),
    )
    return orders.select(
        key.alias("doc_id"), key.alias("doc_order"), text.alias("text")
    )


NOTES = """
notes AS (
  SELECT o_orderkey AS doc_id, 0 AS line, 'Order ' || o_orderkey || ' costs ' || c || ' won and ships within ' || (o_orderkey % 9 + 1) || ' days.' AS s,
         [c || ' won', (o_orderkey % 9 + 1) || ' days'] AS facts
  FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
  UNION ALL
  SELECT o_orderkey, 1, 'Pickup opens at ' || (o_orderkey % 14 + 8) || ':30, or on 5 May.',
         [(o_orderkey % 14 + 8) || ':30', '5 May'] FROM orders
)"""


@query(
    S.with_(NOTES)
    + """SELECT doc_id, line, regexp_replace(replace(s, facts[1], '____'), '\\.+$', '') AS query, facts[1] AS answer FROM notes"""
)
def cloze(spark, sf_dir):
    return evalsets.cloze_questions(_order_notes(spark, sf_dir))


@query(S.with_(NOTES) + "SELECT fact, count(*) AS notes FROM (SELECT unnest(facts) AS fact FROM notes) GROUP BY fact")
def extract_facts(spark, sf_dir):
    found = _order_notes(spark, sf_dir).select(F.explode(T.facts(F.col("text"))).alias("fact"))
    return found.groupBy("fact").agg(F.count(F.lit(1)).alias("notes"))
