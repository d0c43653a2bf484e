"""Oracle SQL fragments for DuckDB, written independently of the Spark plans."""

from __future__ import annotations

import unicodedata

from ..functions.text import FACT, SENTENCE_END, SPACE_CHARS, SPACE_CLASS, TOKEN

WS = "'" + SPACE_CHARS + "'"
SHIFT = 1 << 24


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def nfd(column: str) -> str:
    """NFD of Latin text as nested replacements."""
    out = column
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if parts != chr(code):
            out = f"replace({out}, '{chr(code)}', '{parts}')"
    return out


def sentences(source: str, name: str = "sent") -> str:
    """CTE ``name(doc_id, n, s, e)`` of sentences of ``source(doc_id, text)``."""
    return f"""
{name}_cut AS (
  SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, {q('(?s).*?(?:' + SENTENCE_END + '|\\z)')}) AS ps FROM {source})
), {name}_off AS (
  SELECT doc_id, i, piece,
         CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS BIGINT) AS o
  FROM {name}_cut
), {name} AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n,
         o + length(piece) - length(ltrim(piece, {WS})) AS s,
         o + length(piece) - length(ltrim(piece, {WS})) + length(trim(piece, {WS})) AS e
  FROM {name}_off WHERE length(trim(piece, {WS})) > 0
)"""


def sentence_chunks(source: str, size: int, name: str = "chunks") -> str:
    """CTE ``name(doc_id, chunk_index, s, e, text, position)``; needs WITH RECURSIVE."""
    return f"""{sentences(source, name + '_sent')},
{name}_walk AS (
  SELECT doc_id, n, s AS cs, e, 0 AS c, (e - s > {size}) AS alone FROM {name}_sent WHERE n = 1
  UNION ALL
  SELECT w.doc_id, x.n,
         CASE WHEN w.alone OR x.e - w.cs > {size} THEN x.s ELSE w.cs END,
         x.e,
         CASE WHEN w.alone OR x.e - w.cs > {size} THEN w.c + 1 ELSE w.c END,
         x.e - x.s > {size}
  FROM {name}_walk w JOIN {name}_sent x ON x.doc_id = w.doc_id AND x.n = w.n + 1
), {name} AS MATERIALIZED (
  SELECT w.doc_id, w.c AS chunk_index, min(w.cs) AS s, max(w.e) AS e,
         substring(any_value(d.text), CAST(min(w.cs) + 1 AS INTEGER), CAST(max(w.e) - min(w.cs) AS INTEGER)) AS text,
         w.doc_id * {SHIFT} + w.c AS position
  FROM {name}_walk w JOIN {source} d ON d.doc_id = w.doc_id GROUP BY w.doc_id, w.c
)"""


def fixed_chunks(source: str, size: int, overlap: int = 0, name: str = "chunks") -> str:
    stride = size - overlap
    return f"""
{name} AS (
  SELECT doc_id, i AS chunk_index, i * {stride} AS s, least(i * {stride} + {size}, length(text)) AS e,
         substring(text, CAST(i * {stride} + 1 AS INTEGER), {size}) AS text, doc_id * {SHIFT} + i AS position
  FROM (SELECT doc_id, text, unnest(range(CASE
          WHEN length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1
          ELSE CAST(ceil((length(text) - {size}) / {stride}.0) AS BIGINT) + 1 END)) AS i FROM {source})
)"""


def tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), {q(TOKEN)})"


QUESTIONS = f"""
questions AS (
  SELECT item_id AS query_id, text AS query,
         trim(regexp_extract(text, {q('(?s).*?(?:' + SENTENCE_END + '|\\z)')}), {WS}) AS answer
  FROM benchmark
)"""

TERMS = f"""
toks AS MATERIALIZED (SELECT position, length(text) AS size, {tokens('text')} AS ts FROM chunks),
tf AS MATERIALIZED (
  SELECT position, term, count(*) AS tf FROM (SELECT position, unnest(ts) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
coll AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS avgdl FROM toks),
qt AS (SELECT query_id, term, count(*) AS uses
       FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM questions) GROUP BY ALL)"""


def bm25(name: str = "bm25", k1: float = 1.5, b: float = 0.75) -> str:
    """CTE ``name(query_id, position, score, rank)`` over every candidate."""
    return f"""
{name} AS MATERIALIZED (
  SELECT query_id, position, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position) AS rank
  FROM (
    SELECT qt.query_id, tf.position,
           sum(qt.uses * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * ({k1} + 1)
               / (tf.tf + {k1} * (1 - {b} + {b} * len(toks.ts) / avgdl))) AS score
    FROM qt JOIN tf ON tf.term = qt.term JOIN df ON df.term = qt.term
    JOIN toks ON toks.position = tf.position CROSS JOIN coll
    GROUP BY qt.query_id, tf.position)
)"""


def overlap(kind: str, name: str = "overlap") -> str:
    value = "count(*)" if kind == "coverage" else "sum(tf)"
    return f"""
{name} AS MATERIALIZED (
  SELECT query_id, position, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank
  FROM (
    SELECT q.query_id, c.position, CAST(coalesce(h.score, 0) AS DOUBLE) AS score
    FROM questions q CROSS JOIN (SELECT position FROM chunks) c
    LEFT JOIN (SELECT qt.query_id, tf.position, {value} AS score
               FROM qt JOIN tf ON tf.term = qt.term GROUP BY ALL) h
      ON h.query_id = q.query_id AND h.position = c.position)
)"""


def budgeted(ranking: str, budget: int, name: str = "packed") -> str:
    return f"""
{name} AS (
  SELECT query_id, position, score, rank FROM (
    SELECT r.*, sum(size) OVER (PARTITION BY query_id ORDER BY rank) AS used
    FROM {ranking} r JOIN (SELECT position, length(text) AS size FROM chunks) USING (position))
  WHERE used <= {budget} OR rank = 1
)"""


def hashed(items: str, key: str, text: str, name: str, dimension: int = 64) -> str:
    """CTE ``name(key, v)`` of unit hashed-token vectors."""
    return f"""
{name} AS MATERIALIZED (
  SELECT {key}, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM (
    SELECT {key}, list(coalesce(w, 0.0) ORDER BY axis) AS v
    FROM (SELECT {key}, unnest(range({dimension})) AS axis FROM {items})
    LEFT JOIN (
      SELECT {key}, CAST(('0x' || md5(term)[1:7]) AS BIGINT) % {dimension} AS axis,
             CAST(sum(CASE WHEN CAST(('0x' || md5(term)[8:8]) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS w
      FROM (SELECT {key}, unnest({tokens(text)}) AS term FROM {items}) GROUP BY ALL)
    USING ({key}, axis) GROUP BY {key})
)"""


def dense(name: str = "dense") -> str:
    """CTE ``name(query_id, position, score, rank)`` of hashed-token cosines."""
    return f"""
{hashed('chunks', 'position', 'text', 'cvec')},
{hashed('questions', 'query_id', 'query', 'qvec')},
{name} AS MATERIALIZED (
  SELECT query_id, position, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position) AS rank
  FROM (SELECT query_id, position, list_dot_product(qvec.v, cvec.v) AS score FROM qvec CROSS JOIN cvec)
)"""


def fused(alpha: float, depth: int = 20, name: str = "fused") -> str:
    def half(source, place, weight):
        return f"""
  SELECT query_id, position, {place} AS list, rank,
         {weight} * CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0
                         ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS part
  FROM {source} WHERE rank <= {depth} WINDOW w AS (PARTITION BY query_id)"""

    return f"""
{name} AS (
  SELECT query_id, position, score, row_number() OVER (
           PARTITION BY query_id ORDER BY round(score, 9) DESC, first_list, first_rank) AS rank
  FROM (SELECT query_id, position, sum(part) AS score, min(list) AS first_list,
               arg_min(rank, list) AS first_rank
        FROM ({half('bm25', 0, 1 - alpha)} UNION ALL {half('dense', 1, alpha)}) GROUP BY ALL)
)"""


def rrf(constant: int = 60, depth: int = 20, name: str = "rrf") -> str:
    return f"""
ordinals AS (SELECT position, row_number() OVER (ORDER BY position) - 1 AS ordinal FROM chunks),
{name} AS (
  SELECT query_id, position, score, row_number() OVER (
           PARTITION BY query_id ORDER BY round(score, 15) DESC, CAST(ordinal AS VARCHAR)) AS rank
  FROM (SELECT query_id, position, sum(1.0::DOUBLE / ({constant} + rank)) AS score
        FROM (SELECT * FROM bm25 WHERE rank <= {depth} UNION ALL SELECT * FROM dense WHERE rank <= {depth})
        GROUP BY ALL) JOIN ordinals USING (position)
)"""


def judged(ranking: str, k: int) -> str:
    """Subquery ``(query_id, position, rank, rel, text)`` of the first ``k``."""
    return f"""(
  SELECT r.query_id, r.position, r.rank, c.text, CASE WHEN contains(c.text, q.answer) THEN 1 ELSE 0 END AS rel
  FROM {ranking} r JOIN chunks c USING (position) JOIN questions q USING (query_id) WHERE r.rank <= {k})"""


def with_(*parts: str, recursive: bool = True) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n"


DOCS = "docs AS (SELECT doc_id, text, lang, source FROM documents)"
FACTS = q(FACT.replace("(?i)", ""))


ARTICLE = r"'(^|[^\p{L}\p{N}_])(?:a|an|the)([^\p{L}\p{N}_]|$)'"


def normalized(expr: str) -> str:
    """The answer normalization of an expression."""
    plain = f"trim(lower({expr}), {WS})"
    for _ in range(2):
        plain = f"regexp_replace({plain}, {ARTICLE}, '\\1 \\2', 'g')"
    plain = f"regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}_{SPACE_CLASS}:,./-]', ' ', 'g')"
    words = f"list_transform(string_split_regex({plain}, '[{SPACE_CLASS}]+'), lambda w: trim(w, '.,/-'))"
    return f"array_to_string(list_filter({words}, lambda w: w <> ''), ' ')"


def packed_context(source: str, name: str, order: str = "rank") -> str:
    """CTE ``name(query_id, context)`` from ``source(query_id, rank, text)``."""
    return f"""
{name} AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY {order}) AS context FROM {source} GROUP BY query_id)"""


def generated(source: str, name: str) -> str:
    """CTE ``name(query_id, answer_text)`` of the extractive stand-in over
    ``source(query_id, query, context)``."""
    return f"""
{name}_part AS (
  SELECT query_id, trim(part, {WS}) AS part, i, list_distinct({tokens('query')}) AS a
  FROM (SELECT query_id, query, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM (
    SELECT query_id, query, string_split(regexp_replace(context, '([.!?。！？])[{SPACE_CLASS}]+|\n+', '\\1' || chr(1), 'g'), chr(1)) AS ps
    FROM {source}))
), {name}_best AS (
  SELECT query_id, arg_min(part, (-score, i)) AS part FROM (
    SELECT *, len(list_intersect(a, list_distinct({tokens('part')}))) / greatest(len(a), 1) AS score FROM {name}_part)
  WHERE part <> '' AND score >= 0.25 GROUP BY query_id
), {name} AS MATERIALIZED (
  SELECT query_id, coalesce(part, 'not stated') AS answer_text FROM {source} LEFT JOIN {name}_best USING (query_id)
)"""


def supported(answers: str, context: str, name: str) -> str:
    """CTE ``name(query_id, position)``: first context chunk holding the answer."""
    return f"""
{name} AS (
  SELECT query_id, arg_min(position, rank) AS position FROM {context} JOIN {answers} USING (query_id)
  WHERE NOT contains(lower(answer_text), 'not stated') AND {normalized('answer_text')} <> ''
    AND contains({normalized('text')}, {normalized('answer_text')}) GROUP BY query_id
)"""
