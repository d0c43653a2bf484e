"""Lexical retrieval: overlap scorers and BM25 over chunk tables.

Chunks need ``position`` and ``text``; queries need ``query_id`` and ``query``.
Every search returns ``(query_id, rank, position, score, *payload)``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .. import session
from ..functions import text as T
from ..functions.models import token_lists
from .blocks import LEAST, ROWS_PER_STEP, Keep, select_best
from .dense import matrix_of

#: Stand-in term whose statistics are those of the whole collection.
EVERYTHING = ""
#: Scores of a caller's scorer that one row of a chunk holds, about.
SCORES_PER_ROW = 512
#: What stands for a score that is not a number; LEAST stands for none.
MOST = -LEAST
#: A term of so many queries of a block is a column of a matrix product; the weights
#: of the others are added up one by one.
WIDE_QUERIES = 8


class TermWeights:
    """What each query gives for a term, from ``(term, query, weight)`` triples."""

    def __init__(self, term: np.ndarray, query: np.ndarray, weight: np.ndarray, terms: int, queries: int):
        # The queries of a term lie together; terms of many queries are rows of a matrix.
        order = np.argsort(term, kind="stable")
        self.sizes = np.bincount(term, minlength=terms)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.query, self.weight = query[order], weight[order]
        wide = np.flatnonzero(self.sizes >= WIDE_QUERIES)
        self.seat = np.full(terms, -1)
        self.seat[wide] = np.arange(len(wide))
        self.matrix = np.zeros((len(wide), queries))
        entries = np.repeat(self.seat, self.sizes)
        inside = entries >= 0
        np.add.at(self.matrix, (entries[inside], self.query[inside]), self.weight[inside])

    def sums(self, rows: int, row: np.ndarray, term: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Weighted sums (rows x queries) of cells ``(row, term, value)``, each given once."""
        queries = self.matrix.shape[1]
        wide = self.seat[term] >= 0
        present = np.zeros((rows, len(self.matrix)))
        present[row[wide], self.seat[term[wide]]] = values[wide]
        row, term, values = row[~wide], term[~wide], values[~wide]
        each = self.sizes[term]
        picked = np.repeat(self.begins[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        parts = np.repeat(values, each) * self.weight[picked]
        sums = np.bincount(np.repeat(row, each) * queries + self.query[picked], parts, rows * queries)
        return present @ self.matrix + sums.reshape(rows, queries)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _cells(lists: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, term, count)`` of the terms that lists hold, each once."""
    terms = max(len(vocabulary), 1)
    place = pc.index_in(lists.flatten(), vocabulary)
    known = place.is_valid().to_numpy(zero_copy_only=False)
    column = place.drop_null().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), _sizes(lists))[known]
    cells, counts = np.unique(row * terms + column, return_counts=True)
    return *np.divmod(cells, terms), counts


class TermKernel:
    """Scores texts, or token lists of the caller's tokenizer, against weighted query
    terms. Texts are cut into tokens where they are scored."""

    def __init__(self, weigh: str, k1: float = 1.5, b: float = 0.75, tokenizer=T.tokens):
        self.weigh, self.k1, self.b = weigh, k1, b
        self.columns = ("text",) if tokenizer is T.tokens else ("tokens",)

    def prepare(self, block: pa.Table):
        terms = block.column("terms").combine_chunks()
        flat = terms.flatten()
        words, uses = flat.field("term"), flat.field("uses").to_numpy(zero_copy_only=False)
        owner = np.repeat(
            np.arange(len(terms)), np.diff(terms.offsets.to_numpy(zero_copy_only=False))
        )
        vocabulary = pc.unique(words)
        column = pc.index_in(words, vocabulary).to_numpy(zero_copy_only=False)
        if self.weigh == "bm25":
            df = flat.field("df").to_numpy(zero_copy_only=False).astype(float)
            everything = np.array([w == EVERYTHING for w in words.to_pylist()])
            total = df[everything][0]
            if not total:
                raise ValueError("cannot search an index over no chunks")
            mean = flat.field("dl").to_numpy(zero_copy_only=False).astype(float)[everything][0] / total
            weight = uses * np.log1p((total - df + 0.5) / (df + 0.5))
            weight[everything] = 0.0
        else:
            mean, weight = None, np.ones(len(flat))
        return vocabulary, TermWeights(column, owner, weight, len(vocabulary), len(terms)), mean

    def load(self, batch: pa.Table) -> pa.ListArray:
        if self.columns == ("text",):
            return token_lists(batch.column("text"))
        tokens = batch.column("tokens").combine_chunks()
        return pa.concat_arrays(tokens.chunks) if isinstance(tokens, pa.ChunkedArray) else tokens

    def score(self, state, tokens: pa.ListArray) -> np.ndarray:
        vocabulary, weighed, mean = state
        # Only the terms a row holds are weighed.
        row, column, counts = _cells(tokens, vocabulary)
        if self.weigh == "coverage":
            weights = np.ones(len(counts))
        elif self.weigh == "bm25":
            lengths = _sizes(tokens)
            damping = self.k1 * (1 - self.b + self.b * (lengths / mean))
            weights = counts * (self.k1 + 1) / (counts + damping[row])
        else:
            weights = counts.astype(float)
        return weighed.sums(len(tokens), row, column, weights)


def _scored_items(chunks: DataFrame, tokenizer) -> DataFrame:
    return chunks.withColumn("tokens", tokenizer(F.col("text"))).withColumn(
        "size", F.length("text")
    )


def _counted(tokens: Column) -> Column:
    """Distinct terms of a list with how often it holds them."""

    def runs(ordered: Column) -> Column:
        begins = F.filter(
            F.transform(ordered, lambda t, i: F.when(~t.eqNullSafe(F.get(ordered, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return F.get(
            F.transform(
                F.array(begins),
                lambda at: F.transform(
                    at,
                    lambda p, j: F.struct(
                        F.get(ordered, p).alias("term"),
                        (F.coalesce(F.get(at, j + 1), F.size(ordered)) - p).cast("long").alias("tf"),
                    ),
                ),
            ),
            F.lit(0),
        )

    return F.get(F.transform(F.array(F.sort_array(tokens)), runs), F.lit(0))


def _term_bytes() -> Column:
    return F.aggregate(
        "terms", F.lit(64), lambda total, part: total + F.octet_length(part["term"]) + 32
    )


class Overlap:
    """Overlap scorers that rank every chunk, including those scoring zero.

    Ties go by document id, then chunk index.
    """

    def __init__(self, chunks: DataFrame, scorer: str = "coverage", tokenizer=T.tokens):
        if scorer not in ("coverage", "occurrences"):
            raise ValueError(f"unknown scorer {scorer!r}")
        self.scorer = scorer
        self.tokenizer = tokenizer
        self.items = _scored_items(chunks, tokenizer)

    def _terms(self, queries: DataFrame) -> DataFrame:
        words = F.array_distinct(self.tokenizer(F.col("query")))
        return queries.select(
            "query_id",
            F.transform(
                words, lambda w: F.struct(w.alias("term"), F.lit(1).alias("uses"))
            ).alias("terms"),
        )

    def _select(self, queries, keep, payload, **options):
        return select_best(
            self.items, self._terms(queries), TermKernel(self.scorer, tokenizer=self.tokenizer), keep,
            order=("doc_id", "chunk_index"), payload=("position", *payload), query_size=_term_bytes(), **options,
        )

    def search(self, queries, k: int = 3, payload=(), **options) -> DataFrame:
        return self._select(queries, Keep(k=k), payload, **options)

    def search_within_budget(self, queries, budget: int = 600, payload=(), **options) -> DataFrame:
        """The longest prefix of the ranking within ``budget`` characters; the
        best chunk is returned even if it alone exceeds it."""
        return self._select(queries, Keep(budget=budget), payload, **options)


class _GivenScores:
    """Scores that the items bring along, one for each query of a block."""

    columns = ("scores",)

    def prepare(self, block: pa.Table) -> np.ndarray:
        return block.column("place").to_numpy()

    def load(self, batch: pa.Table) -> np.ndarray:
        scores = matrix_of(batch.column("scores")) if pc.sum(pc.list_value_length(batch.column("scores"))).as_py() else None
        return np.zeros((batch.num_rows, 0)) if scores is None else scores

    def score(self, state: np.ndarray, loaded: np.ndarray) -> np.ndarray:
        return loaded[:, state]


def _with_shared(items: DataFrame, lists: DataFrame) -> DataFrame:
    """``items`` with ``_shared`` instead of ``_words``: how many distinct words they
    share with each list of ``lists``, one row of a size that was checked. Nulls among
    the words are one word; a list that is null shares nothing that has a number."""
    asked = lists.toArrow().column("lists").combine_chunks()
    asked = pa.concat_arrays(asked.chunks) if isinstance(asked, pa.ChunkedArray) else asked
    shared = items.sparkSession.sparkContext.broadcast(asked.flatten())
    schema = items.drop("_words").schema.add("_shared", ArrayType(IntegerType()))

    def count(batches):
        asked = shared.value
        vocabulary = pc.unique(asked.flatten())
        query, term, _ = _cells(asked, vocabulary)
        weighed = TermWeights(term, query, np.ones(len(term)), len(vocabulary), len(asked))
        missing = asked.is_null().to_numpy(zero_copy_only=False)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_STEP):
                part = batch.slice(start, ROWS_PER_STEP)
                words = part.column("_words")
                row, term, _ = _cells(words, vocabulary)
                sums = weighed.sums(len(words), row, term, np.ones(len(row))).astype(np.int32)
                none = words.is_null().to_numpy(zero_copy_only=False)[:, None] | missing
                counts = pa.array(sums.ravel(), mask=none.ravel())
                begins = np.arange(len(words) + 1, dtype=np.int32) * len(asked)
                columns = [part.column(name) for name in schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(begins, counts)], schema.names)

    return items.mapInArrow(count, schema)


class Scored:
    """Retrieval by any scorer, a function of a query and a text column.

    The scorer sees every pair: queries are sent to the chunks, in blocks if all of
    them are too many, and a chunk is one row with its scores for a block. Each task
    keeps the best of its own chunks before any row is shuffled. ``prepare``, a
    function of a text column, is applied once to every query and every text; the
    scorer then gets what it made of them. With ``words``, a function of a text column
    that lists its words, the scorer also gets how many distinct ones a pair shares,
    what ``size(array_intersect(...))`` of both lists is; they are counted for a batch
    of chunks and a block of queries at once. Ties go by document id, then chunk index;
    pairs without a score come last.
    """

    def __init__(self, chunks: DataFrame, scorer, prepare=None, words=None):
        self.scorer, self.prepare, self.words = scorer, prepare or (lambda text: text), words
        self.items = chunks.withColumn("size", F.length("text"))

    def _select(self, queries, keep: Keep, payload, broadcast_limit: int | None = None) -> DataFrame:
        limit = session.BROADCAST_BYTES if broadcast_limit is None else broadcast_limit
        asked = queries.select("query_id", F.col("query").alias("text"))
        size = F.octet_length(F.coalesce("text", F.lit(""))) + 64
        total, rows = asked.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
        blocks = max(min(-(-total // max(limit, 1)), rows), -(-rows // SCORES_PER_ROW), 1)
        part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        items = self.items.withColumn("_prepared", self.prepare(F.col("text")))
        if self.words is not None:
            wanted = dict.fromkeys(["doc_id", "chunk_index", "position", "size", *payload, "_prepared"])
            items = items.select(*wanted, self.words(F.col("text")).alias("_words"))

        def score(query: Column, *shared: Column) -> Column:
            value = self.scorer(query, F.col("_prepared"), *shared).cast("double")
            return F.coalesce(F.when(F.isnan(value), MOST).otherwise(value), F.lit(LEAST))

        found = []
        for block in range(blocks):
            # One row: a total order of the block, so that places are the same again.
            row = asked.where(part == block).agg(F.sort_array(F.collect_list(F.struct("query_id", "text"))).alias("all"))
            spelled = row.select(F.transform("all", lambda q: F.struct(self.prepare(q["text"]).alias("query"))).alias("_asked"))
            if self.words is None:
                held, scores = items, F.transform("_asked", lambda q: score(q["query"]))
            else:
                lists = row.select(F.transform("all", lambda q: self.words(q["text"])).alias("lists"))
                held = _with_shared(items, lists)
                scores = F.zip_with("_asked", "_shared", lambda q, shared: score(q["query"], shared))
            scored = held.crossJoin(F.broadcast(spelled)).withColumn("scores", scores)
            places = row.select(F.posexplode("all").alias("place", "q")).select("place", "q.query_id")
            found.append(
                select_best(
                    scored, places, _GivenScores(), keep, order=("doc_id", "chunk_index"), payload=("position", *payload)
                )
            )
        # A query is in one block.
        whole = reduce(lambda a, b: a.unionByName(b), found)
        value = F.when(F.col("score") == MOST, float("nan")).when(F.col("score") != LEAST, F.col("score"))
        return whole.withColumn("score", value)

    def search(self, queries, k: int = 3, payload=(), **options) -> DataFrame:
        found = self._select(queries, Keep(k=k), payload, **options)
        return found.select("query_id", "rank", "position", "score", *payload)

    def search_within_budget(self, queries, budget: int = 600, payload=(), **options) -> DataFrame:
        """The longest prefix of the ranking within ``budget`` characters; the best
        chunk is returned even if it alone exceeds it."""
        found = self._select(queries, Keep(budget=budget), payload, **options)
        return found.select("query_id", "rank", "position", "score", *payload)


def overlap(chunks: DataFrame, scorer="coverage", prepare=None, words=None):
    """An index by one of the named overlap scorers or by a function of columns, of
    what ``prepare`` makes of them if that is given, and of the number of words a pair
    shares if ``words`` is."""
    return Scored(chunks, scorer, prepare, words) if callable(scorer) else Overlap(chunks, scorer)


def score_coverage(query: Column, text: Column) -> Column:
    """Distinct query terms present in the text."""
    return F.size(F.array_intersect(T.tokens(query), T.tokens(text))).cast("double")


def score_occurrences(query: Column, text: Column) -> Column:
    """Text tokens that are query terms, repeats included."""
    wanted = T.tokens(query)
    return F.size(F.filter(T.tokens(text), lambda t: F.array_contains(wanted, t))).cast("double")


class BM25:
    """Okapi BM25 over a chunk table."""

    def __init__(self, chunks: DataFrame, k1: float = 1.5, b: float = 0.75, tokenizer=T.tokens):
        if k1 < 0:
            raise ValueError(f"k1 must not be negative, got {k1}")
        if not 0.0 <= b <= 1.0:
            raise ValueError(f"b must be between 0 and 1, got {b}")
        self.k1, self.b, self.tokenizer = k1, b, tokenizer
        self.items = _scored_items(chunks, tokenizer)

    def postings(self, *more: str) -> DataFrame:
        """``(term, position, tf)``, with ``dl``, the length of the chunk, if asked for.

        A chunk is one row, whose terms are sorted and counted inside it: nothing is
        shuffled, and the cost is that of sorting."""
        pairs = self.items.select(
            "position", F.size("tokens").alias("dl"), F.inline(_counted(F.col("tokens")))
        )
        return pairs.select("term", "position", "tf", *more)

    def doc_stats(self) -> DataFrame:
        return self.items.select("position", F.size("tokens").alias("dl"))

    def term_stats(self, wanted: DataFrame | None = None) -> DataFrame:
        """``(term, df, dl)``; the row for EVERYTHING holds the number of chunks
        and their summed length. Each task adds up its own terms first. With
        ``wanted`` only its terms are counted; if they are few, they are sent to the
        chunks, and no other term leaves its task."""
        few = wanted is not None and session.fits_broadcast(wanted, F.octet_length("term") + 32)
        if few and self.tokenizer is T.tokens:
            return self._counted_in_tasks(wanted)
        spelled = F.array_append(F.array_distinct("tokens"), F.lit(EVERYTHING))
        rows = self.items.select(F.explode(spelled).alias("term"), F.size("tokens").alias("dl"))
        if few:
            rows = rows.join(F.broadcast(wanted), "term", "left_semi")
        total = F.sum(F.when(F.col("term") == EVERYTHING, F.col("dl")))
        return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), total.alias("dl"))

    def _counted_in_tasks(self, wanted: DataFrame) -> DataFrame:
        """``term_stats`` of a few terms: a task reads its texts and emits one row per
        term that it saw."""
        terms = sorted({row["term"] for row in wanted.collect()} - {None})
        shared = self.items.sparkSession.sparkContext.broadcast(terms)

        def count(batches):
            asked, chunks, length = pa.array(shared.value, pa.string()), 0, 0
            seen = np.zeros(len(asked), np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS_PER_STEP):
                    tokens = token_lists(batch.column("text").slice(start, ROWS_PER_STEP)).drop_null()
                    sizes = tokens.value_lengths().to_numpy()
                    chunks, length = chunks + len(tokens), length + int(sizes.sum())
                    place = pc.fill_null(pc.index_in(tokens.flatten(), asked), -1).to_numpy()
                    held = np.repeat(np.arange(len(tokens)), sizes) * len(asked) + place
                    once = np.unique(held[place >= 0])
                    seen += np.bincount(once % max(len(asked), 1), minlength=len(asked))
            if chunks and EVERYTHING in shared.value:
                seen[shared.value.index(EVERYTHING)] = chunks
            found = np.flatnonzero(seen)
            names = asked.take(pa.array(found))
            sums = [length if name == EVERYTHING else None for name in names.to_pylist()]
            columns = [names, pa.array(seen[found]), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "df", "dl"])

        parts = self.items.select("text").mapInArrow(count, "term string, df long, dl long")
        return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))

    def document_frequency(self) -> DataFrame:
        return self.term_stats().where(F.col("term") != EVERYTHING).select("term", "df")

    def idf(self) -> DataFrame:
        """``(term, df, idf)`` of every term of the collection."""
        total = self.items.count()
        if not total:
            raise ValueError("cannot build an index over no chunks")
        weight = T.idf(F.lit(total), F.col("df"))
        return self.document_frequency().select("term", "df", weight.alias("idf"))

    def query_terms(self, queries: DataFrame) -> DataFrame:
        """Per query its terms with multiplicity and collection statistics."""
        words = F.array_append(self.tokenizer(F.col("query")), F.lit(EVERYTHING))
        uses = (
            queries.select("query_id", F.explode(words).alias("term"))
            .groupBy("query_id", "term")
            .agg(F.count(F.lit(1)).alias("uses"))
        )
        joined = uses.join(self.term_stats(uses.select("term").distinct()), "term", "left")
        part = F.struct(
            "term", "uses", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("dl", F.lit(0)).alias("dl")
        )
        return joined.groupBy("query_id").agg(F.collect_list(part).alias("terms"))

    def _select(self, queries, keep, payload, **options):
        terms = self.query_terms(queries)
        return select_best(
            self.items, terms, TermKernel("bm25", self.k1, self.b, self.tokenizer), keep,
            payload=tuple(payload), query_size=_term_bytes(), **options,
        )

    def search(self, queries: DataFrame, k: int = 3, payload=(), **options) -> DataFrame:
        """The ``k`` best chunks among those sharing a term with the query."""
        return self._select(queries, Keep(k=k, matched_only=True), payload, **options)

    def search_within_budget(self, queries, budget: int = 600, payload=(), **options) -> DataFrame:
        return self._select(queries, Keep(budget=budget, matched_only=True), payload, **options)

    def score(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """Scores of given ``(query_id, position)`` pairs."""
        asked = pairs.join(self.items.select("position", "tokens"), "position")
        spelled = asked.join(self.query_terms(queries), "query_id").withColumn(
            "whole", F.element_at(F.filter("terms", lambda t: t["term"] == EVERYTHING), 1)
        )
        ratio = F.size("tokens") / (F.col("whole.dl") / F.col("whole.df"))
        damping = self.k1 * (1 - self.b + self.b * ratio)

        def part(term):
            tf = F.size(F.filter("tokens", lambda t: t == term["term"]))
            gain = tf * (self.k1 + 1) / (tf + damping)
            value = term["uses"] * T.idf(F.col("whole.df"), term["df"]) * gain
            return F.when((tf > 0) & (term["term"] != EVERYTHING), value).otherwise(0.0)

        total = F.aggregate("terms", F.lit(0.0), lambda acc, term: acc + part(term))
        return spelled.select("query_id", "position", total.alias("score"))
