"""Citations: from a chunk back to a line, a column and a quote of the raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..functions import unicode as U
from .chunking import chunk_documents


def cite(chunks: DataFrame, documents: DataFrame, quote_chars: int = 60) -> DataFrame:
    """``chunks`` with a ``citation`` struct taken from the raw document.

    Chunks join their document on ``doc_id``; a chunk cannot meet another
    document, and one whose document is missing gets no citation.
    """
    # Line breaks are found once per document, not once per chunk.
    source = documents.select(
        "doc_id", F.col("text").alias("_raw"), F.col("title").alias("_title"),
        F.col("uri").alias("_uri"), _breaks(F.col("text")).alias("_breaks"),
    )
    joined = chunks.join(source, "doc_id", "left")
    span = F.substring(F.col("_raw"), F.col("start") + 1, F.col("end") - F.col("start"))
    quote = _quote(span, quote_chars)

    def citation(line):
        return F.struct(
            "doc_id", "start", "end",
            (line + 1).alias("line"),
            (F.col("start") - F.coalesce(F.get("_breaks", line - 1), F.lit(-1))).alias("column"),
            quote.alias("quote"), F.col("_title").alias("title"), F.col("_uri").alias("uri"),
        )

    built = A.let(A.count_below(F.col("_breaks"), F.col("start")), citation)
    inside = F.col("start").between(0, F.length("_raw"))
    checked = F.when(inside, built).otherwise(F.raise_error(F.lit("offset outside the text")))
    return joined.withColumn("citation", F.when(F.col("_raw").isNotNull(), checked)).drop(
        "_raw", "_title", "_uri", "_breaks"
    )


def _breaks(text: Column) -> Column:
    """Ascending offsets of the line breaks of a text."""
    sums = A.running_sums(F.transform(F.split(text, "\n"), lambda line: F.length(line) + 1))
    # The last line ends without a break.
    return A.let(sums, lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda x: x - 1))


def _quote(span: Column, quote_chars: int) -> Column:
    short = F.concat(T.rstrip(F.substring(span, 1, quote_chars)), F.lit("..."))
    return F.when(F.length(span) > quote_chars, short).otherwise(span)


def cited_chunks(documents: DataFrame, size: int, strategy: str = "sentence", quote_chars: int = 60) -> DataFrame:
    """Chunks with the ``citation`` that ``cite`` would give them, from one reading.

    A chunk is cited while its document is at hand: nothing is joined, and no text
    is read again. Only texts that normalization may change are cut for quotes; else
    the chunk is its own span.
    """

    def cite_in(chunks: str) -> Column:
        def each(breaks, moved):
            def one(chunk):
                start, end = chunk["start"], chunk["end"]
                changed = F.substring(F.col("_text"), start + 1, end - start)
                span = F.when(moved, changed).otherwise(chunk["text"])

                def citation(line):
                    return F.struct(
                        F.col("doc_id").alias("doc_id"), start.alias("start"), end.alias("end"),
                        (line + 1).alias("line"),
                        (start - F.coalesce(F.get(breaks, line - 1), F.lit(-1))).alias("column"),
                        _quote(span, quote_chars).alias("quote"),
                        F.col("_title").alias("title"), F.col("_uri").alias("uri"),
                    )

                return chunk.withField("citation", A.let(A.count_below(breaks, start), citation))

            return F.transform(chunks, one)

        # Both are found once a text, not once a chunk.
        moved = U.may_change(F.col("_text"))
        return A.let(moved, lambda m: A.let(_breaks(F.col("_text")), lambda breaks: each(breaks, m)))

    return chunk_documents(documents, size=size, strategy=strategy, cite=cite_in)


def verify(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunks`` with ``verified``: does the raw span, normalized, equal the chunk?"""
    source = documents.select("doc_id", F.col("text").alias("_raw"))
    span = F.substring(F.col("_raw"), F.col("start") + 1, F.col("end") - F.col("start"))
    return (
        chunks.join(source, "doc_id")
        .withColumn("_span", span)
        .withColumn("verified", U.normalized(F.col("_span")) == F.col("text"))
        .drop("_raw", "_span")
    )
