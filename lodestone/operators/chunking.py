"""Chunkers: one document row becomes many chunk rows, without a shuffle.

Documents need ``doc_id``, ``doc_order`` (build order: an integer or an array of
them), ``text`` and ``metadata``. Chunk rows carry ``position``, a struct that sorts
chunks in build order: ``(source, doc_order, chunk_index)``. Nothing is packed into
a number, so no order, index or number of sources is out of range.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from ..functions import arrays as A
from ..functions import cutting
from ..functions import text as T
from ..functions import unicode as U

STRATEGIES = ("fixed", "sentence")
#: ``source`` is empty for an index of its own; every union puts the number of a
#: source, as so many digits, in front of it.
SOURCE_DIGITS = 8
CHUNK_COLUMNS = ["doc_id", "chunk_index", "position", "text", "start", "end", "metadata"]

# Words that end in a period without ending a sentence.
ABBREVIATIONS = (
    "fig.", "no.", "vs.", "e.g.", "i.e.", "etc.", "cf.", "approx.",
    "dr.", "mr.", "mrs.", "ms.", "prof.", "st.", "ave.", "dept.",
    "inc.", "ltd.", "co.", "jan.", "feb.", "mar.", "apr.", "jun.",
    "jul.", "aug.", "sep.", "sept.", "oct.", "nov.", "dec.",
)


#: Texts that are cut at once.
BLOCK = cutting.TEXTS_PER_STEP


def check_fixed(size: int, overlap: int = 0) -> None:
    if size < 1:
        raise ValueError(f"size must be at least 1, got {size}")
    if overlap < 0:
        raise ValueError(f"overlap must be non-negative, got {overlap}")
    if overlap >= size:
        raise ValueError(f"overlap {overlap} must be smaller than size {size}")


def _pieces(text: Column) -> Column:
    """The text cut after every sentence end; the pieces join back to it."""
    return F.regexp_extract_all(text, F.lit(T.SENTENCE_PIECE), F.lit(0))


def _measured(pieces: Column) -> Column:
    """Length, leading blanks and trimmed length of every piece."""
    return F.transform(
        pieces,
        lambda piece, i: F.struct(
            i.alias("i"),
            F.length(piece).alias("n"),
            (F.length(piece) - F.length(T.lstrip(piece))).alias("lead"),
            F.length(T.strip(piece)).alias("body"),
        ),
    )


def _span(start: Column, end: Column, first: Column, last: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        first.cast("int").alias("first"),
        last.cast("int").alias("last"),
    )


def _sentence_spans(measured: Column) -> Column:
    """Every piece that is not blank, by running sums of the lengths."""

    def spans(ends):
        found = F.zip_with(
            measured, ends,
            lambda piece, end: F.when(
                piece["body"] > 0,
                _span(end - piece["n"] + piece["lead"], end - piece["n"] + piece["lead"] + piece["body"], piece["i"], piece["i"]),
            ),
        )
        return F.filter(found, lambda span: span.isNotNull())

    return A.let(A.running_sums(F.transform(measured, lambda piece: piece["n"])), spans)


def _texts(pieces: Column, spans: Column) -> Column:
    """Chunk structs; text is joined from pieces, so the cost stays linear."""
    return F.transform(
        spans,
        lambda span, i: F.struct(
            T.strip(
                F.array_join(F.transform(F.sequence(span["first"], span["last"]), lambda j: F.get(pieces, j)), "")
            ).alias("text"),
            span["start"].alias("start"),
            span["end"].alias("end"),
            i.cast("int").alias("chunk_index"),
        ),
    )


def with_sentence_chunks(frame: DataFrame, text: str, out: str, max_chars: int) -> DataFrame:
    """Add ``out``: array of chunks holding whole sentences up to ``max_chars``."""
    if max_chars < 1:
        raise ValueError(f"max_chars must be at least 1, got {max_chars}")
    return frame.withColumn(out, cutting.chunks(F.col(text), "sentence", max_chars, step=BLOCK))


def with_sentences(frame: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array of single sentences with their offsets."""
    return _with_spans(frame, text, out, lambda _, measured: _sentence_spans(measured))


def _with_spans(frame, text, out, spans_of):
    return frame.withColumn(
        out,
        A.let(
            _pieces(F.col(text)),
            lambda pieces: A.let(_measured(pieces), lambda measured: _texts(pieces, spans_of(pieces, measured))),
        ),
    )


def with_fixed_chunks(
    frame: DataFrame, text: str, out: str, size: int = 200, overlap: int = 0
) -> DataFrame:
    """Add ``out``: windows of ``size`` characters every ``size - overlap``."""
    check_fixed(size, overlap)
    stride = size - overlap
    length = F.length(F.col(text))
    count = F.when(length == 0, 0).when(length <= size, 1).otherwise(
        F.ceil((length - size) / F.lit(stride)).cast("int") + 1
    )
    strides = F.regexp_extract_all(F.col(text), F.lit(rf"(?s).{{1,{stride}}}"), F.lit(0))
    per_window = -(-size // stride)

    def windows(whole):
        steps = whole["steps"]

        def window(step, i):
            joined = F.array_join(F.slice(steps, i + 1, F.lit(per_window)), "")
            return F.struct(
                (step if overlap == 0 else F.substring(joined, 1, size)).alias("text"),
                (i * stride).cast("int").alias("start"),
                F.least(i * stride + size, whole["length"]).cast("int").alias("end"),
                i.cast("int").alias("chunk_index"),
            )

        return F.transform(F.slice(steps, F.lit(1), whole["count"]), window)

    parts = F.struct(
        strides.alias("steps"), length.alias("length"), count.cast("int").alias("count")
    )
    return frame.withColumn(out, A.let(parts, windows))


def split_sentences(documents: DataFrame, guarded: bool = False) -> DataFrame:
    """``(doc_id, sentence_index, start, end, text)``.

    ``guarded`` rejoins a sentence onto one that ends in a known abbreviation.
    Texts are normalized first, and offsets count normalized characters.
    """
    source = documents.select("doc_id", U.normalized(F.col("text")).alias("text"))
    pieces = _with_spans(
        source, "text", "sentences",
        lambda pieces, measured: A.let(_sentence_spans(measured), lambda spans: _rejoined(pieces, spans))
        if guarded else _sentence_spans(measured),
    )
    rows = pieces.select("doc_id", F.inline_outer("sentences"))
    return rows.where(F.col("chunk_index").isNotNull()).select(
        "doc_id", F.col("chunk_index").alias("sentence_index"), "start", "end", "text"
    )


def _rejoined(pieces: Column, spans: Column) -> Column:
    """Spans of sentences, each joined to those before it as long as they end in a
    known abbreviation. Whether one does depends on its own last word alone."""

    def opens(span, i):
        before = T.strip(F.get(pieces, F.get(spans, i - 1)["last"]))
        word = F.lower(F.element_at(F.split(before, f"[{T.SPACE_CLASS}]+"), -1))
        return (i == 0) | ~word.isin(*ABBREVIATIONS)

    def joined(begins):
        def one(at, k):
            first = F.get(spans, at)
            last = F.get(spans, F.coalesce(F.get(begins, k + 1), F.size(spans)) - 1)
            return _span(first["start"], last["end"], first["first"], last["last"])

        return F.transform(begins, one)

    return A.let(A.where(spans, opens), joined)


def chunk_documents(
    documents: DataFrame,
    size: int = 200,
    overlap: int = 0,
    strategy: str = "fixed",
    mapped: bool = True,
    cite: Callable[[str], Column] | None = None,
    **metadata,
) -> DataFrame:
    """Chunk rows whose offsets point into the raw document text.

    Chunk text is NFC. With ``mapped=False`` offsets stay those of the
    normalized copy: the classic mistake, kept so that it can be measured.
    ``cite`` makes a ``citation`` of every chunk while its document is at hand (see
    ``citations.cited_chunks``). Keyword arguments join the document metadata and win
    over it.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected fixed or sentence")
    if strategy == "fixed":
        check_fixed(size, overlap)
    elif size < 1:
        raise ValueError(f"max_chars must be at least 1, got {size}")
    cut = cutting.chunks(F.col("text"), strategy, size, overlap, form="NFC", mapped=mapped, step=BLOCK)
    more = [F.col(c).alias(f"_{c}") for c in ("text", "title", "uri") if cite]
    chunked = documents.select("doc_id", "doc_order", "metadata", *more, cut.alias("_chunks"))
    if cite:
        chunked = chunked.withColumn("_chunks", cite("_chunks"))
    # The outer form plus a filter: with plain inline the optimizer infers a size
    # filter and computes the chunks twice.
    parts = isinstance(documents.schema["doc_order"].dataType, TT.ArrayType)
    rows = chunked.select(
        "doc_id", "doc_order", "metadata", F.inline_outer("_chunks")
    ).where(F.col("chunk_index").isNotNull())
    merged = F.col("metadata")
    if metadata:
        extra = F.create_map(
            *[F.lit(str(part)) for pair in metadata.items() for part in pair]
        )
        kept = F.map_filter(merged, lambda key, _: ~key.isin(*metadata))
        merged = F.map_concat(kept, extra)
    return rows.select(
        "doc_id",
        "chunk_index",
        placed(F.col("doc_order"), F.col("chunk_index"), parts).alias("position"),
        "text",
        "start",
        "end",
        merged.alias("metadata"),
        *(["citation"] if cite else []),
    )


def placed(doc_order: Column, chunk_index: Column, parts: bool = False) -> Column:
    """Position of a chunk in an index of its own; ``parts`` tells an order that is an
    array from one that is an integer."""
    order = doc_order.cast("array<bigint>") if parts else F.array(doc_order.cast("bigint"))
    return F.struct(
        F.lit("").alias("source"), order.alias("doc_order"), chunk_index.cast("int").alias("chunk_index")
    )


def build_index(documents: DataFrame, size: int, strategy: str = "sentence") -> DataFrame:
    """All chunks of all documents at one size."""
    return chunk_documents(documents, size=size, strategy=strategy)


def document_key(position: Column) -> Column:
    """Text that sorts like the documents of positions: the source, then each part
    of the order as 16 hexadecimal digits with the sign turned round."""
    signless = F.transform(
        position["doc_order"],
        lambda part: F.lpad(F.hex(part.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"),
    )
    return F.concat(position["source"], F.array_join(signless, ""))


#: Characters of a document key that one level of the counts tells apart.
KEY_STEP = 2


def _steps(key: Column) -> Column:
    """The prefixes of a key as ``(parent, digit)``, one per level."""
    return F.transform(
        F.sequence(F.lit(0), (F.length(key) / KEY_STEP).cast("int") - 1),
        lambda level: F.struct(
            F.substring(key, F.lit(1), (level * KEY_STEP).cast("int")).alias("parent"),
            F.substring(key, (level * KEY_STEP + 1).cast("int"), F.lit(KEY_STEP)).alias("digit"),
        ),
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """``(parent, digit, n)``: chunks of the documents whose key begins so.

    A tree of counts over the keys: what comes before a document is the sum over
    the smaller siblings on its way down, at most 256 a level. Each task adds its
    own chunks up first.
    """
    per_doc = chunks.groupBy(document_key(F.col("position")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    levels = per_doc.select(F.explode(_steps(F.col("key"))).alias("step"), "n")
    return levels.groupBy("step.parent", "step.digit").agg(F.sum("n").alias("n"))


def with_ordinals(rows: DataFrame, chunks: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``ordinal``: the 0-based place, in build order, of the chunk
    their ``position`` names. ``counts`` may hold stored ``chunk_counts``."""
    counts = chunk_counts(chunks) if counts is None else counts
    wanted = rows.select(document_key(F.col("position")).alias("key")).distinct()
    ways = wanted.select("key", F.explode(_steps(F.col("key"))).alias("step"))
    smaller = (F.col("digit") < F.col("step.digit")) & (F.col("parent") == F.col("step.parent"))
    firsts = ways.join(counts, smaller).groupBy("key").agg(F.sum("n").alias("_first"))
    keyed = rows.withColumn("_key", document_key(F.col("position")))
    place = F.coalesce("_first", F.lit(0)) + F.col("position.chunk_index")
    return keyed.join(firsts.withColumnRenamed("key", "_key"), "_key", "left").withColumn("ordinal", place).drop(
        "_key", "_first"
    )


def select(chunks: DataFrame, **filters) -> DataFrame:
    """Chunks whose metadata matches every filter; a collection means any of its
    members, and None matches a missing key."""

    def same(value: Column, wanted) -> Column:
        return value.eqNullSafe(F.lit(None if wanted is None else str(wanted)))

    for key, wanted in filters.items():
        value = F.col("metadata").getItem(key)
        if isinstance(wanted, (list, tuple, set, frozenset)):
            options = [same(value, option) for option in wanted] or [F.lit(False)]
            chunks = chunks.where(reduce(lambda a, b: a | b, options))
        else:
            chunks = chunks.where(same(value, wanted))
    return chunks


def union_chunks(*sources: DataFrame) -> DataFrame:
    """Chunks of several sources in one index, numbered source after source.

    The number goes in front of a position's source, so chunks of two sources stay
    apart whatever their documents are called, and a union may be a source itself.
    """

    def numbered(frame: DataFrame, number: int) -> DataFrame:
        source = F.concat(F.lit(f"{number:0{SOURCE_DIGITS}x}"), F.col("position.source"))
        position = F.col("position").withField("source", source)
        return frame.select(*CHUNK_COLUMNS).withColumn("position", position)

    return reduce(lambda a, b: a.unionByName(b), [numbered(s, i) for i, s in enumerate(sources)])


# --- measurements ----------------------------------------------------------


def covered_length(chunks: Column) -> Column:
    """Characters inside at least one chunk; chunks come in order of start."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("total"))
    return F.aggregate(
        chunks,
        zero,
        lambda acc, chunk: F.struct(
            F.greatest(acc["reach"], chunk["end"]).alias("reach"),
            (
                acc["total"]
                + F.greatest(F.lit(0), chunk["end"] - F.greatest(chunk["start"], acc["reach"]))
            ).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def coverage(length: Column, chunks: Column) -> Column:
    return F.when(length == 0, F.lit(1.0)).otherwise(covered_length(chunks) / length)


def total_length(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0), lambda acc, chunk: acc + F.length(chunk["text"]))


def duplication(length: Column, chunks: Column) -> Column:
    return F.when(length == 0, F.lit(0.0)).otherwise(total_length(chunks) / length)


def index_growth(length: Column, chunks: Column) -> Column:
    return F.try_divide(total_length(chunks), length)


def density(length: Column, sentences: Column) -> Column:
    """Characters per sentence."""
    count = F.size(sentences)
    return F.when(count == 0, F.lit(0.0)).otherwise(length / count)


def facts_per_chunk(sentences: Column, chunks: Column) -> Column:
    count = F.size(chunks)
    return F.when(count == 0, F.lit(0.0)).otherwise(F.size(sentences) / count)


def spans_a_boundary(chunks: Column, phrase: Column) -> Column:
    return F.exists(chunks, lambda chunk: F.contains(chunk["text"], phrase))


def header_retention(chunks: Column, header: Column) -> Column:
    kept = F.size(F.filter(chunks, lambda chunk: F.contains(chunk["text"], header)))
    return F.when(F.size(chunks) == 0, F.lit(0.0)).otherwise(kept / F.size(chunks))


def length_dispersion(chunks: DataFrame) -> DataFrame:
    """Coefficient of variation of chunk lengths."""
    n = F.length("text")
    return chunks.agg((F.stddev_pop(n) / F.avg(n)).alias("cv"))
