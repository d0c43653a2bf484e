"""Cutting texts into chunks inside tasks.

Greedy packing carries one open chunk from sentence to sentence. As a fold over
columns that costs some microseconds a sentence; here a worker cuts each text by one
regular expression and one pass, a few hundred texts at a time, so that neither a
batch of long texts nor the offsets of normalized ones pile up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .unicode import normalize_with_offsets

#: Texts, and characters of them about, whose chunks are handed on together.
TEXTS_PER_STEP, CHARS_PER_STEP = 256, 1 << 22
CHUNKS = "array<struct<text:string,start:int,end:int,chunk_index:int>>"
_FIELDS = [("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("chunk_index", pa.int32())]
#: The sentence pieces of ``T.SENTENCE_PIECE``, spelled for Python.
PIECE = re.compile(
    re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", T.SENTENCE_PIECE).replace(r"\z", r"\Z")
)


def sentence_spans(text: str, size: int) -> list[tuple[int, int]]:
    """Spans of whole sentences, packed greedily up to ``size`` characters; a longer
    sentence is a span of its own."""
    spans, start, end, at = [], None, 0, 0
    for piece in PIECE.findall(text):
        at += len(piece)
        body = piece.lstrip(T.SPACE_CHARS)
        if not body:
            continue
        opens = at - len(body)
        ends = opens + len(body.rstrip(T.SPACE_CHARS))
        if start is None:
            start = opens
        elif ends - start > size:
            spans.append((start, end))
            start = opens
        end = ends
    if start is not None:
        spans.append((start, end))
    return spans


def fixed_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of ``size`` characters every ``size - overlap``, up to the first that
    reaches the end."""
    stride = size - overlap
    last = max(-(-(len(text) - size) // stride), 0)
    return [(i * stride, min(i * stride + size, len(text))) for i in range(last + 1 if text else 0)]


def _steps(texts: pa.Array, most: int = TEXTS_PER_STEP) -> Iterator[list]:
    """The texts in lists of a bounded number of them and, but for the last of a list,
    of characters."""
    step, chars = [], 0
    for value in texts:
        step.append(value.as_py())
        chars += len(step[-1] or "")
        if len(step) >= most or chars >= CHARS_PER_STEP:
            yield step
            step, chars = [], 0
    if step or not len(texts):
        yield step


def _cut(texts: list, spans_of, form: str | None, mapped: bool) -> pa.Array:
    ends, found, starts, stops, places = [0], [], [], [], []
    for text in texts:
        offsets = None
        if text is not None:
            if form and not unicodedata.is_normalized(form, text):
                text, offsets = normalize_with_offsets(text, form)
            spans = spans_of(text)
            found += [text[a:b] for a, b in spans]
            if offsets is not None and mapped:
                spans = [(int(offsets[a]), int(offsets[b])) for a, b in spans]
            starts += [a for a, _ in spans]
            stops += [b for _, b in spans]
            places += range(len(spans))
        ends.append(len(found))
    columns = [pa.array(values, kind) for values, (_, kind) in zip((found, starts, stops, places), _FIELDS)]
    values = pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in _FIELDS])
    absent = pa.array([text is None for text in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=absent)


def chunks(
    text: Column, strategy: str, size: int, overlap: int = 0, form: str | None = None, mapped: bool = True,
    step: int = TEXTS_PER_STEP,
) -> Column:
    """The chunks of a text, of its copy in ``form`` if that is given; offsets then
    point into the text as it was, unless ``mapped`` is false."""

    def spans_of(value: str) -> list[tuple[int, int]]:
        return sentence_spans(value, size) if strategy == "sentence" else fixed_spans(value, size, overlap)

    @F.arrow_udf(CHUNKS)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in _steps(texts, step):
                yield _cut(part, spans_of, form, mapped)

    return cut(text)
