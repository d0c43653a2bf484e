"""Fill-in-the-middle: a text's middle moves to its end, so that it can be learned.

A text is cut into units, left to right: a run of letters A-Z and a-z, or any other
single character. Two numbers drawn from the document's id say how many units come
before the middle and how many before the suffix. The cuts must be found as places
in the text. Every character has one of four classes, by whether it is a letter and
whether the one before it is. A wavelet matrix over the classes of a batch of texts
answers how many characters of a class lie before a place; the classes that begin a
unit add up to the units begun before it, and bisection on that count finds the
place where a given unit begins, for all cuts of the batch in step.

Defined cases: a null text is an empty one; an empty text, one that holds a mark
and the drawn share of the others stay as they are (``plain``); a null id draws as
an empty number; repeated rows are transformed alike; very long texts make batches
of their own; other columns travel in ``rest``; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import narrowed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters of the texts that share one matrix, unless one text is longer.
BATCH_CHARS = 1 << 20
#: Classes that begin a unit: all but a letter after a letter.
OTHER_AFTER_OTHER, OTHER_AFTER_LETTER, FIRST_LETTER, INNER_LETTER = range(4)
BEGINNING = (OTHER_AFTER_OTHER, OTHER_AFTER_LETTER, FIRST_LETTER)

FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


class Bits:
    """A bit vector that counts its ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words)
        self.before = np.cumsum(counts, dtype=np.int64) - counts
        self.total = int(counts.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """One bit vector per bit of the symbols, highest first; each level sorts the
    symbols by the bit it holds, zeros before ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in reversed(range(bits)):
            ones = (symbols >> shift) & 1 == 1
            vector = Bits(ones)
            self.levels.append((shift, vector, len(symbols) - vector.total))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place."""
        low, high = np.zeros(1, np.int64), at
        for shift, vector, zeros in self.levels:
            if symbol >> shift & 1:
                low, high = zeros + vector.ones(low), zeros + vector.ones(high)
            else:
                low, high = low - vector.ones(low), high - vector.ones(high)
        return high - low


def classes(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Class of every code point; no letter comes before the first of a text."""
    folded = points | 32
    letter = (folded >= 97) & (folded <= 122) & (points < 128)
    after = np.r_[False, letter[:-1]]
    after[begins[begins < len(points)]] = False
    return letter.astype(np.uint8) * 2 + after


class Units:
    """Counts and places of the units of texts laid end to end."""

    def __init__(self, points: np.ndarray, begins: np.ndarray):
        self.size = len(points)
        self.matrix = WaveletMatrix(classes(points, begins), 2)

    def begun(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before each place."""
        return sum(self.matrix.rank(c, at) for c in BEGINNING)

    def begin_of(self, unit: np.ndarray) -> np.ndarray:
        """Where each unit begins: the last place with no more units before it."""
        low, high = np.zeros(len(unit), np.int64), np.full(len(unit), self.size, np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.begun(middle) <= unit
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def draws(doc_id, seed: int = 1) -> list[int]:
    """Four 32-bit numbers of a document."""
    shown = "" if doc_id is None else str(doc_id)
    digits = hashlib.sha256(f"{seed}:{shown}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def _assembled(text: str, form: str, one: int, two: int) -> str:
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if form == "psm":
        return "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def _piece(ids: list, texts: list[str], seed: int, plain: int, spm: int) -> list[tuple]:
    """Count, form, sizes and output of each text of one matrix."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begins = np.r_[0, ends[:-1]]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    units = Units(points, begins)
    first = units.begun(begins)
    counts = units.begun(ends) - first
    drawn = np.array([draws(i, seed) for i in ids], np.int64)
    picks = np.sort(drawn[:, :2] % (counts + 1)[:, None], axis=1) + first[:, None]
    cuts = units.begin_of(picks.ravel()).reshape(-1, 2) - begins[:, None]
    out = []
    for text, n, (one, two), (_, _, h3, h4) in zip(texts, counts.tolist(), cuts.tolist(), drawn.tolist()):
        if not text or h3 % 100 >= 100 - plain or PREFIX in text or SUFFIX in text or MIDDLE in text:
            out.append((n, "plain", None, None, text))
        else:
            form = "spm" if h4 % 100 < spm else "psm"
            out.append((n, form, one, two - one, _assembled(text, form, one, two)))
    return out


def _pieces(texts: list[str]) -> Iterator[slice]:
    begin, chars = 0, 0
    for i, text in enumerate(texts):
        if i > begin and chars + len(text) > BATCH_CHARS:
            yield slice(begin, i)
            begin, chars = i, 0
        chars += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def transformed(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``doc_id, rest, n, form, prefix_chars, middle_chars, output`` of every row.

    ``rest`` holds the other columns; ``restored`` gives the text back.
    """
    source = narrowed(docs, "doc_id", "text").select("doc_id", "rest", "text")
    schema = T.StructType([*source.schema.fields[:2], *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for part in _pieces(texts):
                rows = _piece(ids[part], texts[part], seed, plain_percent, spm_percent)
                made = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                n = part.stop - part.start
                kept = [batch.column(i).slice(part.start, n) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema.names)

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that a form was made of. No mark lies inside a text that was moved,
    and none can arise where a text meets a mark, so the first of each is the one."""
    size = len(PREFIX)

    def between(opened: str, closed: str) -> Column:
        begin = F.locate(opened, output) + size
        return F.substring(output, begin, F.locate(closed, output) - begin)

    middle = F.substring(output, F.locate(MIDDLE, output) + size, F.length(output))
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def digest(made: DataFrame) -> DataFrame:
    """Counts and checksums of the outputs and of the texts rebuilt from them."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
