"""Substring dedup: words inside windows that occur more than once, by FM-index.

Windows of ``length`` words that occur twice hold an anchor at the same offset in
both places (see ``anchors``). Anchors that occur once are dropped; the others are
dealt into shards by their words, each with the words around it. A shard's task
builds a compressed FM-index of its distinct surroundings: the Burrows-Wheeler
transform in a wavelet matrix of packed bits with counts per 64 of them. Then the
surroundings are streamed against the index by backward search, all of a shard in
step: the matching statistics tell how far to the left a passage still occurs more
than once, and windows of full length are reported as intervals. Surroundings that
are equal as a whole need no search. A symbol of the index is a word with its
place relative to the anchor, so that a passage never meets itself.

An anchor with more than MAX_GROUP occurrences goes another way: its windows are
counted one by one, aggregated per task before the shuffle.

Defined cases: null, empty and short texts lose nothing; repeated rows repeat each
other and lose all their windows, whatever their doc_id; texts that share a doc_id
are one document each; a row with a null doc_id keeps its text and is not searched;
very long texts are cut into their words as a whole, in one task; an empty table
gives no rows; other columns travel in ``rest``, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, binary_rows, cut_out, keyed, repeated_anchors, row_hashes, runs_of
from .common import saved
from .shingles import hashes_of, words_of
from .suffixes import merged

#: Words of an anchor, occurrences of one in a shard, surroundings of one index.
ANCHOR, MAX_GROUP, INDEXED = 8, 50_000, 20_000
#: Bytes by which a word is told from others.
WORD_BYTES = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence: one level of packed bits per bit of a symbol."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.words, self.counts, self.zeros = [], [], []
        values = values.astype(np.uint32)
        for level in range(bits - 1, -1, -1):
            ones = ((values >> np.uint32(level)) & np.uint32(1)).astype(bool)
            padded = np.zeros((len(values) // 64 + 1) * 64, bool)
            padded[: len(values)] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(len(values) - int(counts[-1]))
            values = np.concatenate([values[~ones], values[ones]])
        # Where each symbol's block begins after the last level.
        self.starts = self._walk(np.arange(1 << bits, dtype=np.int64), np.zeros(1 << bits, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            block, inside = at >> 6, (at & 63).astype(np.uint64)
            below = (np.uint64(1) << inside) - np.uint64(1)
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & below)
            one = (symbols >> (self.bits - 1 - k)) & 1
            at = np.where(one == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(symbols, at) - self.starts[symbols]


class FMIndex:
    """Backward search over rows of symbols (0 where a row has none), all one width.

    Symbols of different columns differ, so the suffixes of a column are a block of
    the suffix order, and are sorted by their first symbol and the rank of the rest.
    """

    def __init__(self, rows: np.ndarray):
        m, width = rows.shape
        rank = np.zeros(m, np.int64)
        sorted_suffixes = []
        for j in range(width - 1, -1, -1):
            key = rows[:, j] * np.int64(m + 1) + rank
            order = np.argsort(key, kind="stable")
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            before = rows[order, j - 1] if j else np.zeros(m, np.int64)
            there = rows[order, j] > 0
            sorted_suffixes.append((rows[order, j][there], before[there]))
        # The ends of the rows sort first, each after its row's last symbol.
        ends = width - 1 - (rows[:, ::-1] > 0).argmax(1)
        first = np.concatenate([np.zeros(m, np.int64), *(f for f, _ in reversed(sorted_suffixes))])
        bwt = np.concatenate([rows[np.arange(m), ends], *(b for _, b in reversed(sorted_suffixes))])
        top = int(rows.max(initial=0))
        self.n = len(first)
        self.before = np.searchsorted(first, np.arange(top + 2), "left")
        self.tree = WaveletMatrix(bwt, max(top.bit_length(), 1))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Suffix ranges after one more symbol on the left."""
        start = self.before[symbols]
        return start + self.tree.rank(symbols, low), start + self.tree.rank(symbols, high)

    def leftmost(self, rows: np.ndarray, which: np.ndarray, end: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How far left of ``end`` each row's passage still occurs twice, not below ``least``."""
        at = end.copy()
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        going = np.flatnonzero(at > least)
        while len(going):
            symbols = rows[which[going], at[going] - 1]
            a, b = self.extend(symbols, low[going], high[going])
            more = (b - a >= 2) & (symbols > 0)
            going, a, b = going[more], a[more], b[more]
            at[going] -= 1
            low[going], high[going] = a, b
            going = going[at[going] > least[going]]
        return at


def first_repeats(rows: np.ndarray, left: np.ndarray, right: np.ndarray, search: np.ndarray, length: int):
    """First column of the first repeated window around the anchor of some rows, or -1.

    The anchor takes the columns from ``length - ANCHOR``; every window holds it.
    """
    at = length - ANCHOR
    first = np.full(len(search), -1, np.int64)
    index = FMIndex(rows)
    least, most = at - left[search], at + right[search]
    # No repeated window begins left of where the passage up to the anchor's end repeats.
    start = index.leftmost(rows, search, np.full(len(search), length, np.int64), least)
    open_rows = np.flatnonzero((start <= at) & (start + length <= most))
    while len(open_rows):
        begin = start[open_rows]
        reached = index.leftmost(rows, search[open_rows], begin + length, begin)
        done = reached == begin
        first[open_rows[done]] = begin[done]
        open_rows = open_rows[~done]
        # A window that begins at or left of ``reached - 1`` does not occur twice here.
        start[open_rows] = np.maximum(reached[~done], start[open_rows] + 1)
        open_rows = open_rows[(start[open_rows] <= at) & (start[open_rows] + length <= most[open_rows])]
    return first


def repeated_spans(rows: np.ndarray, left: np.ndarray, right: np.ndarray, search: np.ndarray, length: int):
    """First and last column (end) of repeated windows around the anchor of some rows.

    The last one is the first of the rows read backwards, by an index of their own.
    """
    first = first_repeats(rows, left, right, search, length)
    last = np.full(len(search), -1, np.int64)
    found = first >= 0
    if found.any():
        # Symbols have to ascend with the columns there, too.
        turned = np.where(rows > 0, rows.max() + 1 - rows, 0)[:, ::-1]
        last[found] = rows.shape[1] - first_repeats(turned, right - ANCHOR, left + ANCHOR, search[found], length)
    return first, last


def spans(gram, doc_id, own, place, left, right, rows: np.ndarray, length: int):
    """``doc_id, own, start, end`` in words of what repeats, from whole groups of anchors."""
    at = length - ANCHOR
    width = rows.shape[1] // WORD_BYTES
    whole = np.concatenate([gram.view(np.uint8).reshape(len(gram), 8), rows], 1)
    whole = np.concatenate([whole, np.stack([left, right], 1).astype(np.uint8)], 1)
    keys = np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel()
    _, one, member, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    first, last = np.full(len(one), -1, np.int64), np.full(len(one), -1, np.int64)
    enough = (left[one] + right[one]) >= length
    equal = (n > 1) & enough
    first[equal], last[equal] = at - left[one][equal], at + right[one][equal]
    # Only anchors with several surroundings are indexed, and only single ones searched.
    _, group, kinds = np.unique(gram[one], return_inverse=True, return_counts=True)
    several = np.flatnonzero(kinds[group] > 1)
    if len(several):
        words = np.zeros((len(several), width, 8), np.uint8)
        words[:, :, :WORD_BYTES] = rows[one[several]].reshape(len(several), width, WORD_BYTES)
        words = words.view(np.uint64)[:, :, 0]
        column = np.arange(width)
        real = (column >= at - left[one[several]][:, None]) & (column < at + right[one[several]][:, None])
        symbols = np.zeros(words.shape, np.int64)
        used = 0
        block = group[several].astype(np.uint64)
        for j in range(width):
            pair = np.stack([block, words[:, j]], 1)[real[:, j]]
            if len(pair):
                order = np.lexsort((pair[:, 1], pair[:, 0]))
                new = np.r_[True, (pair[order][1:] != pair[order][:-1]).any(1)]
                number = np.empty(len(pair), np.int64)
                number[order] = np.cumsum(new)
                symbols[real[:, j], j] = used + number
                used += int(new.sum())
        search = np.flatnonzero((n[several] == 1) & enough[several])
        if len(search):
            chosen = one[several]
            a, b = repeated_spans(symbols, left[chosen].astype(np.int64), right[chosen].astype(np.int64), search, length)
            first[several[search]], last[several[search]] = a, b
    begin, end = first[member], last[member]
    found = (begin >= 0) & (end > 0)
    return doc_id[found], own[found], place[found] - at + begin[found], place[found] - at + end[found]


def _places(length: int):
    def of(text):
        hashes = hashes_of(words_of(text.as_py()))
        grams = runs_of(hashes, ANCHOR)
        own = anchors(grams, length - ANCHOR + 1)
        return own, grams[own]

    return of


def _word_bytes(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint8).reshape(len(hashes), 8)[:, :WORD_BYTES]


def contexts(matched: DataFrame, length: int) -> DataFrame:
    """Words around every rare enough repeated anchor, as bytes, and how many are real."""
    before = length - ANCHOR

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i).to_pylist() for i in (0, 1)]
            for doc_id, own, text, few in zip(*sides, batch.column(2), batch.column(3)):
                if not few.is_valid or not len(few):
                    continue
                hashes = hashes_of(words_of(text.as_py()))
                at = np.unique(few.values.to_numpy()).astype(np.int64)
                at = at[at + ANCHOR <= len(hashes)]
                if not len(at):
                    continue
                padded = np.concatenate([np.zeros(before, np.uint64), hashes, np.zeros(length, np.uint64)])
                view = np.lib.stride_tricks.sliding_window_view(padded, before + length)
                for k in range(0, len(at), INDEXED):
                    some = at[k : k + INDEXED]
                    rows = view[some]
                    grams = row_hashes(rows[:, before : before + ANCHOR])
                    packed = _word_bytes(np.ascontiguousarray(rows).ravel()).reshape(len(some), -1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grams.view(np.int64)),
                            pa.array(np.full(len(some), doc_id, np.int64)),
                            pa.array(np.full(len(some), own, np.int64)),
                            pa.array(some.astype(np.int32)),
                            pa.array(np.minimum(some, before).astype(np.int16)),
                            pa.array(np.minimum(len(hashes) - some, length).astype(np.int16)),
                            binary_rows(packed),
                        ],
                        ["gram", "doc_id", "own", "place", "left", "right", "bytes"],
                    )

    return matched.select("doc_id", "own", "text", "few").mapInArrow(
        cut, "gram long, doc_id long, own long, place int, left short, right short, bytes binary"
    )


def _sharded(around: DataFrame, length: int) -> DataFrame:
    """``doc_id, own, start, end`` of repeated words, one index after another in a shard."""
    names = ("gram", "doc_id", "own", "place", "left", "right")
    width = (2 * length - ANCHOR) * WORD_BYTES

    def solve(held) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)] if held else []
        found = spans(*columns, length) if held and len(columns[0]) else [np.empty(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], ["doc_id", "own", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in names]
            data = batch.column("bytes")
            first = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
            flat = np.frombuffer(data.buffers()[2], np.uint8)[first : first + batch.num_rows * width]
            columns.append(flat.reshape(batch.num_rows, width))
            at = 0
            while at < batch.num_rows:
                room = max(INDEXED - n, 1)
                end = min(at + room, batch.num_rows)
                # A group stays whole: go on to its last row here.
                end = int(np.searchsorted(columns[0], columns[0][end - 1], "right"))
                if n >= INDEXED and columns[0][at] != held[-1][0][-1]:
                    yield solve(held)
                    held, n = [], 0
                    continue
                held.append([c[at:end] for c in columns])
                n += end - at
                at = end
        yield solve(held)

    ordered = around.repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(run, "doc_id long, own long, start long, end long")


def _frequent(matched: DataFrame, length: int) -> DataFrame:
    """``doc_id, own, start, end`` of repeated windows around very frequent anchors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i).to_pylist() for i in (0, 1)]
            for doc_id, own, text, many in zip(*sides, batch.column(2), batch.column(3)):
                if not many.is_valid or not len(many):
                    continue
                hashes = hashes_of(words_of(text.as_py()))
                at = many.values.to_numpy().astype(np.int64)
                starts = np.unique((at[:, None] - np.arange(length - ANCHOR + 1)).ravel())
                starts = starts[(starts >= 0) & (starts + length <= len(hashes))]
                if not len(starts):
                    continue
                view = np.lib.stride_tricks.sliding_window_view(hashes, length)
                for k in range(0, len(starts), INDEXED):
                    some = starts[k : k + INDEXED]
                    packed = _word_bytes(np.ascontiguousarray(view[some]).ravel()).reshape(len(some), -1)
                    key = [pa.array(np.full(len(some), k, np.int64)) for k in (doc_id, own)]
                    yield pa.RecordBatch.from_arrays(
                        [*key, pa.array(some), binary_rows(packed)], ["doc_id", "own", "start", "string"]
                    )

    strings = matched.select("doc_id", "own", "text", "many").mapInArrow(
        cut, "doc_id long, own long, start long, string binary"
    )
    again = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    return strings.join(again, "string").select("doc_id", "own", "start", (F.col("start") + length).alias("end"))


def removed(docs: DataFrame, length: int, partitions: int | None = None) -> DataFrame:
    """``doc_id, text, rest, starts, ends``: the removed words of every row of ``docs``;
    ``rest`` holds the other columns."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs)
    marks = saved(repeated_anchors(rows, _places(length), MAX_GROUP), "repeated-anchors")
    return cut_out(
        rows, marks, n, lambda m: _sharded(contexts(m, length), length), lambda m: _frequent(m, length)
    )


def digest(cut: DataFrame) -> DataFrame:
    """Counts and checksum of the words that stay of every document."""

    def kept(text, starts, ends) -> tuple[int, list[bytes]]:
        words = words_of(text.as_py())
        if not starts.is_valid or not len(starts):
            return len(words), words
        a, b = merged(starts.values.to_numpy(), ends.values.to_numpy())
        edges = [0, *np.minimum(np.stack([a, b], 1).ravel(), len(words)).tolist(), len(words)]
        return len(words), [w for x, y in zip(edges[::2], edges[1::2]) for w in words[x:y]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept(*r) for r in zip(*(batch.column(i) for i in range(1, 4)))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([n - len(w) for n, w in rows], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for _, w in rows], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.select("doc_id", "text", "starts", "ends").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    )
