"""Suffix-array dedup: removing what a text repeats from earlier texts, by bytes.

Suffixes are not sorted at every byte but at anchors (see ``anchors``): each string
of ``length`` bytes that occurs twice holds an anchor at the same offset in both
places. Anchors whose first bytes occur once are dropped; the rest is grouped by
them, with the bytes around. Inside a group the suffixes at the anchors, and the
reversed texts before them, are merge-sorted: two are compared by their longest
common extension, which a binary search over prefix polynomial hashes finds in a
logarithmic number of steps. Equal hashes of neighbours are verified byte by byte,
and a group in which one fails is sorted by its bytes. The common extensions of
neighbours tell which suffixes agree to any depth, hence for every offset which
strings of ``length`` bytes are equal; all but the earliest are removed.

An anchor with more than MAX_GROUP occurrences is not grouped: its strings are
counted one by one, with the first place of each string aggregated per task before
the shuffle, so no group has to fit a task.

Defined cases: null and empty texts keep nothing and lose nothing; of equal texts
the smallest doc_id stays; texts that share a doc_id are one document each, but not
earlier than each other at equal places; repeated rows keep the same; a row with a
null doc_id keeps its text; very long texts are hashed in pieces; an empty table
gives no rows; other columns travel in ``rest``, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, binary_rows, cut_out, keyed, repeated_anchors, row_hashes, runs_of
from .common import saved

#: Bytes of an anchor, bytes of a text hashed at once, rows of a group and of a sort.
ANCHOR, PIECE, MAX_GROUP, SORTED = 32, 1 << 20, 50_000, 100_000
_BASE = np.uint64(0x100000001B3)


def _text_bytes(text) -> bytes:
    value = text.as_py()
    return value.encode("utf-8") if value else b""


def places(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a text and the hashes of their bytes, piece by piece."""
    found, keys = [], []
    for at in range(0, max(len(data) - length + 1, 0), PIECE):
        part = np.frombuffer(data, np.uint8)[at : at + PIECE + length - 1].astype(np.uint64) + np.uint64(1)
        hashes = runs_of(part, ANCHOR)
        own = anchors(hashes, length - ANCHOR + 1)
        found.append(own + at)
        keys.append(hashes[own])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, first = np.unique(np.concatenate(found), return_index=True)
    return place, np.concatenate(keys)[first]


def _around(data: bytes, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """One row of bytes per place, zeros beyond the ends of the text."""
    padded = np.concatenate([np.zeros(before, np.uint8), np.frombuffer(data, np.uint8), np.zeros(after, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, before + after)[at]


def contexts(matched: DataFrame, length: int) -> DataFrame:
    """The bytes around every rare enough repeated anchor, and how many are real."""
    before = length - ANCHOR

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i).to_pylist() for i in (0, 1)]
            for doc_id, own, text, few in zip(*sides, batch.column(2), batch.column(3)):
                if not few.is_valid or not len(few):
                    continue
                data, at = _text_bytes(text), np.unique(few.values.to_numpy()).astype(np.int64)
                at = at[at + ANCHOR <= len(data)]
                for k in range(0, len(at), SORTED):
                    some = at[k : k + SORTED]
                    rows = _around(data, some, before, length)
                    grams = row_hashes(rows[:, before : before + ANCHOR].astype(np.uint64) + np.uint64(1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grams.view(np.int64)),
                            pa.array(np.full(len(some), doc_id, np.int64)),
                            pa.array(np.full(len(some), own, np.int64)),
                            pa.array(some.astype(np.int32)),
                            pa.array(np.minimum(some, before).astype(np.int16)),
                            pa.array(np.minimum(len(data) - some, length).astype(np.int16)),
                            binary_rows(rows),
                        ],
                        ["gram", "doc_id", "own", "place", "left", "right", "bytes"],
                    )

    return matched.select("doc_id", "own", "text", "few").mapInArrow(
        cut, "gram long, doc_id long, own long, place int, left short, right short, bytes binary"
    )


class Suffixes:
    """Rows of bytes with lengths, compared by hashes of their prefixes."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray):
        self.rows, self.lengths = rows, lengths.astype(np.int64)
        self.prefix = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
        for i in range(rows.shape[1]):
            self.prefix[:, i + 1] = self.prefix[:, i] * _BASE + rows[:, i] + np.uint64(1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension of rows x and y, by binary search over hashes."""
        low = np.zeros(len(x), np.int64)
        high = np.minimum(self.lengths[x], self.lengths[y])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefix[x, middle] == self.prefix[y, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def below(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether row x comes before row y (or is equal, where that is asked for)."""
        at = self.common(x, y)
        ended_x, ended_y = at >= self.lengths[x], at >= self.lengths[y]
        last = self.rows.shape[1] - 1
        a, b = self.rows[x, np.minimum(at, last)], self.rows[y, np.minimum(at, last)]
        return np.where(ended_x & ended_y, or_equal, np.where(ended_x, True, np.where(ended_y, False, a < b)))

    def order(self, group: np.ndarray) -> np.ndarray:
        """Rows sorted inside their groups (``group`` ascending): a merge sort.

        All groups are merged together, level by level. An entry of a run finds
        its place in the run beside it by binary search.
        """
        n = len(group)
        first = np.searchsorted(group, group, "left")
        size = np.searchsorted(group, group, "right") - first
        order, local, width = np.arange(n), np.arange(n) - first, 1
        while len(size) and width < size.max():
            run = local // width
            start = (run ^ 1) * width
            left = run % 2 == 0
            low = np.minimum(start, size)
            high = np.minimum(start + width, size)
            base = low.copy()
            while True:
                open_rows = np.flatnonzero(low < high)
                if not len(open_rows):
                    break
                middle = (low[open_rows] + high[open_rows]) // 2
                other = order[first[open_rows] + middle]
                # Equal entries of the left run come first.
                before = self.below(other, order[open_rows], ~left[open_rows])
                low[open_rows] = np.where(before, middle + 1, low[open_rows])
                high[open_rows] = np.where(before, high[open_rows], middle)
            to = first + (run // 2) * 2 * width + (local - run * width) + (low - base)
            merged = np.empty(n, np.int64)
            merged[to] = order
            order = merged
            width *= 2
        return order

    def checked(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order and what neighbours share, with the bytes verified."""
        same = np.r_[False, group[1:] == group[:-1]]
        shared = self._shared(order, same)
        width = np.arange(self.rows.shape[1])
        wrong = ((self.rows[order[1:]] != self.rows[order[:-1]]) & (width < shared[1:, None])).any(1)
        if wrong.any():  # a hash collision: this sort goes by the bytes themselves
            keys = [*(self.rows[:, i] for i in width[::-1]), group]
            order = np.lexsort(keys)
            differ = self.rows[order[1:]] != self.rows[order[:-1]]
            most = np.where(differ.any(1), differ.argmax(1), self.rows.shape[1])
            shared = np.r_[0, np.minimum(most, np.minimum(self.lengths[order[1:]], self.lengths[order[:-1]]))]
            shared[~same] = 0
        return order, shared

    def _shared(self, order: np.ndarray, same: np.ndarray) -> np.ndarray:
        shared = np.zeros(len(order), np.int64)
        at = np.flatnonzero(same)
        shared[at] = self.common(order[at - 1], order[at])
        return shared


def _classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """Number of each row's class: rows that agree to a depth have the same."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def repeats(gram, doc_id, own, place, left, right, rows: np.ndarray, length: int):
    """``doc_id, own, start, end`` of the bytes around each anchor that repeat an earlier place.

    Rows are whole groups of one anchor each; (0, 0) where nothing repeats.
    """
    before = length - ANCHOR
    by_place = np.lexsort((place, doc_id, gram))
    gram, doc_id, own, place, left, right, rows = (v[by_place] for v in (gram, doc_id, own, place, left, right, rows))
    deepest = np.full(len(gram), -1, np.int64)
    shallowest = np.full(len(gram), length + 1, np.int64)
    after = Suffixes(rows[:, before:], right)
    after_order, after_shared = after.checked(after.order(gram), gram)
    back = Suffixes(rows[:, :before][:, ::-1], left)
    back_order, back_shared = back.checked(back.order(gram), gram)
    for d in range(before + 1):
        there = np.flatnonzero((left >= d) & (right >= length - d))
        if len(there) < 2:
            continue
        key = _classes(back_order, back_shared, d) if d else gram_numbers(gram)
        key = key[there] * (len(gram) + 1) + _classes(after_order, after_shared, length - d)[there]
        _, number, n = np.unique(key, return_inverse=True, return_counts=True)
        if n.max() < 2:
            continue
        # Rows are in the order of places, so the first row of a class is its earliest;
        # rows at the very same place (of one doc_id) are not earlier than each other.
        first = np.full(len(n), len(gram), np.int64)
        np.minimum.at(first, number, there)
        head = first[number]
        later = (doc_id[there] != doc_id[head]) | (place[there] != place[head])
        hit = there[later]
        deepest[hit] = np.maximum(deepest[hit], d)
        shallowest[hit] = np.minimum(shallowest[hit], d)
    found = deepest >= 0
    return (
        doc_id[found],
        own[found],
        place[found].astype(np.int64) - deepest[found],
        place[found].astype(np.int64) - shallowest[found] + length,
    )


def gram_numbers(gram: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, np.int64)


def _grouped(around: DataFrame, length: int) -> DataFrame:
    """``doc_id, own, start, end`` of repeated bytes, from groups of anchors."""
    names = ("gram", "doc_id", "own", "place", "left", "right")

    def solve(held) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)] if held else [np.empty(0, np.int64)] * 4
        found = repeats(*columns, length) if held else columns
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], ["doc_id", "own", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in names]
            data = batch.column("bytes")
            rows = np.frombuffer(data.buffers()[2], np.uint8)
            first = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
            rows = rows[first : first + batch.num_rows * (2 * length - ANCHOR)].reshape(batch.num_rows, -1)
            columns.append(rows)
            cut = 0
            if n > SORTED:  # solve all whole groups before this batch's last one
                cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
                if cut or columns[0][0] != held[-1][0][-1]:
                    held.append([c[:cut] for c in columns])
                    yield solve(held)
                    held, n = [], 0
            held.append([c[cut:] for c in columns])
            n += len(columns[0]) - cut
        yield solve(held)

    ordered = around.repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(run, "doc_id long, own long, start long, end long")


def _frequent(matched: DataFrame, length: int) -> DataFrame:
    """``doc_id, own, start, end`` of repeated strings around very frequent anchors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i).to_pylist() for i in (0, 1)]
            for doc_id, own, text, many in zip(*sides, batch.column(2), batch.column(3)):
                if not many.is_valid or not len(many):
                    continue
                data, at = _text_bytes(text), many.values.to_numpy().astype(np.int64)
                starts = np.unique((at[:, None] - np.arange(length - ANCHOR + 1)).ravel())
                starts = starts[(starts >= 0) & (starts + length <= len(data))]
                for k in range(0, len(starts), SORTED):
                    some = starts[k : k + SORTED]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), doc_id, np.int64)),
                            pa.array(np.full(len(some), own, np.int64)),
                            pa.array(some),
                            binary_rows(_around(data, some, 0, length)),
                        ],
                        ["doc_id", "own", "start", "string"],
                    )

    strings = matched.select("doc_id", "own", "text", "many").mapInArrow(
        cut, "doc_id long, own long, start long, string binary"
    )
    firsts = strings.groupBy("string").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    return (
        strings.join(firsts, "string")
        .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
        .select("doc_id", "own", "start", (F.col("start") + length).alias("end"))
    )


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals, in order; touching intervals are one run."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]


def removed(docs: DataFrame, length: int, partitions: int | None = None) -> DataFrame:
    """``doc_id, text, rest, starts, ends``: the removed runs of every row of ``docs``;
    ``rest`` holds the other columns."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs)
    marks = saved(
        repeated_anchors(rows, lambda text: places(_text_bytes(text), length), MAX_GROUP), "repeated-anchors"
    )
    return cut_out(
        rows, marks, n, lambda m: _grouped(contexts(m, length), length), lambda m: _frequent(m, length)
    )


def _kept(text, starts, ends) -> tuple[int, bytes, int, int]:
    """Length of a text, its remaining bytes, how many went, in how many runs."""
    data = _text_bytes(text)
    if not starts.is_valid or not len(starts):
        return len(data), data, 0, 0
    a, b = merged(starts.values.to_numpy(), ends.values.to_numpy())
    b = np.minimum(b, len(data))
    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
    kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
    return len(data), kept, len(data) - len(kept), len(a)


def digest(cut: DataFrame) -> DataFrame:
    """Counts and checksum of what stays of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept(*r) for r in zip(*(batch.column(i) for i in range(1, 4)))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.select("doc_id", "text", "starts", "ends").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def kept_text(text: Column, starts: Column, ends: Column) -> Column:
    """The remaining text; a character that lost one of its bytes goes as a whole."""

    @F.pandas_udf("string")
    def cut(t, a, b):
        import pandas as pd

        out = []
        for value, x, y in zip(t, a, b):
            if value is None or x is None or not len(x):
                out.append(value)
                continue
            one = pa.array([value], pa.string())[0]
            kept = _kept(one, pa.array([x], pa.list_(pa.int64()))[0], pa.array([y], pa.list_(pa.int64()))[0])[1]
            out.append(kept.decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    return cut(text, starts, ends)
