"""Anchors: places that equal passages of different texts choose alike, inside tasks.

Of every window of ``w`` consecutive units the unit with the smallest value is an
anchor (all of them on a tie). Which one it is depends on the window alone, so two
equal passages of that length have an anchor at the same offset, and comparing
texts around equal anchors misses no repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import narrowed

#: Of so many documents one is in the sample that shows very frequent anchors.
SAMPLE = 16
#: Frequent anchors that are sent to all tasks at most (8 bytes each).
HOT_MOST = 100_000
_STEP = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values *= _MIX
    values ^= values >> np.uint64(29)
    return values


def runs_of(values: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of k values (uint64), by doubling; k a power of two."""
    out, width, step = values, 1, _STEP
    while width < k:
        out = out[:-width] * np.uint64(step) + out[width:] if len(out) > width else out[:0]
        step = step * step % (1 << 64)
        width *= 2
    return mixed(out)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of values, as ``runs_of`` gives it for a run of that width."""
    out, step = rows, _STEP
    while out.shape[1] > 1:
        out = out[:, 0::2] * np.uint64(step) + out[:, 1::2]
        step = step * step % (1 << 64)
    return mixed(out[:, 0])


def _sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """Smallest or largest of every w consecutive values."""
    width = 1
    while width * 2 <= w:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = w - width
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the anchors of all windows of w hashes; none in shorter texts."""
    if len(hashes) < w:
        return np.empty(0, np.int64)
    order = (hashes >> np.uint64(32)).astype(np.uint32)
    least = _sliding(order, w, np.minimum)
    # A place is chosen if the largest of its windows' smallest values is its own.
    edge = np.zeros(w - 1, np.uint32)
    highest = _sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    return np.flatnonzero(highest == order)


def binary_rows(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of one width as an Arrow column."""
    n, width = rows.shape
    ends = (np.arange(n + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))]
    )


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, own, text, rest``: rows are told apart by doc_id and a hash of the text,
    so that texts that share an id stay apart; rows equal in both are copies."""
    return narrowed(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("own"), "text", "rest")


def frequent_grams(rows: DataFrame, most: int) -> np.ndarray:
    """Grams that a sample of the documents has so often that all together exceed
    about ``most``, the most frequent ones first. They only go another way: any
    choice gives the same repeats."""
    counted = rows.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= max(most // SAMPLE, 2))
    found = counted.orderBy(F.desc("n"), "gram").limit(HOT_MOST).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in found], np.int64).view(np.uint64))


def repeated_anchors(docs: DataFrame, places_of: Callable, max_group: int) -> DataFrame:
    """``doc_id, own, few, many``: places of anchors that occur again in ``docs``
    (doc_id, own, text).

    ``places_of`` gives the anchors of a text and their hashes. Those that occur
    more than ``max_group`` times are listed apart, in ``many``. Anchors that a
    sample shows to be that frequent are listed there at once and dealt by their
    places instead of by their hash, so that no task gets all of one.
    """
    names = ["doc_id", "own", "place", "gram", "hot"]
    kinds = "doc_id long, own long, place int, gram long, hot boolean"

    def finder(hot: np.ndarray):
        def rows_of(held: list) -> pa.RecordBatch:
            sizes = [len(at) for _, _, at, _ in held]
            ids, own = (np.repeat(np.array([h[i] for h in held], np.int64), sizes) for i in (0, 1))
            place = np.concatenate([at for _, _, at, _ in held] or [np.empty(0, np.int64)])
            keys = np.concatenate([k for _, _, _, k in held] or [np.empty(0, np.uint64)])
            often = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
            if often.any():
                spread = keys + place.astype(np.uint64) * np.uint64(_STEP) + own.view(np.uint64)
                keys = np.where(often, mixed(spread), keys)
            columns = [ids, own, place.astype(np.int32), keys.view(np.int64), often]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, n = [], 0
                ids, owns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for doc_id, own, text in zip(ids, owns, batch.column(2)):
                    at, keys = places_of(text)
                    held.append((doc_id, own, at, keys))
                    n += len(at)
                    if n > 1 << 18:
                        yield rows_of(held)
                        held, n = [], 0
                yield rows_of(held)

        return find

    known = docs.where("doc_id is not null").select("doc_id", "own", "text")
    some = known.where(F.pmod(F.xxhash64("doc_id", "own"), F.lit(SAMPLE)) == 0)
    hot = frequent_grams(some.mapInArrow(finder(np.empty(0, np.uint64)), kinds), max_group)
    rows = known.mapInArrow(finder(hot), kinds)
    again = rows.withColumn("n", F.count("*").over(W.partitionBy("gram"))).where("n > 1 or hot")
    often = F.col("hot") | (F.col("n") > max_group)
    return again.groupBy("doc_id", "own").agg(
        F.collect_list(F.when(~often, F.col("place"))).alias("few"),
        F.collect_list(F.when(often, F.col("place"))).alias("many"),
    )


def cut_out(docs: DataFrame, marks: DataFrame, partitions: int, grouped: Callable, frequent: Callable) -> DataFrame:
    """``doc_id, text, rest, starts, ends`` of ``docs`` (as ``keyed`` gives them).

    Texts are dealt once; both joins share that shuffle. ``grouped`` and ``frequent``
    give the runs ``doc_id, own, start, end`` of the two kinds of marks.
    """
    key = ["doc_id", "own"]
    dealt = docs.repartition(partitions, *key)
    matched = dealt.join(marks.hint("shuffle_hash"), key, "left")
    found = grouped(matched)
    if not marks.where("size(many) > 0").isEmpty():
        found = found.union(frequent(matched))
    runs = found.groupBy(*key).agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    return dealt.join(runs.hint("shuffle_hash"), key, "left").select(
        "doc_id", "text", "rest", F.col("runs.start").alias("starts"), F.col("runs.end").alias("ends")
    )
