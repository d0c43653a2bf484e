"""Hard negatives: rows of another label that score almost as high as a positive.

Every vector is stored with summaries: its components are cut into 1, 4, 16, ...
segments, and each segment keeps its mean and standard deviation. The inner product
of two vectors over a segment of n components lies within
n * (mean * mean' - deviation * deviation') and n * (mean * mean' + deviation *
deviation'). Added over the segments this bounds the score; finer segments narrow
it. Pairs whose bounds miss what an anchor still needs go, level by level, and only
the rest is scored exactly.

Anchors travel to the rows in blocks of checked size; rows stay where they are. A
task keeps the best few rows of every anchor, and what it already has raises what
further rows need. A first pass finds positives of the anchors (same label), a
second one negatives (another label) in the window of scores each positive opens.

Scores are inner products of floor(scale * component) and exact: in double precision
where that holds every sum, else in whole numbers.

Defined cases: rows with a null id, label or vector or a null or non-finite component
take no part, and empty vectors neither; vectors of different lengths do not meet;
repeated rows count one by one, and each is another row to its copies; ties go by
id, then as the rows lie in the input; anchors without positives or positives
without negatives give no row; an empty table gives none; scores beyond 64 bits fail
the job; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import top_k
from .common import saved

#: Bytes of the anchors that travel at once, and what a row of them holds beside.
BLOCK_BYTES, ROW_BYTES = 32 << 20, 128
ROWS_PER_STEP, ANCHORS_PER_STEP = 2048, 512
#: Below this share of pairs alive, they are bounded one by one.
SPARSE = 0.1
#: Pairs gathered at once.
PAIRS_PER_STEP = 1 << 16
SLACK = 1e-9
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
INDEX = "row long, id long, label long, vector array<double>, summary array<double>"
FOUND = "anchor_row long, anchor_id long, goal_row long, goal_id long, goal_score long, row long, id long, score long"


def segment_counts(d: int) -> list[int]:
    """Segments of each level: finer ones as long as they are smaller than the vector."""
    counts, n = [], 1
    while 2 * n < d:
        counts.append(n)
        n *= 4
    return counts


def _edges(d: int, n: int) -> np.ndarray:
    return np.arange(n) * d // n


def summaries(x: np.ndarray) -> np.ndarray:
    """Means, then deviations, of the segments of every level, coarsest first."""
    d, parts = x.shape[1], []
    for n in segment_counts(d):
        edges = _edges(d, n)
        sizes = np.diff(np.r_[edges, d])
        means = np.add.reduceat(x, edges, axis=1) / sizes
        spread = np.add.reduceat((x - np.repeat(means, sizes, axis=1)) ** 2, edges, axis=1) / sizes
        parts += [means, np.sqrt(spread)]
    return np.concatenate(parts, axis=1) if parts else np.empty((len(x), 0))


def _by_length(values: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` of the vectors of each length."""
    lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        flat = values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.astype(np.float64).reshape(len(rows), int(d))


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, rows.ravel())


def index(vectors: DataFrame, scale: float) -> DataFrame:
    """The rows of ``vectors`` (id, label, vector) that take part, with summaries."""
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
    rows = vectors.withColumn("row", F.monotonically_increasing_id()).where(
        usable & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for picked, x in _by_length(batch.column(3)):
                q = np.floor(scale * x)
                kept = [batch.column(i).take(pa.array(picked)) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, _lists(q), _lists(summaries(q))], ["row", "id", "label", "vector", "summary"]
                )

    wide = rows.select("row", F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"))
    return saved(wide.mapInArrow(run, INDEX), "segments")


@dataclass
class Side:
    """Rows of one length: numbers, vectors and summaries by level."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def all_of(table) -> Iterator[Side]:
        numbers = [table.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "label")]
        stored = table.column("summary")
        for rows, x in _by_length(table.column("vector")):
            d = x.shape[1]
            flat = stored.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            levels, at = [], 0
            for n in segment_counts(d):
                # Both sides carry the root of a segment's size.
                root = np.sqrt(np.diff(np.r_[_edges(d, n), d]))
                levels.append((flat[:, at : at + n] * root, flat[:, at + n : at + 2 * n] * root))
                at += 2 * n
            yield Side(*[a[rows] for a in numbers], x, levels)

    def part(self, begin: int, size: int) -> Side:
        cut = slice(begin, begin + size)
        levels = [(m[cut], d[cut]) for m, d in self.levels]
        return Side(self.row[cut], self.id[cut], self.label[cut], self.x[cut], levels)

    def norms(self) -> np.ndarray:
        return np.sqrt((self.x**2).sum(1))


def _products(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of given pairs of rows."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS_PER_STEP):
        cut = slice(at, at + PAIRS_PER_STEP)
        out[cut] = np.einsum("ij,ij->i", left[i[cut]], right[j[cut]])
    return out


def exact_scores(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows of whole numbers."""
    if not len(i):
        return np.empty(0, np.int64)
    if np.abs(left).max() * np.abs(right).max() * left.shape[1] < 2.0**53:
        dense = len(i) > SPARSE * len(left) * len(right)
        found = (left @ right.T)[i, j] if dense else _products(left, right, i, j)
        return found.astype(np.int64)
    whole = [[[int(v) for v in row] for row in side] for side in (left, right)]
    sums = [sum(a * b for a, b in zip(whole[0][p], whole[1][q])) for p, q in zip(i.tolist(), j.tolist())]
    if max(map(abs, sums)) > MOST:
        raise OverflowError("an inner product does not fit 64 bits")
    return np.array(sums, np.int64)


class Goals:
    """What a block of anchors looks for: the best ``k`` rows of each window.

    A window belongs to an anchor and takes scores from ``low`` to ``high``. Windows
    are sorted by anchor, and every anchor has at least one.
    """

    def __init__(self, side: Side, same: bool, k: int, owner, low, high):
        self.side, self.same, self.k, self.owner, self.low, self.high = side, same, k, owner, low, high
        self.first = np.searchsorted(owner, np.arange(len(side.row)))
        self.count = np.diff(np.r_[self.first, len(owner)])
        self.needed = low.copy()
        self.ceiling = np.maximum.reduceat(high, self.first)
        self.best = [np.empty(0, np.int64) for _ in range(4)]  # window, score, id, row
        self.scored = 0
        self.norm = side.norms()
        self._settle()

    def _settle(self) -> None:
        self.floor = np.minimum.reduceat(self.needed, self.first)

    def offer(self, rows: Side) -> None:
        """Let every anchor see these rows."""
        for begin in range(0, len(self.side.row), ANCHORS_PER_STEP):
            part = self.side.part(begin, ANCHORS_PER_STEP)
            cut = slice(begin, begin + len(part.row))
            i, j = self._alive(rows, part, cut)
            score = exact_scores(rows.x, part.x, i, j)
            self.scored += len(i)
            self._keep(rows, i, j + begin, score)
        self._settle()

    def _alive(self, rows: Side, part: Side, cut: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that the bounds of no level rule out."""
        slack = 0.5 + SLACK * rows.norms().max() * self.norm[cut]
        floor = self.floor[cut].astype(np.float64) - slack
        ceiling = self.ceiling[cut].astype(np.float64) + slack
        alive = (rows.label[:, None] == part.label) == self.same
        alive &= rows.row[:, None] != part.row
        pairs = None
        for (mean, spread), (own_mean, own_spread) in zip(rows.levels, part.levels):
            if pairs is None and np.count_nonzero(alive) < SPARSE * alive.size:
                pairs = np.nonzero(alive)
            if pairs is None:
                middle, reach = mean @ own_mean.T, spread @ own_spread.T
                alive &= (middle + reach >= floor) & (middle - reach <= ceiling)
            else:
                i, j = pairs
                middle, reach = _products(mean, own_mean, i, j), _products(spread, own_spread, i, j)
                fits = (middle + reach >= floor[j]) & (middle - reach <= ceiling[j])
                pairs = i[fits], j[fits]
        return np.nonzero(alive) if pairs is None else pairs

    def _keep(self, rows: Side, i: np.ndarray, anchor: np.ndarray, score: np.ndarray) -> None:
        often = self.count[anchor]
        pair = np.repeat(np.arange(len(i)), often)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(often) - often, often)
        window = self.first[anchor][pair] + inside
        value = score[pair]
        fits = (value >= self.needed[window]) & (value <= self.high[window])
        if not fits.any():
            return
        window, value, at = window[fits], value[fits], i[pair[fits]]
        new = [window, value, rows.id[at], rows.row[at]]
        window, value, ident, row = (np.concatenate(two) for two in zip(self.best, new))
        order = np.lexsort((row, ident, ~value, window))
        window = window[order]
        starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        rank = np.arange(len(window)) - np.repeat(starts, np.diff(np.r_[starts, len(window)]))
        order, window, rank = order[rank < self.k], window[rank < self.k], rank[rank < self.k]
        self.best = [window, value[order], ident[order], row[order]]
        full = rank == self.k - 1
        self.needed[window[full]] = self.best[1][full]


def _windows(block: pa.RecordBatch, side: Side, percent: tuple[int, int] | None):
    """Owner, bounds and positive of every window of one side's anchors."""
    n = len(side.row)
    if percent is None:
        none = np.full(n, -1, np.int64)
        return np.arange(n), np.full(n, LEAST), np.full(n, MOST), none, none, np.zeros(n, np.int64)
    goals = dict(zip(block.column("row").to_pylist(), block.column("goals").to_pylist()))
    listed = [(i, g["row"], g["id"], g["score"]) for i, r in enumerate(side.row.tolist()) for g in goals[r]]
    owner, row, ident, score = (np.array(c, np.int64) for c in zip(*listed))
    least, most = percent
    low = np.array([-(-least * s // 100) for s in score.tolist()], np.int64)
    high = np.array([most * s // 100 for s in score.tolist()], np.int64)
    return owner, low, high, row, ident, score


def _search(rows: DataFrame, block: pa.Table, same: bool, k: int, percent: tuple[int, int] | None) -> DataFrame:
    """Best rows of every window, as each task sees them."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as writer:
        writer.write_table(block)
    sent = rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.ipc.open_stream(sent.value).read_all().combine_chunks().to_batches()[0]
        looking = {}
        for side in Side.all_of(asked):
            owner, low, high, *positive = _windows(asked, side, percent)
            looking[side.x.shape[1]] = (Goals(side, same, k, owner, low, high), positive)
        for batch in batches:
            for side in Side.all_of(batch):
                if side.x.shape[1] in looking:
                    for begin in range(0, len(side.row), ROWS_PER_STEP):
                        looking[side.x.shape[1]][0].offer(side.part(begin, ROWS_PER_STEP))
        for goals, positive in looking.values():
            window, score, ident, row = goals.best
            owner = goals.owner[window]
            columns = [goals.side.row[owner], goals.side.id[owner], *(p[window] for p in positive), row, ident, score]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns],
                ["anchor_row", "anchor_id", "goal_row", "goal_id", "goal_score", "row", "id", "score"],
            )

    found = rows.mapInArrow(run, FOUND)
    return top_k(found, ["anchor_row", "goal_row"], [F.desc("score"), F.col("id"), F.col("row")], k)


def _blocks(anchors: DataFrame) -> Iterator[DataFrame]:
    """The anchors in parts of bounded size."""
    size = 8 * (F.size("vector") + F.size("summary")).cast("long") + ROW_BYTES
    total, n = anchors.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    count = -(-total // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("row"), F.lit(max(count, 1)))
    while 1 < count < n and anchors.groupBy(block).agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0] > 2 * BLOCK_BYTES:
        count *= 2
        block = F.pmod(F.xxhash64("row"), F.lit(count))
    for b in range(count):
        yield anchors.where(block == b)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
    scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``id``, ``label`` and ``vector``; rows where ``anchor`` holds
    (a condition on ``id`` and ``label``) ask. A positive's negatives score from the
    first to the second of ``percent`` of its own score.
    """
    for value in (positives, negatives):
        if value < 1:
            raise ValueError(f"at least 1 must be asked for, got {value}")
    if not 0 <= percent[0] <= percent[1]:
        raise ValueError(f"a window needs 0 <= low <= high, got {percent}")
    rows = index(vectors, scale)
    out = []
    for block in _blocks(rows.where(anchor)):
        asking = block.toArrow()
        if not asking.num_rows:
            continue
        near = _search(rows, asking, True, positives, None)
        goals = saved(
            near.groupBy(F.col("anchor_row").alias("_row")).agg(F.collect_list(F.struct("row", "id", "score")).alias("goals")),
            "positives",
        )
        asking = block.join(goals, F.col("row") == F.col("_row")).drop("_row").toArrow()
        if asking.num_rows:
            out.append(saved(_search(rows, asking, False, negatives, percent), "negatives"))
    shape = rows.sparkSession.createDataFrame([], FOUND + ", rank int")
    found = shape
    for part in out:
        found = found.union(part.select(*shape.columns))
    return found.select(
        "anchor_id",
        F.col("goal_id").alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        F.col("goal_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
