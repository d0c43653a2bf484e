"""Score every item against every query, keep a few items per query.

Full-scan retrieval needs all query-item scores, but only ``k`` survivors per
query. Items stay where they are: each task scores its batches against a block
of queries as one matrix product and keeps a running selection, so a task emits
at most a handful of rows per query and no query-item pair is ever shuffled.

Query blocks travel in one of two ways. A query set whose measured size fits
the broadcast bound goes to every task. A larger one is cut into blocks by hash,
items are cut into blocks too, and each pair of blocks meets in one cogrouped
task of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session

#: One score matrix covers at most this many items and queries.
ROWS_PER_STEP = 2048
QUERIES_PER_STEP = 256
#: Block sizes of the grid used beyond the broadcast bound.
GRID_QUERY_BYTES = 16 * 1024 * 1024
GRID_ITEM_ROWS = 500_000
#: Scores closer than this many decimals count as ties.
DECIMALS = 9
#: More than rounding to so many decimals moves a score up; the least score there is.
ROUNDING, LEAST = 1e-9, np.finfo(float).min
#: Hits a query of one batch, on average, that are worth finding its best ones first.
FEW_HITS = 4


@dataclass(frozen=True)
class Keep:
    """What survives per query: the best ``k``, or a prefix within ``budget``."""

    k: int | None = None
    budget: int | None = None
    matched_only: bool = False

    def __post_init__(self):
        if (self.k is None) == (self.budget is None):
            raise ValueError("pass exactly one of k or budget")
        if self.k is not None and self.k < 1:
            raise ValueError(f"k must be at least 1, got {self.k}")
        if self.budget is not None and self.budget < 1:
            raise ValueError(f"budget must be positive, got {self.budget}")


class _Selection:
    """Running survivors of one task for one block of queries."""

    def __init__(self, keep: Keep, queries: int, order: tuple[str, ...], size: str):
        self.keep, self.order, self.size = keep, order, size
        self.floor = np.full(queries, -np.inf)
        self.rows: pa.Table | None = None

    def offer(self, scores: np.ndarray, batch: pa.Table) -> None:
        """Take the scores of a batch (rows x queries)."""
        self._take(scores, batch, None)
        self._trim()

    def offer_parts(self, parts, batch: pa.Table) -> None:
        """Take scores of some pairs of a batch: ``(rows, queries, scores)`` each."""
        for rows, queries, scores in parts:
            self._take(scores, batch.take(pa.array(rows)), queries)
        self._trim()

    def _take(self, scores: np.ndarray, batch: pa.Table, queries: np.ndarray | None) -> None:
        floor = self.floor if queries is None else self.floor[queries]
        # Most scores lie below the floors; only those that may reach them are rounded.
        near = scores >= np.maximum(floor - ROUNDING, LEAST)
        if self.keep.matched_only:
            near &= scores > 0
        item, query = np.divmod(np.flatnonzero(near), max(scores.shape[1], 1))
        if not len(item):
            return
        reach = self._reach(batch)
        if reach < len(scores) and len(item) > FEW_HITS * scores.shape[1]:
            masked = np.where(near, scores, -np.inf)
            cut = np.partition(masked, len(masked) - reach, axis=0)[len(masked) - reach]
            floor = np.maximum(floor, np.round(cut, DECIMALS))
        rounded = np.round(scores[item, query], DECIMALS)
        wanted = rounded >= floor[query]
        item, query = item[wanted], query[wanted]
        if not len(item):
            return
        if len(item) > FEW_HITS * scores.shape[1]:
            # What other rows of the batch push out is not even copied.
            best = self._best(batch, item, query, rounded[wanted])
            item, query = item[best], query[best]
        found = batch.take(pa.array(item))
        asked = query if queries is None else queries[query]
        found = found.append_column("_query", pa.array(asked.astype(np.int64)))
        found = found.append_column("score", pa.array(scores[item, query].astype(np.float64)))
        self.rows = found if self.rows is None else pa.concat_tables([self.rows, found])

    def _best(self, batch: pa.Table, item: np.ndarray, query: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Which pairs of a batch survive among themselves, ascending."""
        places = [part for name in self.order for part in _sortable(batch.column(name))]
        place = np.empty(batch.num_rows, np.int64)
        place[np.lexsort(places[::-1])] = np.arange(batch.num_rows)
        order = np.lexsort((place[item], -score, query))
        starts, counts = _groups(query[order])
        if self.keep.k is not None:
            kept = np.arange(len(order)) - np.repeat(starts, counts) < self.keep.k
        else:
            size = batch.column(self.size).to_numpy()[item[order]].astype(np.int64)
            before = np.cumsum(size) - size
            kept = before - np.repeat(before[starts], counts) <= self.keep.budget
        return np.sort(order[kept])

    def _reach(self, batch: pa.Table) -> int:
        """How many rows of one batch can survive for one query."""
        if self.keep.k is not None:
            return self.keep.k
        shortest = max(int(batch.column(self.size).to_numpy().min()), 1)
        return self.keep.budget // shortest + 2

    def _trim(self) -> None:
        if self.rows is None:
            return
        query = self.rows.column("_query").to_numpy()
        score = np.round(self.rows.column("score").to_numpy(), DECIMALS)
        places = [part for name in self.order for part in _sortable(self.rows.column(name))]
        order = np.lexsort((*reversed(places), -score, query))
        query, score = query[order], score[order]
        starts, counts = _groups(query)
        rank = np.arange(len(query)) - np.repeat(starts, counts)
        if self.keep.k is not None:
            kept = rank < self.keep.k
            full = rank == self.keep.k - 1
        else:
            size = self.rows.column(self.size).to_numpy()[order].astype(np.int64)
            total = np.cumsum(size)
            before = total - size
            before -= np.repeat(before[starts], counts)
            # The first row that overflows stays: it is what ends the prefix.
            kept = before <= self.keep.budget
            full = kept & (before + size > self.keep.budget)
        self.floor[query[full]] = score[full]
        self.rows = self.rows.take(pa.array(order[kept]))

    def result(self, query_ids: pa.Array, schema: pa.Schema) -> pa.Table:
        ids = query_ids.take(self.rows.column("_query").combine_chunks())
        table = self.rows.append_column("query_id", ids)
        return table.select(schema.names).cast(schema)


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    starts = np.r_[0, np.flatnonzero(np.diff(ordered)) + 1]
    return starts, np.diff(np.r_[starts, len(ordered)])


def _sortable(column) -> list[np.ndarray]:
    """Arrays that sort, one after another, like a column of numbers, texts, lists
    of integers or structs of these."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_struct(column.type):
        return [part for field in column.flatten() for part in _sortable(field)]
    if pa.types.is_list(column.type):
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        rows, values = np.repeat(np.arange(len(lengths)), lengths), column.flatten()
        table = np.full((len(lengths), max(lengths.max(initial=0), 1)), np.iinfo(np.int64).min)
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        table[rows, inside] = values.to_numpy(zero_copy_only=False)
        return [*table.T, lengths]
    values = column.to_numpy(zero_copy_only=False)
    if values.dtype != object:
        return [values]
    return [np.unique(values.astype(str), return_inverse=True)[1]]


def _plain(table: pa.Table) -> pa.Table:
    """Dictionary-free, small-offset copy so tables concatenate cleanly."""
    return table.combine_chunks()


def select_best(
    items: DataFrame,
    queries: DataFrame,
    kernel,
    keep: Keep,
    order: tuple[str, ...] = ("position",),
    size: str = "size",
    payload: tuple[str, ...] = (),
    query_size: Column | None = None,
    broadcast_limit: int | None = None,
) -> DataFrame:
    """``(query_id, rank, *order, score, *payload)`` of the surviving items.

    ``kernel`` has ``prepare(query_table) -> state``, ``load(batch) -> loaded``
    and ``score(state, loaded) -> (rows x queries) array``; a batch is loaded
    once however many blocks of queries there are. An item scored ``-inf`` is no
    candidate. A kernel that scores only some pairs has ``parts(state, loaded)``
    instead, which yields ``(rows, queries, scores)``. ``queries`` carries ``query_id`` and whatever the kernel reads.
    A kernel that names a column in ``ascending`` gets items in its order and queries in
    that of ``query_id``; its ``score`` is None where no item of a block is a candidate.
    Ties go to the smaller ``order`` values.
    """
    limit = session.BROADCAST_BYTES if broadcast_limit is None else broadcast_limit
    query_size = F.lit(64) if query_size is None else query_size
    queries = queries.persist()
    # One job measures the query set; it decides the path and the grid.
    measured = queries.agg(
        F.coalesce(F.sum(query_size), F.lit(0)).alias("bytes"),
        F.count(F.lit(1)).alias("rows"),
    )
    columns = list(dict.fromkeys([*order, *([size] if keep.budget else []), *payload]))
    fields = [queries.schema["query_id"]]
    fields += [items.schema[name] for name in columns] + [T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)
    arrow = arrow_schema(schema)
    wire = [name for name in items.columns if name in set(columns) | set(kernel.columns)]
    items = items.select(*wire)
    stats = measured.first()
    if stats["bytes"] <= limit:
        table = _plain(queries.toArrow())
        queries.unpersist()
        spread = items.sparkSession.sparkContext.broadcast(_dump(table))

        def scan(batches):
            block = _load(spread.value)
            yield from _scan(kernel, keep, order, size, columns, block, batches, arrow)

        found = items.mapInArrow(scan, schema)
    else:
        found = _grid(items, queries, kernel, keep, order, size, columns, schema, arrow, stats)
    return _final(found, keep, order, size)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _load(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _scan(kernel, keep, order, size, columns, block, batches, arrow):
    steps, ascending = [], getattr(kernel, "ascending", None)
    if ascending:
        block = block.sort_by("query_id")
    for start in range(0, block.num_rows, QUERIES_PER_STEP):
        asked = block.slice(start, QUERIES_PER_STEP).combine_chunks()
        chosen = _Selection(keep, asked.num_rows, order, size)
        steps.append((asked.column("query_id").combine_chunks(), kernel.prepare(asked), chosen))
    for batch in batches:
        table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        if ascending:
            table = table.sort_by(ascending)
        for start in range(0, table.num_rows, ROWS_PER_STEP):
            part = table.slice(start, ROWS_PER_STEP)
            wanted, loaded = part.select(columns), kernel.load(part)
            for _, state, chosen in steps:
                if hasattr(kernel, "parts"):
                    chosen.offer_parts(kernel.parts(state, loaded), wanted)
                elif (scores := kernel.score(state, loaded)) is not None:
                    chosen.offer(scores, wanted)
    for ids, _, chosen in steps:
        if chosen.rows is not None:
            yield from chosen.result(ids, arrow).to_batches()


def _grid(items, queries, kernel, keep, order, size, columns, schema, arrow, stats):
    query_blocks = int(-(-stats["bytes"] // GRID_QUERY_BYTES))
    item_blocks = int(-(-items.count() // GRID_ITEM_ROWS)) or 1
    left = items.withColumn("_ib", F.pmod(F.xxhash64(*order), F.lit(item_blocks))).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint")))
    )
    # Queries may be the items themselves: a column that both sides hold is one that
    # Spark drops from the second, so there all have names of their own.
    names = queries.columns
    right = queries.toDF(*[f"_asked_{i}" for i in range(len(names))])
    right = right.withColumn("_qb", F.pmod(F.xxhash64(right[names.index("query_id")]), F.lit(query_blocks))).withColumn(
        "_ib", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(item_blocks - 1).cast("bigint")))
    )

    def cell(item_table: pa.Table, query_table: pa.Table) -> pa.Table:
        asked = query_table.rename_columns([*names, *query_table.schema.names[len(names) :]])
        parts = list(
            _scan(
                kernel, keep, order, size, columns, asked.combine_chunks(), [item_table.combine_chunks()], arrow,
            )
        )
        return pa.Table.from_batches(parts, schema=arrow)

    return left.groupBy("_ib", "_qb").cogroup(right.groupBy("_ib", "_qb")).applyInArrow(cell, schema)


def _final(found: DataFrame, keep: Keep, order: tuple[str, ...], size: str) -> DataFrame:
    ordering = [F.round("score", DECIMALS).desc(), *[F.col(name) for name in order]]
    if keep.k is not None:
        return top_k(found, ["query_id"], ordering, keep.k)
    best = W.partitionBy("query_id").orderBy(*ordering)
    running = best.rowsBetween(W.unboundedPreceding, W.currentRow)
    packed = found.withColumn("rank", F.row_number().over(best)).withColumn(
        "_used", F.sum(size).over(running)
    )
    return packed.where((F.col("_used") <= keep.budget) | (F.col("rank") == 1)).drop("_used")


def top_k(frame: DataFrame, keys: list[str], ordering: list[Column], k: int) -> DataFrame:
    """Rows with ``rank <= k`` per key; Spark limits each task's groups first."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    ranked = frame.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*ordering)))
    return ranked.where(F.col("rank") <= k)
