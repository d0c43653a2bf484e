"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents longer than a sequence are cut into full pieces and a last shorter one.
Pieces of more than half a sequence open one each: no two of them fit together.
Then each round range-sorts the unplaced pieces and the gaps left in open
sequences together by size, largest first. Every task sweeps its range: a piece
goes to the smallest gap that still holds it, and what is left of that gap comes
up again further down. Pieces whose successor gap lies in an earlier range are
matched next: each range reports how many pieces and gaps it has left (two
numbers), which settles for every left piece by its rank the range and rank of its
gap. Gaps are updated and the next round begins. Pieces that found no gap
anywhere may open a sequence in the next round, largest sizes first (those above a
quarter of the largest one left), so the number of rounds is bounded by the
sequence length and does not grow with the data.

Defined cases: null and empty texts are one piece of the end id; repeated rows
are packed one by one; an empty table gives no piece; other columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import crc, encoder_of, framed

#: Pieces and gaps that one task sweeps.
ROWS_PER_TASK = 100_000
#: Sizes above this share of the largest unplaced one may open sequences.
OPEN_SHARE = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SWEPT = "part int, kind string, id long, size int, seq long, nth long"


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """Pieces of every document (doc_id, text): their place, length and checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc_id, own in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1))):
                ids = framed(own, end)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for column, value in zip(rows, (doc_id, k, at, len(part), crc(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int32() if i == 1 else pa.int64()) for i, r in enumerate(rows)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _sweep(capacity: int, opens_above: int):
    """One pass over a range, sizes descending, gaps before pieces of their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ready: list[tuple[int, int]] = []  # gaps that hold the current size: a heap
        later: list[list[int]] = [[] for _ in range(capacity + 1)]  # smaller ones, by size
        at = capacity
        placed, left = ([], [], []), ([], [])

        def give(free: int, seq: int, size: int) -> None:
            placed[1].append(seq)
            placed[2].append(capacity - free)
            if free - size >= size:
                heapq.heappush(ready, (free - size, seq))
            elif free > size:
                later[free - size].append(seq)

        for batch in batches:
            for gap, size, ident in zip(*(batch.column(c).to_pylist() for c in ("gap", "size", "id"))):
                while at > size:
                    for seq in later[at]:
                        heapq.heappush(ready, (at, seq))
                    later[at] = []
                    at -= 1
                if gap:
                    heapq.heappush(ready, (size, ident))
                    continue
                if later[size]:
                    for seq in later[size]:
                        heapq.heappush(ready, (size, seq))
                    later[size] = []
                if ready:
                    placed[0].append(ident)
                    give(*heapq.heappop(ready), size)
                elif size > opens_above:
                    placed[0].append(ident)
                    give(capacity, ident, size)
                else:
                    left[0].append(ident)
                    left[1].append(size)
        ready.sort()
        small = [(free, seq) for free in range(capacity + 1) for seq in later[free]]
        for kind, ids, sizes, seqs in (
            ("placed", placed[0], placed[2], placed[1]),
            ("piece", left[0], left[1], None),
            ("gap", [s for _, s in ready], [f for f, _ in ready], None),
            ("small", [s for _, s in small], [f for f, _ in small], None),
        ):
            if ids:
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array([kind] * n),
                        pa.array(ids, pa.int64()),
                        pa.array(sizes, pa.int32()),
                        pa.array(seqs if seqs is not None else [None] * n, pa.int64()),
                        pa.array(np.arange(n, dtype=np.int64)),
                    ],
                    ["part", "kind", "id", "size", "seq", "nth"],
                )

    return run


def _matches(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(piece range, first rank, gap range, first rank, how many, first match id).

    Ranges come in descending size; a piece takes from the latest range with gaps.
    """
    open_gaps: list[list[int]] = []
    found, ids = [], 0
    for part, n_pieces, n_gaps in sorted(counts):
        rank = 0
        while rank < n_pieces and open_gaps:
            q, used, n = open_gaps[-1]
            m = min(n_pieces - rank, n - used)
            found.append((part, rank, q, used, m, ids))
            ids, rank = ids + m, rank + m
            if used + m == n:
                open_gaps.pop()
            else:
                open_gaps[-1][1] += m
        if n_gaps:
            open_gaps.append([part, 0, n_gaps])
    return found


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``id, sequence_id, offset`` of every item ``(id long, length int)``, ids unique."""
    spark = items.sparkSession
    large = F.col("length") > capacity // 2
    placed = [items.where(large).select("id", F.col("id").alias("seq"), F.lit(0).alias("offset"))]
    open_items = items.where(~large).select("id", F.col("length").cast("int").alias("size"))
    gaps = items.where(large & (F.col("length") < capacity)).select(
        "id", (F.lit(capacity) - F.col("length")).cast("int").alias("size")
    )
    opens_above = capacity
    while True:
        both = gaps.select("id", "size", F.lit(1).alias("gap")).union(
            open_items.select("id", "size", F.lit(0).alias("gap"))
        )
        known = both.groupBy("gap").agg(F.count("*").alias("n"), F.max("size").alias("top")).collect()
        n_items = sum(r["n"] for r in known if not r["gap"])
        if not n_items:
            break
        tasks = -(-sum(r["n"] for r in known) // ROWS_PER_TASK)
        if opens_above < capacity or not any(r["gap"] for r in known):
            top = max(r["top"] for r in known if not r["gap"])
            opens_above = top // OPEN_SHARE if tasks > 1 else 0
        order = (F.col("size").desc(), F.col("gap").desc(), F.col("id"))
        swept = saved(
            both.repartitionByRange(tasks, *order)
            .sortWithinPartitions(*order)
            .mapInArrow(_sweep(capacity, opens_above), SWEPT),
            "swept",
        )
        opens_above = 0
        placed.append(swept.where("kind = 'placed'").select("id", "seq", F.col("size").alias("offset")))
        counts = (
            swept.where("kind in ('piece', 'gap')")
            .groupBy("part")
            .agg(
                F.sum((F.col("kind") == "piece").cast("long")).alias("pieces"),
                F.sum((F.col("kind") == "gap").cast("long")).alias("gaps"),
            )
            .collect()
        )
        found = _matches([(r["part"], r["pieces"], r["gaps"]) for r in counts])
        open_items = swept.where("kind = 'piece'").select("id", "size")
        gaps = swept.where("kind in ('gap', 'small')").select("id", "size")
        if found:
            # At most two rows per range.
            table = F.broadcast(
                spark.createDataFrame(found, "p int, pi long, q int, qi long, m long, first long")
            )
            nth, part = F.col("nth"), F.col("part")
            of_piece = (part == F.col("p")) & (nth >= F.col("pi")) & (nth < F.col("pi") + F.col("m"))
            of_gap = (part == F.col("q")) & (nth >= F.col("qi")) & (nth < F.col("qi") + F.col("m"))
            left = swept.where("kind = 'piece'").join(table, of_piece, "left")
            free = swept.where("kind = 'gap'").join(table, of_gap, "left")
            pairs = left.select("id", "size", (F.col("first") + nth - F.col("pi")).alias("match")).join(
                free.select(
                    F.col("id").alias("seq"), F.col("size").alias("free"), (F.col("first") + nth - F.col("qi")).alias("match")
                ),
                "match",
            )
            met = saved(
                pairs.select(
                    "id", "seq", (F.lit(capacity) - F.col("free")).alias("offset"), (F.col("free") - F.col("size")).alias("rest")
                ),
                "met",
            )
            placed.append(met.select("id", "seq", "offset"))
            open_items = left.where("first is null").select("id", "size")
            gaps = (
                free.where("first is null")
                .select("id", "size")
                .union(swept.where("kind = 'small'").select("id", "size"))
                .union(met.where("rest > 0").select(F.col("seq").alias("id"), F.col("rest").alias("size")))
            )
    return reduce(DataFrame.union, placed).select(
        "id", F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its ``sequence_id`` and ``offset``."""
    cut = saved(
        pieces(docs, tokenizer, end, capacity).withColumn("_id", F.monotonically_increasing_id()), "pieces"
    )
    places = pack(cut.select(F.col("_id").alias("id"), "length"), capacity)
    return cut.join(places.withColumnRenamed("id", "_id"), "_id").drop("_id")
