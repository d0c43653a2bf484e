"""Embedding near-duplicates: exact threshold pairs by dual cover-tree traversal.

Vectors are put on the unit sphere, where a cosine of at least c is a distance of at
most sqrt(2 - 2c). Levels of centres with halving radii cover them: the centres of
a level stay centres of the next, and every vector lies within a level's radius of
its centre there. The top levels come from a bounded sample and deal the vectors
into cells; a cell of many vectors is dealt into blocks. Inside a block the next
levels are built from all its vectors. Each node keeps its real covering radius
(the distance of its farthest vector), so every bound is exact, sample or not.

Pairs of blocks, then pairs of nodes, are dropped when their centres are farther
apart than both radii and the threshold together, and taken whole when they are so
near that every pair of vectors links; what is left goes down a level and in the
end is compared vector by vector in double precision. A task returns link counts
per vector and one edge per vector that joined another's set, never pairs.

Vectors that are equal on the sphere are one class with a count. On vectors with
no structure (a high dimension filled evenly) no bound between blocks helps, and
the work is that of comparing all nodes.

Vectors of different lengths have no cosine: cells hold vectors of one length, and
only cells of one length are paired. A length that the sample missed is one cell
without a centre.

Defined cases: null vectors, zero vectors and vectors with null or non-finite
components link with nothing, vectors of any length only with others of that length;
repeated rows are copies of each other, a repeated vec_id gives one row for each of
its rows; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved

#: Vectors from which the top levels are built, and cells at most.
SAMPLE, MAX_CELLS = 2048, 256
#: Vectors of a block: what one side of a task holds.
BLOCK_ROWS = 8192
#: Below so many pairs of vectors a pair of nodes is compared directly.
DIRECT = 1 << 14
#: Room for rounding in the bounds; the comparison itself has none.
SLACK = 1e-9
CHUNK = 1024
UNIT = "id long, unit binary"


def units(vectors: DataFrame) -> DataFrame:
    """``(id, unit)`` of ``(vec_id, embedding)``; unit is null where nothing links."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(1):
                unit = None
                if value.is_valid and len(value) and value.values.null_count == 0:
                    x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top
                        unit = (x / math.sqrt(float(x @ x))).tobytes()
                found.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "unit"])

    return vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding").mapInArrow(scale, UNIT)


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, from above by at most a rounding error."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def net(x: np.ndarray, radius: float, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres within ``radius`` of every row (``first`` among them), and each row's."""
    centres = list(first)
    owner = np.empty(len(x), np.int64)
    for at in range(0, len(x), CHUNK):
        rows = x[at : at + CHUNK]
        best, own = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        for c in range(0, len(centres), CHUNK):
            d = _gaps(rows, x[centres[c : c + CHUNK]])
            k = d.argmin(1)
            near = d[np.arange(len(rows)), k]
            own = np.where(near < best, c + k, own)
            best = np.minimum(best, near)
        while True:
            far = np.flatnonzero(best > radius)
            if not len(far):
                break
            centres.append(at + int(far[0]))
            d = _gaps(rows, x[centres[-1]][None, :])[:, 0]
            d[far[0]] = 0.0
            own = np.where(d < best, len(centres) - 1, own)
            best = np.minimum(best, d)
        owner[at : at + CHUNK] = own
    return np.array(centres, np.int64), owner


def top_cells(sample: np.ndarray, most: int) -> np.ndarray:
    """Centres of the deepest level that has at most ``most`` of them."""
    centres, radius = np.zeros(min(len(sample), 1), np.int64), 2.0
    while len(sample) and radius > 1e-3:
        finer, _ = net(sample, radius / 2, centres)
        if len(finer) > most:
            break
        centres, radius = finer, radius / 2
    return sample[centres]


def paths(x: np.ndarray, reach: float) -> np.ndarray:
    """Row of the centre of every vector at each level of a block, coarsest first."""
    levels = [np.zeros(len(x), np.int64)]
    radius = 1.0
    while radius > reach / 8:
        radius /= 2
        above, below = levels[-1], np.empty(len(x), np.int64)
        order = np.argsort(above, kind="stable")
        cuts = np.flatnonzero(np.r_[True, above[order][1:] != above[order][:-1]])
        for rows in np.split(order, cuts[1:]):
            if len(rows) == 1:
                below[rows] = rows
                continue
            inside, owner = net(x[rows], radius, np.flatnonzero(rows == above[rows[0]]))
            below[rows] = rows[inside][owner]
        levels.append(below)
        if (below == np.arange(len(x))).all():
            break
    return np.stack(levels, 1)


class Tree:
    """Levels of nodes over the vectors of a block, each node with its covering radius."""

    def __init__(self, x: np.ndarray, path: np.ndarray):
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        self.children: list[list[np.ndarray]] = []
        parents = np.zeros(len(x), np.int64)
        for level in range(path.shape[1]):
            centres, node = np.unique(path[:, level], return_inverse=True)
            order = np.argsort(node, kind="stable")
            members = np.split(order, np.searchsorted(node[order], np.arange(1, len(centres))))
            if level:
                above = parents[[m[0] for m in members]]
                kids = np.argsort(above, kind="stable")
                most = len(self.levels[-1][0])
                self.children.append(np.split(kids, np.searchsorted(above[kids], np.arange(1, most))))
            self._level(centres, members)
            parents = node

    def _level(self, centres: np.ndarray, members: list[np.ndarray]) -> None:
        radii = np.array([_gaps(self.x[m], self.x[c][None, :]).max() if len(m) > 1 else 0.0 for c, m in zip(centres, members)])
        self.levels.append((centres, radii, members))


class _Sets:
    """Sets of rows that links have joined; the smallest row stands for a set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def links(a: Tree, b: Tree | None, weight_a, weight_b, cosine: float):
    """Weighted link counts of both sides and the sets that links join.

    With ``b`` None, the pairs inside ``a``; a vector is no partner of itself.
    """
    own = b is None
    b, weight_b = (a, weight_a) if own else (b, weight_b)
    reach = math.sqrt(2.0 - 2.0 * cosine)
    shift = 0 if own else len(a.x)
    sets = _Sets(len(a.x) + (0 if own else len(b.x)))
    n_a, n_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)

    def whole(rows, columns) -> None:
        n_a[rows] += weight_b[columns].sum()
        n_b[columns] += weight_a[rows].sum()
        for c in columns:
            sets.join(rows[0], shift + c)
        for r in rows[1:]:
            sets.join(r, shift + columns[0])

    def direct(rows, columns, same: bool) -> None:
        for at in range(0, len(rows), CHUNK):
            some = rows[at : at + CHUNK]
            hit = a.x[some] @ b.x[columns].T >= cosine
            if same:
                hit[np.arange(len(some)), at + np.arange(len(some))] = False
            n_a[some] += hit @ weight_b[columns]
            if not same:
                n_b[columns] += weight_a[some] @ hit
            for i in np.flatnonzero(hit.any(1)):
                for j in columns[np.flatnonzero(hit[i])]:
                    sets.join(some[i], shift + j)

    def visit(level: int, i: int, j: int, apart: float) -> None:
        rows, columns = a.levels[min(level, len(a.levels) - 1)][2][i], b.levels[min(level, len(b.levels) - 1)][2][j]
        same = own and i == j
        spread = a.levels[min(level, len(a.levels) - 1)][1][i] + b.levels[min(level, len(b.levels) - 1)][1][j]
        if not same and apart + spread <= reach - SLACK:
            whole(rows, columns)
        elif len(rows) * len(columns) <= DIRECT or level + 1 >= max(len(a.levels), len(b.levels)):
            direct(rows, columns, same)
        else:
            left = a.children[level][i] if level < len(a.children) else np.array([i])
            right = b.children[level][j] if level < len(b.children) else np.array([j])
            pairs(level + 1, left, right, same)

    def pairs(level: int, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        ca, ra, _ = a.levels[min(level, len(a.levels) - 1)]
        cb, rb, _ = b.levels[min(level, len(b.levels) - 1)]
        for at in range(0, len(left), CHUNK):
            some = left[at : at + CHUNK]
            d = _gaps(a.x[ca[some]], b.x[cb[right]])
            near = d <= ra[some][:, None] + rb[right][None, :] + reach + SLACK
            if same:
                near &= some[:, None] <= right[None, :]
            for u, v in zip(*np.nonzero(near)):
                visit(level, some[u], right[v], d[u, v])

    if len(a.x) and len(b.x):
        pairs(0, np.zeros(1, np.int64), np.zeros(1, np.int64), own)
    if own:
        n_a, n_b = n_a + n_b, n_b[:0]
    return n_a, n_b, sets


def near_duplicates(vectors: DataFrame, cosine: float) -> DataFrame:
    """``id, n_links, component_id`` of every row of ``(vec_id, embedding)``."""
    spark = vectors.sparkSession
    rows = saved(units(vectors), "units")
    valid = F.col("unit").isNotNull() & F.col("id").isNotNull()
    classes = rows.where(valid).groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    classes = saved(classes, "vector-classes")
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("unit").collect()
    if not sample:  # no vector that could link
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    tops: dict[int, tuple[int, np.ndarray]] = {}  # bytes of a vector: first cell, centres
    cells = 0
    for size in sorted({len(r["unit"]) for r in sample}):
        points = [bytes(r["unit"]) for r in sample if len(r["unit"]) == size]
        centres = top_cells(np.frombuffer(b"".join(points), np.float64).reshape(len(points), -1), MAX_CELLS)
        tops[size] = cells, centres
        cells += len(centres)

    def assign(batches):
        for batch in batches:
            size = np.array([len(u) for u in batch.column(2).to_pylist()], np.int64)
            cell, far = -size, np.full(len(size), 2.0)
            for each in np.unique(size):
                if int(each) in tops:
                    first_cell, centres = tops[int(each)]
                    at = np.flatnonzero(size == each)
                    d = _gaps(_matrix(batch.column(2).take(pa.array(at))), centres)
                    own = d.argmin(1)
                    cell[at], far[at] = first_cell + own, d[np.arange(len(at)), own]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int64()), pa.array(far)], [*batch.schema.names, "cell", "far"]
            )

    dealt = saved(
        classes.select("id", "weight", "unit").mapInArrow(
            assign, "id long, weight long, unit binary, cell long, far double"
        ),
        "cells",
    )
    # One row per cell: SAMPLE at most, and one for each length that the sample missed.
    held = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    size_of = {at + i: size for size, (at, centres) in tops.items() for i in range(len(centres))}
    blocks, first = [], 0
    for c in sorted(held, key=lambda r: r["cell"]):
        n = -(-c["n"] // BLOCK_ROWS)
        blocks.append((c["cell"], first, n, c["radius"]))
        first += n
    reach = math.sqrt(2.0 - 2.0 * cosine)
    # Pairs of cells are few; Spark lists the pairs of their blocks, which grow with the rows.
    partners: list[tuple[int, int, int, int]] = []
    for cell, at, n, _ in blocks:
        partners.append((at, at + n - 1, at, at + n - 1))
    for size, (start_cell, centres) in tops.items():
        own = [b for b in blocks if size_of.get(b[0]) == size]
        apart = _gaps(centres, centres)
        for i, (cell, at, n, radius) in enumerate(own):
            for other, start, m, far in own[i + 1 :]:
                if apart[cell - start_cell, other - start_cell] <= radius + far + reach + SLACK:
                    partners.append((at, at + n - 1, start, start + m - 1))
    depth = 1
    while 0.5 ** (depth - 1) > reach / 8:
        depth += 1
    plan = spark.createDataFrame(blocks, "cell long, first long, n long, radius double").select("cell", "first", "n")
    near = (
        spark.createDataFrame(partners, "x0 long, x1 long, y0 long, y1 long")
        .select(F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1")
        .repartition("x")
        .select("x", F.explode(F.sequence("y0", "y1")).alias("y"))
        .where("x <= y")
        .withColumn("pair", F.col("x") * F.lit(first).cast("long") + F.col("y"))
    )
    sides = near.select(F.col("x").alias("block"), "pair", F.lit(0).alias("side")).union(
        near.where("x <> y").select("y", "pair", F.lit(1))
    )
    blocked = dealt.join(F.broadcast(plan), "cell").select(
        "id", "weight", "unit", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).alias("block")
    )

    def level(table: pa.Table) -> pa.Table:
        """The levels of one block, built once for all tasks that compare it."""
        table = table.combine_chunks().sort_by("id")
        ids, path = table.column("id").to_numpy(), paths(_matrix(table.column("unit")), reach)
        path = np.concatenate([path] + [path[:, -1:]] * (depth - path.shape[1]), 1)
        centres = pa.FixedSizeListArray.from_arrays(pa.array(ids[path].ravel()), depth).cast(pa.list_(pa.int64()))
        return table.append_column("path", centres)

    kept = "id long, weight long, unit binary, block long, path array<long>"
    blocked = saved(blocked.groupBy("block").applyInArrow(level, kept), "blocks")

    def compare(table: pa.Table) -> pa.Table:
        parts = []
        for side in (0, 1):
            own = table.filter(pa.array(table.column("side").to_numpy() == side))
            ids = own.column("id").to_numpy()
            order = np.argsort(ids)
            x = _matrix(own.column("unit"))
            tree = None
            if len(ids):
                path = np.concatenate([c.flatten().to_numpy() for c in own.column("path").chunks])
                path = np.searchsorted(ids[order], path.reshape(len(ids), depth)[order])
                tree = Tree(x[order], path)
            parts.append((ids[order], own.column("weight").to_numpy()[order], tree))
        (ids, weight, a), (ids_b, weight_b, b) = parts
        x, y = divmod(table.column("pair")[0].as_py(), first)
        if a is None or (x != y and b is None):  # the other block got no vector
            none = pa.array([], pa.int64())
            return pa.table({"id": none, "links": none, "root": none})
        n_a, n_b, sets = links(a, b, weight, weight_b, cosine)
        every = np.concatenate([ids, ids_b]) if len(ids_b) else ids
        roots = every[[sets.find(i) for i in range(len(every))]]
        counts = np.concatenate([n_a, n_b])
        linked = counts > 0
        return pa.table(
            {
                "id": pa.array(every[linked], pa.int64()),
                "links": pa.array(counts[linked], pa.int64()),
                "root": pa.array(roots[linked], pa.int64()),
            }
        )

    found = saved(
        blocked.join(sides, "block")
        .select("pair", "side", "id", "weight", "unit", "path")
        .groupBy("pair")
        .applyInArrow(compare, "id long, links long, root long"),
        "vector-links",
    )
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.select("id", "weight", "unit")
        .join(counts, "id", "left")
        .join(grouped, "id", "left")
        .select(
            "unit",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
    )
    return (
        rows.withColumn("unit", F.when(valid, F.col("unit")))
        .join(of_class, "unit", "left")
        .select(
            "id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
    )
