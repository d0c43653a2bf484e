"""N-gram Jaccard join: which documents share enough of their word shingles.

Candidates come from a prefix filter over the document by n-gram incidence matrix, in
blocks per n-gram and only where the sizes leave a chance; they are verified on whole
sets. No partial overlaps are written: common n-grams have too many pairs. For a
threshold t, two sets of sizes
n <= m can only reach it if n >= t*m, and only if they share one of the first
n - ceil(t*n) + 1 n-grams of an order that all documents use; only these entries
of the matrix are blocked by n-gram and meet. The order takes n-grams that a
sample found frequent last, then hashes; any order is right, this one keeps
columns short. Counts per bucket of the hash (a row of fixed size) bound the
overlap from above and discard most of what is left; the overlap of the rest is
counted on the whole sets.

Sets that are equal are one class before anything is compared, so exact copies
cost one row each. Links are found in three passes. First each document meets a
few neighbours in the blocks of its lowest n-grams, and links make components; then
the documents with most links there meet those of other components; then all blocks
are compared in full, but only between members of different components.
A group of near copies thus costs its size, not its square, and no link that joins
two components is lost. Components need no more.

The links themselves all lie inside components, so they are a second product, of
the members of each component: those of similar size are dealt into parts, and a
task multiplies two parts, adding overlaps up over blocks of n-grams. It gives every
link between different sets, as many as there are (the square of a group in which
all are near copies), and runs only where the links are read.

Defined cases: a null, empty or blank text has no n-gram and links with nothing;
rows that share a doc_id count as one document; a null doc_id links with nothing;
an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, delete_all, saved, sent_if_small, small_batches, written
from .shingles import fingerprint, shingle_set

#: Share of documents whose n-grams are counted to find frequent ones: 1 in so many.
ORDER_SAMPLE = 8
#: Seen so often in the sample, an n-gram goes last; so many at most (8 bytes each).
FREQUENT, FREQUENT_MOST = 15, 200_000
BUCKETS = 256
#: An id and a fingerprint in a table that is sent to all tasks.
WANTED_BYTES = 64
#: First pass: n-grams of a document (its lowest hashes, which near copies share)
#: that are blocked, and neighbours it meets there.
FIRST_GRAMS, NEIGHBOURS = 3, 8
#: Pairs of a block that are looked at together.
CELLS = 1 << 18
#: Rows, with texts or whole sets, that go to Python at a time.
BATCH_ROWS = 512
#: Sets and n-grams, about, of one of the two parts of a component that a task
#: multiplies, and n-grams it takes at a time.
PART_SETS, PART_GRAMS, COLUMNS = 256, 1 << 20, 4096

SIGNED = "doc_id long, n long, fp binary, buckets binary, prefix array<long>, lowest array<long>"
PAIRS = "a long, b long"


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """N-grams that a sample of the documents often has, ascending."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k) for t in batch.column(0)]
            values, n = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(values[often])), pa.array(n[often])], ["gram", "n"]
            )

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_SAMPLE)) == 0).select("text")
    found = (
        some.mapInArrow(counts, "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FREQUENT)
        .orderBy(F.col("n").desc(), "gram")
        .limit(FREQUENT_MOST)
        .collect()
    )
    return np.sort(np.array([r["gram"] for r in found], np.int64).view(np.uint64))


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Set size, fingerprint, bucket counts and prefix of every document."""
    often = frequent(docs, k)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fps, buckets, prefixes, lowest = [], [], [], [], []
            for text in batch.column(1):
                values = shingle_set(text.as_py(), k)
                n.append(len(values))
                if not len(values):
                    for column in (fps, buckets, prefixes, lowest):
                        column.append(None)
                    continue
                late = np.isin(values, often, assume_unique=True) if len(often) else np.zeros(len(values), bool)
                take = len(values) - -(-percent * len(values) // 100) + 1
                fps.append(fingerprint(values))
                prefixes.append(_signed(np.concatenate([values[~late], values[late]])[:take]))
                lowest.append(_signed(values[:FIRST_GRAMS]))
                # Counts above 255 are stored as 255, which would lower the bound:
                # such long sets keep none and are not judged by it.
                counted = np.bincount((values & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                buckets.append(counted.astype(np.uint8).tobytes() if counted.max() < 256 else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(fps, pa.binary()),
                    pa.array(buckets, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(lowest, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "fp", "buckets", "prefix", "lowest"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, SIGNED)


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """Rows of sorted batches as arrays, one block per gram."""
    held: list[list[np.ndarray]] = []
    gram = None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", *names)]
        grams = columns[0]
        cuts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else []
        for a, b in zip(cuts, [*cuts[1:], len(grams)]):
            if held and grams[a] != gram:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            gram = grams[a]
            held.append([c[a:b] for c in columns[1:]])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _may_link(n, place, m, other, percent: int):
    """Whether sizes n <= m and the places of a shared n-gram leave a chance."""
    need = -(-percent * (n + m) // (100 + percent))
    return (100 * n >= percent * m) & (np.minimum(n - place, m - other) >= need)


def _out(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _pairs(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = ids[i], ids[j]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)


def _near(percent: int):
    """Each row of a block with the next few of it, in the order of sizes."""

    def run(batches):
        found, held = [], 0
        for ids, n in _blocks(batches, ("id", "n")):
            for step in range(1, min(NEIGHBOURS, len(ids) - 1) + 1):
                i = np.flatnonzero(100 * n[:-step] >= percent * n[step:])
                if len(i):
                    found.append(_pairs(ids, i, i + step))
                    held += len(i)
            if held > 1 << 16:
                yield _out(found)
                found, held = [], 0
        yield _out(found)

    return run


def _hubs(percent: int):
    """The rows of a block with most links so far, with those of other components."""

    def run(batches):
        found, held = [], 0
        for ids, n, component, degree in _blocks(batches, ("id", "n", "component", "degree")):
            for hub in range(min(NEIGHBOURS, len(ids))):
                if not degree[hub]:
                    break
                fits = 100 * np.minimum(n, n[hub]) >= percent * np.maximum(n, n[hub])
                i = np.flatnonzero(fits & (component != component[hub]))
                if len(i):
                    found.append(_pairs(ids, i, np.full(len(i), hub)))
                    held += len(i)
            if held > 1 << 16:
                yield _out(found)
                found, held = [], 0
        yield _out(found)

    return run


def _across(percent: int):
    """All pairs of a block that lie in different components and may link."""

    def run(batches):
        found, held = [], 0
        for ids, n, place, component in _blocks(batches, ("id", "n", "place", "component")):
            if (component == component[0]).all():
                continue
            ends = np.searchsorted(n, 100 * n // percent, "right")
            at = 0
            while at < len(ids):
                # The more rows may link with a row, the fewer of them at a time.
                most = max(CELLS // max(int(ends[at]) - at, 1), 1)
                rows = np.arange(at, min(at + most, len(ids)))
                columns = np.arange(at, ends[rows].max())
                at = rows[-1] + 1
                i, j = rows[:, None], columns[None, :]
                may = (j > i) & (component[i] != component[j])
                may &= _may_link(n[i], place[i], n[j], place[j], percent)
                x, y = np.nonzero(may)
                if len(x):
                    found.append(_pairs(ids, rows[x], columns[y]))
                    held += len(x)
                if held > 1 << 16:
                    yield _out(found)
                    found, held = [], 0
        yield _out(found)

    return run


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bucket counts allow the overlap that their sizes ask for."""
    side = classes.select("id", "n", "buckets")

    def check(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            x, y = (batch.column(c).to_pylist() for c in ("buckets_a", "buckets_b"))
            keep = np.zeros(len(n), bool)
            for i, (p, q) in enumerate(zip(x, y)):
                most = min(n[i], m[i])
                if p is not None and q is not None:
                    most = int(np.minimum(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)).sum(dtype=np.int64))
                keep[i] = (100 + percent) * most >= percent * (n[i] + m[i])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs
    for end in ("a", "b"):
        both = both.join(
            side.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("buckets").alias(f"buckets_{end}")),
            end,
        )
    return both.select("a", "b", "n_a", "n_b", "buckets_a", "buckets_b").mapInArrow(check, PAIRS)


def _whole(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The sets of the classes ``(id, fp)`` in ``wanted``, once per row that holds one.

    Texts are only shuffled if the wanted ids are too many to be sent to them.
    """

    def sets(batches):
        for batch in batches:
            ids, fps, values = [], [], []
            for i, text, fp in zip(*(batch.column(c) for c in range(3))):
                own = shingle_set(text.as_py(), k)
                if fingerprint(own) == fp.as_py():
                    ids.append(i.as_py())
                    fps.append(fp.as_py())
                    values.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(fps, pa.binary()), pa.array(values, pa.binary())],
                ["id", "fp", "grams"],
            )

    return (
        docs.select(F.col("doc_id").cast("long").alias("id"), "text")
        .join(wanted, "id")
        .select("id", "text", "fp")
        .mapInArrow(sets, "id long, fp binary, grams binary")
    )


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs that reach the threshold, by the overlap of their whole sets."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = saved(classes.select("id", "fp").join(ends, "id"), "wanted")
    whole = saved(_whole(docs, sent_if_small(wanted, WANTED_BYTES), k).select("id", "grams"), "sets")

    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return (
        pairs.join(whole.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
        .join(whole.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(check, PAIRS)
        .distinct()
    )


def overlaps(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """Overlap of every set of ``x`` with every set of ``y`` (with ``y`` None, of ``x``).

    On the diagonal of ``x`` with itself, n-grams of one set alone are not counted.
    """
    values, n = np.unique(np.concatenate([*x, *(y or [])]), return_counts=True)
    shared = values[n > 1]

    def entries(sets):
        own = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
        at = np.searchsorted(shared, own)
        in_both = np.flatnonzero(at < len(shared))
        in_both = in_both[shared[at[in_both]] == own[in_both]]
        in_both = in_both[np.argsort(at[in_both], kind="stable")]
        return row[in_both], at[in_both]

    sides = [(len(v), *entries(v)) for v in ([x] if y is None else [x, y])]
    counts = np.zeros((len(x), len(x if y is None else y)), np.int64)
    for start in range(0, len(shared), COLUMNS):
        blocks = []
        for rows, row, at in sides:
            first, end = np.searchsorted(at, [start, start + COLUMNS])
            block = np.zeros((rows, COLUMNS), np.float32)
            block[row[first:end], at[first:end] - start] = 1
            blocks.append(block)
        counts += (blocks[0] @ blocks[-1].T).astype(np.int64)
    return counts


def links_within(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """All links between the classes ``(id, fp, n, component_id)`` of a component.

    Sizes that link lie in the same band of sizes or in neighbouring ones. A band of
    a component is dealt into parts by hash, and every two parts that may link meet
    in one task.
    """
    # A little wider than the ratio of sizes allows, for the rounding of logarithms.
    width = math.log(1.0001 * 100 / percent)
    banded = members.select("id", "fp", "n", "component_id", F.floor(F.log("n") / width).alias("band"))
    bands = banded.groupBy("component_id", "band").agg(
        F.greatest(F.ceil(F.count("*") / PART_SETS), F.ceil(F.sum("n") / PART_GRAMS)).alias("parts")
    )
    beside = [
        bands.select("component_id", (F.col("band") + step).alias("band"), F.col("parts").alias(name))
        for step, name in ((-1, "above"), (1, "below"))
    ]
    for other in beside:
        bands = bands.join(other, ["component_id", "band"], "left")
    bands = bands.fillna(0, ["above", "below"])

    def seats(n, low, one, high, two, side):
        count = F.filter(F.sequence(F.lit(0).cast("long"), F.col(n)), lambda j: j < F.col(n))
        return F.transform(
            count,
            lambda j: F.struct(
                low.alias("low"), one(j).alias("one"), high.alias("high"), two(j).alias("two"), side(j).cast("int").alias("side")
            ),
        )

    band, part = F.col("band"), F.col("part")
    every = F.concat(
        seats("parts", band, lambda j: F.least(part, j), band, lambda j: F.greatest(part, j), lambda j: part > j),
        seats("above", band, lambda j: part, band + 1, lambda j: j, lambda j: F.lit(0)),
        seats("below", band - 1, lambda j: j, band, lambda j: part, lambda j: F.lit(1)),
    )

    def compare(table: pa.Table) -> pa.Table:
        # Rows that repeat a document have its set again.
        once = list({fp: i for i, fp in enumerate(table.column("fp").to_pylist())}.values())
        table = table.take(pa.array(once, pa.int64()))
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(v, np.uint64) for v in table.column("grams").to_pylist()]
        n = np.array([len(v) for v in sets], np.int64)
        own = (table.column("low")[0], table.column("one")[0]) == (table.column("high")[0], table.column("two")[0])
        i = np.flatnonzero(side == 0)
        j = i if own else np.flatnonzero(side == 1)
        found = np.empty((0, 2), np.int64)
        if len(i) and len(j):
            both = overlaps([sets[r] for r in i], None if own else [sets[r] for r in j])
            hit = (100 * both >= percent * (n[i][:, None] + n[j] - both)) & (ids[i][:, None] != ids[j])
            x, y = np.nonzero(np.triu(hit, 1) if own else hit)
            found = _pairs(ids, i[x], j[y])
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    seated = (
        banded.join(bands, ["component_id", "band"])
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .join(_whole(docs, members.select("id", "fp").hint("shuffle_hash"), k), ["id", "fp"])
        .select("id", "fp", "grams", "component_id", F.explode(every).alias("seat"))
        .select("id", "fp", "grams", "component_id", "seat.*")
    )
    met = seated.groupBy("component_id", "low", "one", "high", "two").applyInArrow(compare, PAIRS)
    return met.distinct()


def join(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents ``(doc_id, n_shingles, class_id, component_id)`` and all links.

    Links are all pairs ``(a, b)``, a < b, of ids of linked classes. They are not
    computed before they are read.
    """
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _joined(docs, k, percent)


def _joined(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    with written() as full:
        whole = saved(signatures(docs, k, percent), "signatures")
    signed = saved(whole.select("doc_id", "n", "fp"), "sizes")
    classes = saved(
        whole.where("n > 0 and doc_id is not null")
        .groupBy("fp")
        .agg(
            F.min("doc_id").alias("id"),
            F.first("n").alias("n"),
            F.first("buckets").alias("buckets"),
            F.first("prefix").alias("prefix"),
            F.first("lowest").alias("lowest"),
        ),
        "classes",
    )
    delete_all(spark, full)

    def entries(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("id", "n", *more, F.posexplode("prefix").alias("place", "gram"))

    def blocked(rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition("gram").sortWithinPartitions("gram", *order)

    def links_of(candidates: DataFrame) -> DataFrame:
        with written() as parts:
            held = saved(_bounded(candidates.distinct(), classes, percent), "pairs")
            linked = _linked(held, docs, classes, k, percent)
        links = saved(linked, "links")
        delete_all(spark, parts)
        return links

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        known = rows.join(components(links), "id", "left")
        return known.withColumn("component", F.coalesce("component_id", "id")).drop("component_id")

    lowest = classes.withColumn("prefix", F.col("lowest"))
    links = links_of(blocked(entries(lowest), "n", "id").mapInArrow(_near(percent), PAIRS))
    degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    known = labelled(lowest, links).join(degrees, "id", "left").fillna(0, ["degree"])
    hubs = blocked(entries(known, "component", "degree").withColumn("late", -F.col("degree")), "late", "id")
    links = links.union(links_of(hubs.mapInArrow(_hubs(percent), PAIRS)))
    rest = blocked(entries(labelled(classes, links), "component"), "n", "id")
    links = links.union(links_of(rest.mapInArrow(_across(percent), PAIRS)))
    # These links suffice for the components.
    grouped = components(links)
    members = (
        signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"))
        .join(classes.select("fp", F.col("id").alias("class_id")), "fp", "left")
        .join(grouped.withColumnRenamed("id", "class_id"), "class_id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("component_id", "class_id", "doc_id").alias("component_id"),
        )
    )
    linked = classes.select("id", "fp", "n").join(grouped, "id")
    return members, spark.createDataFrame([], PAIRS).union(links_within(docs, linked, k, percent))
