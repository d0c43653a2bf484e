"""Document fingerprints: digests of quartile codes over buckets of byte triplets.

Every three consecutive bytes of a text are hashed into one of 512 buckets. The
three quartiles of the buckets' counts give each bucket a code of two bits: in
which quarter its count lies. A digest is a code of the length (eight steps for
each doubling) and the codes of all buckets. The difference of two digests is the
sum of the steps between their codes plus a weighted difference of the length
codes, and is bounded; likeness is what the bound leaves, from 0 to 1.

Texts of one kind share many triplets, which adds about as much to every digest;
what a text says moves the rarer ones, so copies, edited ones too, stay close.

``beside_next`` also compares each document with an edited one and with the next.
Texts are sorted by range once; a task pairs its own documents and puts its first
and last one aside, and these few are paired afterwards.

Defined cases: a null text is an empty one, whose digest is all zeros; texts below
three bytes differ by length alone; equal texts have equal digests; very long texts
are counted in parts; documents that share an id are ordered by a hash of the text,
then as they lie in the input; null ids come last; a single document is its own
next one; an empty table gives no row; other columns are left out of
``beside_next`` and travel in ``rest`` of ``fingerprints``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import narrowed, saved

BUCKETS = 512
#: Multiplier of the hash of a triplet; the highest bits of 32 tell the bucket.
FACTOR, KEPT_SHIFT = 2654435761, 23
#: A step of the length code weighs as much as this many steps between codes.
LENGTH_WEIGHT = 30
#: Differences from here on count alike: half of the most that codes can differ.
BOUND = BUCKETS * 3 // 2
#: Bytes of a text counted at once.
PART_BYTES = 1 << 20
LENGTH_BYTES = 2


def bucket_counts(data: bytes) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, max(len(data) - 2, 0), PART_BYTES):
        part = whole[begin : begin + PART_BYTES + 2].astype(np.uint32)
        triplets = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        triplets *= np.uint32(FACTOR)
        out += np.bincount(triplets >> np.uint32(KEPT_SHIFT), minlength=BUCKETS)
    return out


def length_code(n: int) -> int:
    """Eight codes for each doubling of the length."""
    bits = n.bit_length()
    return 8 * bits + ((n << 3 >> (bits - 1)) & 7) if n else 0


def digest_of(data: bytes) -> bytes:
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    quartiles = ordered[[BUCKETS * q // 4 - 1 for q in (1, 2, 3)]]
    codes = (counts[:, None] > quartiles).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = codes @ np.array([64, 16, 4, 1], np.uint8)
    return length_code(len(data)).to_bytes(LENGTH_BYTES, "big") + packed.astype(np.uint8).tobytes()


def _codes(digest: bytes) -> np.ndarray:
    packed = np.frombuffer(digest, np.uint8, offset=LENGTH_BYTES)
    return (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).astype(np.int8)


def difference(left: bytes, right: bytes) -> int:
    """Bounded difference of two digests: 0 for equal ones, at most ``BOUND``."""
    lengths = (int.from_bytes(d[:LENGTH_BYTES], "big") for d in (left, right))
    steps = int(np.abs(_codes(left) - _codes(right)).sum(dtype=np.int64))
    return min(BOUND, steps + LENGTH_WEIGHT * abs(next(lengths) - next(lengths)))


def likeness_of(left: bytes, right: bytes) -> float:
    return 1.0 - difference(left, right) / BOUND


def likeness(left: Column, right: Column) -> Column:
    """Likeness of two columns of hexadecimal fingerprints; null if one is null."""

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [None if x is None or y is None else likeness_of(bytes.fromhex(x), bytes.fromhex(y)) for x, y in zip(a, b)],
            dtype="float64",
        )

    return compare(left, right)


def _hex(name: str) -> Column:
    return F.lower(F.hex(name)).alias(name)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, rest, fingerprint`` of every row; nothing is shuffled."""
    source = narrowed(docs, "doc_id", "text").select("doc_id", "rest", "text")
    schema = T.StructType([*source.schema.fields[:2], T.StructField("fingerprint", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [digest_of((t or "").encode("utf-8")) for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema).select("doc_id", "rest", _hex("fingerprint"))


def edited(text: str, following: str) -> str:
    """The second half of a text replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Rows:
    """Rows on their way out of a task, handed over in batches."""

    def __init__(self, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.rows, self.size = to_arrow_schema(schema), [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.size += 1024 + size

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        made = [pa.array(c, f.type) for c, f in zip(columns, self.schema)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(made, schema=self.schema)


def _compared(doc_id, text: str, digest: bytes, following: str, next_digest: bytes) -> tuple:
    changed = edited(text, following).encode("utf-8")
    own = digest_of(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed).digest(), digest, own,
        likeness_of(digest, own), likeness_of(digest, next_digest),
    )


def _fields(doc_id: T.StructField) -> list[T.StructField]:
    return [
        doc_id,
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.BinaryType()),
        T.StructField("fingerprint", T.BinaryType()),
        T.StructField("edited_fingerprint", T.BinaryType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]


def beside_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` of every row of ``docs`` (doc_id, text)."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")
    ).withColumn("hash", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("row")]
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    results = _fields(docs.schema["doc_id"])
    # A row with ``place`` is a task's first (0) or last (1) document, put aside.
    aside = [T.StructField("place", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())]
    schema = T.StructType([*results, *aside])

    def edge(doc_id, text: str, digest: bytes, place: int) -> tuple:
        part = TaskContext.get().partitionId()
        return (doc_id, len(text), None, digest, None, None, None, place, part, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = _Rows(schema), None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                digest = digest_of(text.encode("utf-8"))
                if last is None:
                    out.add(edge(doc_id, text, digest, 0), len(text))
                else:
                    out.add((*_compared(*last, text, digest), None, None, None))
                last = (doc_id, text, digest)
                if out.size > PART_BYTES:
                    yield out.taken()
        if last is not None:
            out.add(edge(*last, 1), len(last[1]))
        yield out.taken()

    paired = saved(ordered.mapInArrow(run, schema), "beside-next")
    shown = [f.name for f in results]
    inner = paired.where("place is null").select(*shown)
    return inner.union(_at_edges(paired, results)).select(
        "doc_id", "n_chars", _hex("edited_sha256"), _hex("fingerprint"), _hex("edited_fingerprint"),
        "near_edited", "near_next",
    )


def _at_edges(paired: DataFrame, results: list[T.StructField]) -> DataFrame:
    """Results of the last document of every task: its next one is the first of the
    next task that had rows, and the first of all after the last."""
    firsts = paired.where("place = 0").select(
        F.col("part").alias("after"), F.col("text").alias("following"), F.col("fingerprint").alias("next_digest")
    )
    lasts = paired.where("place = 1").select("part", "doc_id", "text", "fingerprint")
    # One short row for each task.
    tasks = W.orderBy("part")
    whole = tasks.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    chain = paired.where("place = 0").select("part").select(
        "part", F.coalesce(F.lead("part").over(tasks), F.first("part").over(whole)).alias("after")
    )
    schema = T.StructType(results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Rows(schema)
            for row in zip(*(batch.column(i) for i in range(5))):
                out.add(_compared(*(v.as_py() for v in row)))
            yield out.taken()

    sides = lasts.join(chain, "part").join(firsts, "after")
    return sides.select("doc_id", "text", "fingerprint", "following", "next_digest").mapInArrow(run, schema)
