"""Length-delimited binary files of token ids, with an offset index beside each.

A file holds records one after another. A record is: its payload's length (8 bytes,
little endian), the masked checksum of those 8 bytes (4 bytes), the payload, the
masked checksum of the payload (4 bytes). The payload is the ids as little-endian
unsigned integers of 2 bytes where the vocabulary allows it, else 4. The index
beside a file has one entry per record: doc_id, byte offset, number of ids.

Files are written by Spark tasks over ranges of doc_id, each under a name of its
own; only the files of tasks that succeeded get into the manifest, so a task that
is repeated after an executor is lost leaves nothing that is read. The manifest has
one row per file.

Defined cases: null and empty texts are records of the end id alone; a null doc_id
comes first; repeated doc_ids are separate records ordered by text; an empty table
gives no file; other columns are not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved
from .tokens import crc, encoder_of, framed

INDEX = np.dtype([("doc_id", "<i8"), ("known", "<u1"), ("offset", "<u8"), ("n", "<u8")])
MASK_DELTA = 0xA282EAD8
HEAD = "<QI"
READ_BYTES = 8 << 20
MANIFEST = "shard long, file string, docs long, ids long, bytes long, width int"


def masked(checksum: int) -> int:
    """A checksum turned and shifted, so that checksums of stored checksums stay useful."""
    return (((checksum >> 15) | (checksum << 17)) + MASK_DELTA) & 0xFFFFFFFF


def record(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join(
        (
            size,
            struct.pack("<I", masked(zlib.crc32(size))),
            payload,
            struct.pack("<I", masked(zlib.crc32(payload))),
        )
    )


def read_record(stream) -> bytes | None:
    """The next payload of an open file, None at its end; damage raises ValueError."""
    head = stream.read(struct.calcsize(HEAD))
    if not head:
        return None
    if len(head) < struct.calcsize(HEAD):
        raise ValueError("record cut short")
    size, check = struct.unpack(HEAD, head)
    if masked(zlib.crc32(head[:8])) != check:
        raise ValueError("damaged record length")
    payload = stream.read(size)
    tail = stream.read(4)
    if len(payload) < size or len(tail) < 4:
        raise ValueError("record cut short")
    if masked(zlib.crc32(payload)) != struct.unpack("<I", tail)[0]:
        raise ValueError("damaged record")
    return payload


def opened(uri: str):
    """File system and path of a folder that driver and executors share."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files in ascending doc_id; the manifest."""
    folder = folder or new_path(docs.sparkSession, "records")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        system, at = opened(folder)
        system.create_dir(at, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        entries, total, offset, stream = [], 0, 0, None
        try:
            for batch in batches:
                for doc_id, own in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1))):
                    if stream is None:
                        stream = system.open_output_stream(f"{at}/{name}.bin")
                    ids = framed(own, end)
                    data = record(ids.astype(f"<u{width}").tobytes())
                    stream.write(data)
                    entries.append((doc_id or 0, doc_id is not None, offset, len(ids)))
                    offset += len(data)
                    total += len(ids)
        finally:
            if stream is not None:
                stream.close()
        if stream is not None:
            with system.open_output_stream(f"{at}/{name}.idx") as index:
                index.write(np.array(entries, INDEX).tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": [shard],
                    "file": [f"{folder}/{name}"],
                    "docs": [len(entries)],
                    "ids": [total],
                    "bytes": [offset],
                    "width": pa.array([width], pa.int32()),
                }
            )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(files, MANIFEST), "manifest")


def _bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids in earlier files; one row per file."""
    rows, base, out = manifest.orderBy("shard").collect(), 0, []
    for r in rows:
        out.append((r["file"], base, r["docs"], r["width"]))
        base += r["ids"]
    spark = manifest.sparkSession
    frame = spark.createDataFrame(out, "file string, base long, docs long, width int")
    return frame.repartition(max(len(out), 1), "file") if out else frame


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, from the files alone."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, at = opened(row["file"])
                with system.open_input_stream(f"{at}.idx") as index:
                    entries = np.frombuffer(index.read(), INDEX)
                if len(entries) != row["docs"]:
                    raise ValueError(f"index of {row['file']} does not fit its file")
                starts = row["base"] + np.cumsum(entries["n"]).astype(np.int64) - entries["n"].astype(np.int64)
                with system.open_input_stream(f"{at}.bin", buffer_size=READ_BYTES) as stream:
                    sums = []
                    for entry in entries:
                        ids = np.frombuffer(read_record(stream), f"<u{row['width']}")
                        if len(ids) != entry["n"]:
                            raise ValueError(f"index of {row['file']} does not fit its file")
                        sums.append(crc(ids))
                    if read_record(stream) is not None:
                        raise ValueError(f"{row['file']} has records without an entry")
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(entries["doc_id"], mask=entries["known"] == 0),
                        "start": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(entries["n"].astype(np.int64)),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )

    return _bases(manifest).mapInArrow(records, "doc_id long, start long, n_tokens long, ids_crc32 long")


def index(manifest: DataFrame) -> DataFrame:
    """``doc_id, file, offset, n_tokens, width`` of every record, from the indexes."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, at = opened(row["file"])
                with system.open_input_stream(f"{at}.idx") as stream:
                    found = np.frombuffer(stream.read(), INDEX)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(found["doc_id"], mask=found["known"] == 0),
                        "file": [row["file"]] * len(found),
                        "offset": pa.array(found["offset"].astype(np.int64)),
                        "n_tokens": pa.array(found["n"].astype(np.int64)),
                        "width": pa.array([row["width"]] * len(found), pa.int32()),
                    }
                )

    return _bases(manifest).mapInArrow(
        entries, "doc_id long, file string, offset long, n_tokens long, width int"
    )


def fetch(wanted: DataFrame) -> DataFrame:
    """``wanted`` rows of an index, in any order, with their ``ids``: one seek each."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, streams = [], {}
            try:
                for row in batch.select(["file", "offset", "width"]).to_pylist():
                    if row["file"] not in streams:
                        system, at = opened(row["file"])
                        streams[row["file"]] = system.open_input_file(f"{at}.bin")
                    streams[row["file"]].seek(row["offset"])
                    payload = read_record(streams[row["file"]])
                    found.append(np.frombuffer(payload, f"<u{row['width']}").astype(np.int64))
            finally:
                for stream in streams.values():
                    stream.close()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "ids"]
            )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    return wanted.mapInArrow(ids, f"{columns}, ids array<bigint>")


def read_all(spark: SparkSession, manifest: DataFrame, seed: int) -> DataFrame:
    """All records in a shuffled order that a seed fixes."""
    return fetch(index(manifest).orderBy(F.xxhash64(F.lit(seed), "file", "offset")))
