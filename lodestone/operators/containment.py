"""Which texts contain which answers, as literal substrings.

All answers are looked up in one pass over each text with an Aho-Corasick
automaton, so the cost follows text length and not texts times answers. Answers
beyond the broadcast bound are told by fingerprints of bounded size instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from .blocks import arrow_schema


def _automaton(pairs):
    import ahocorasick

    machine = ahocorasick.Automaton()
    owners: dict[str, list] = {}
    always = []
    for key, answer in pairs:
        if answer == "":
            always.append(key)
        elif answer is not None:
            owners.setdefault(answer, []).append(key)
    for answer, keys in owners.items():
        machine.add_word(answer, keys)
    if owners:
        machine.make_automaton()
    return (machine if owners else None), always


def _matches(machine, always, text):
    found = set(always)
    if machine is not None and text:
        for _, keys in machine.iter(text):
            found.update(keys)
    return found


def containing(
    texts: DataFrame,
    answers: DataFrame,
    keep: tuple[str, ...],
    text: str = "text",
    limit: int | None = None,
) -> DataFrame:
    """``(query_id, *keep)`` for every text holding the query's ``answer``.

    Without ``keep`` a query may appear any number of times, but at least once
    if some text holds its answer.
    """
    answers = answers.select("query_id", "answer")
    columns = list(keep)
    schema = T.StructType([answers.schema["query_id"]] + [texts.schema[c] for c in columns])
    texts = texts.select(*columns, F.col(text).alias("_text"))
    limit = session.BROADCAST_BYTES if limit is None else limit
    row_bytes = F.coalesce(F.octet_length("answer"), F.lit(0)) * 4 + 64
    size = answers.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()["b"]

    key_type = arrow_schema(schema).field(0).type

    def look(batch, machine, always):
        rows, keys = [], []
        for row, value in enumerate(batch.column("_text").to_pylist()):
            for key in _matches(machine, always, value):
                rows.append(row)
                keys.append(key)
        taken = batch.select(columns).take(pa.array(rows, pa.int64()))
        arrays = [pa.array(keys, key_type)] + [taken.column(name) for name in columns]
        return arrays

    if size <= limit:
        pairs = [(row["query_id"], row["answer"]) for row in answers.collect()]
        shared = texts.sparkSession.sparkContext.broadcast(pairs)

        def scan(batches):
            machine, always = _automaton(shared.value)
            if not columns:
                # Only the queries matter: a task reports each of them once.
                seen = set()
                for batch in batches:
                    for value in batch.column("_text").to_pylist():
                        seen |= _matches(machine, always, value)
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), key_type)], ["query_id"])
                return
            for batch in batches:
                arrays = look(batch, machine, always)
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", *columns])

        return texts.mapInArrow(scan, schema)

    return _by_fingerprints(texts, answers, columns, schema)


# --- more answers than fit every task ---------------------------------------

#: Odd factor of the rolling hash; bits of the filter at most, and bits per answer.
FACTOR, MOST_BITS, BITS_PER_ANSWER, PROBES = 0x9E3779B97F4A7C15, 1 << 29, 16, 3
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of a text that are hashed at once.
PIECE_BYTES = 1 << 20


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def run_hashes(data: bytes, widths: list[int]):
    """``(width, hashes)`` of every run of so many bytes; widths are powers of two.

    The hashes of runs of twice a width follow from those of two runs beside each
    other, so all widths together cost their number times the length.
    """
    hashes, width, step = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 1, FACTOR
    for wanted in sorted(widths):
        while width < wanted:
            hashes = hashes[:-width] * np.uint64(step) + hashes[width:] if len(hashes) > width else hashes[:0]
            step = step * step % (1 << 64)
            width *= 2
        yield wanted, _mixed(hashes + np.uint64(width))


def _width_of(size: int) -> int:
    """The longest power of two that fits an answer: its length class."""
    return 1 << (size.bit_length() - 1)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of a filter of ``bits`` bits that stand for each hash."""
    steps = np.arange(PROBES, dtype=np.uint64) * np.uint64(FACTOR)
    return _mixed(hashes[:, None] + steps) & np.uint64(bits - 1)


def _fingerprints(answers: DataFrame) -> DataFrame:
    """``(query_id, answer, width, hash)``: the hash of an answer's first bytes."""
    key = answers.schema["query_id"]
    kinds = [key, *(T.StructField(n, t) for n, t in (("answer", T.BinaryType()), ("width", T.IntegerType()), ("hash", T.LongType())))]

    def run(batches):
        for batch in batches:
            width, found = [], []
            for value in batch.column("answer").to_pylist():
                width.append(_width_of(len(value)))
                hashes = next(run_hashes(value[: width[-1]], width[-1:]))[1]
                found.append(int(hashes.view(np.int64)[0]))
            columns = [*batch.columns, pa.array(width, pa.int32()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "answer", "width", "hash"])

    known = answers.where(F.length("answer") > 0).select("query_id", F.col("answer").cast("binary").alias("answer"))
    return known.mapInArrow(run, T.StructType(kinds))


def _filter_of(prints: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the fingerprints, as words of 64 bits. Tasks add up their own
    bits; the driver sees one row per word that is not zero."""

    def run(batches):
        for batch in batches:
            at = _places(batch.column("hash").to_numpy().view(np.uint64), bits).ravel()
            mask = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            word = (at >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask)], ["word", "mask"])

    set_bits = prints.select("hash").mapInArrow(run, "word long, mask long")
    table = set_bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(max(bits // 64, 1), np.uint64)
    words[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return words


def _candidates(data: bytes, widths: list[int], words: np.ndarray, bits: int) -> dict:
    """Distinct ``(width, hash, bytes)`` of a text that may be the beginnings of
    answers; the bytes reach as far as an answer of that class can."""
    found, most = {}, 2 * max(widths)
    for begin in range(0, len(data), PIECE_BYTES):
        piece = data[begin : begin + PIECE_BYTES + most]
        for width, hashes in run_hashes(piece, widths):
            hashes = hashes[: min(PIECE_BYTES, len(hashes))]
            at = _places(hashes, bits)
            hit = (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)
            for place in np.flatnonzero(hit).tolist():
                value = int(hashes[place : place + 1].view(np.int64)[0])
                found[width, value, piece[place : place + 2 * width - 1]] = None
    return found


def _by_fingerprints(texts, answers, columns, schema):
    """The same rows where the answers are too many to be sent to every task.

    Texts stay where they are. A task looks the hashes of their byte runs up in a
    filter of bounded size, and only what passes, the bytes an answer may cover,
    meets the answers, by hash; there the bytes are compared.
    """
    prints = _fingerprints(answers).persist(StorageLevel.MEMORY_AND_DISK)
    seen = prints.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("widths")).first()
    bits = 64
    while bits < min(MOST_BITS, BITS_PER_ANSWER * seen["n"]):
        bits *= 2
    widths = sorted(seen["widths"])
    always = answers.where("answer = ''").select("query_id")
    everywhere = texts.select(*columns).crossJoin(always).select("query_id", *columns)
    if not columns:
        everywhere = always.where(F.lit(not always.isEmpty() and not texts.isEmpty())).distinct()
    if not widths:
        return everywhere
    shared = texts.sparkSession.sparkContext.broadcast(_filter_of(prints, bits))
    numbered = texts.withColumn("_row", F.monotonically_increasing_id())
    kept = [numbered.schema[c] for c in [*columns, "_row"]]
    kinds = [("width", T.IntegerType()), ("hash", T.LongType()), ("bytes", T.BinaryType())]
    found_schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in kinds)])

    def look(batches):
        words = shared.value
        for batch in batches:
            rows, found = [], []
            for row, value in enumerate(batch.column("_text").to_pylist()):
                if value:
                    own = _candidates(value.encode("utf-8"), widths, words, bits)
                    rows += [row] * len(own)
                    found += own
            taken = batch.select([*columns, "_row"]).take(pa.array(rows, pa.int64()))
            parts = list(zip(*found)) or [(), (), ()]
            arrays = [pa.array(p, t) for p, t in zip(parts, (pa.int32(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*taken.columns, *arrays], names=found_schema.names)

    met = numbered.mapInArrow(look, found_schema).join(prints, ["width", "hash"])
    held = met.where(F.startswith("bytes", "answer"))
    once = held.dropDuplicates(["query_id"] if not columns else ["_row", "query_id"])
    return once.select("query_id", *columns).unionByName(everywhere)


def intact(chunks: DataFrame, questions: DataFrame, **options) -> DataFrame:
    """``(query_id, intact)``: does any single chunk hold the whole answer?"""
    found = containing(chunks, questions, (), **options).distinct().withColumn("_hit", F.lit(True))
    return questions.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("_hit", F.lit(False)).alias("intact")
    )
