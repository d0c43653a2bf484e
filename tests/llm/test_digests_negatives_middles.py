"""Fingerprints, hard negatives and fill-in-the-middle against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fill_middle, quartiles, segments

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


@pytest.fixture(scope="module", params=["given", "odd", "empty"])
def docs(request, spark, sf, odd, empty):
    if request.param == "given":
        return spark.read.parquet(f"{sf}/documents.parquet")
    return {"odd": odd, "empty": empty}[request.param]


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-the-middle -------------------------------------------------------
def middle_by_units(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check_middles(docs):
    made = fill_middle.transformed(docs)
    shown = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    expected = Counter((i, *middle_by_units(i, t)) for i, t in pairs(docs))
    assert Counter(map(tuple, shown.collect())) == expected
    back = made.select("doc_id", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in pairs(docs))
    return made


def test_middles(docs):
    made = check_middles(docs)
    assert set(made.schema["rest"].dataType.names) >= set(docs.columns) - {"doc_id", "text"}
    for r in fill_middle.digest(made).collect():
        assert len(r["output_sha256"]) == len(r["restored_sha256"]) == 64


@pytest.mark.parametrize("batch_chars", [1, 40, 1 << 20])
def test_middles_of_awkward_texts(spark, monkeypatch, batch_chars):
    monkeypatch.setattr(fill_middle, "BATCH_CHARS", batch_chars)
    rng = random.Random(7)
    parts = ["a", "Zz", "1", "é", " ", "\n", "<", "<P", "S>", ">", "中", "\U0001f600", "ſ", "K", "<M>", "`", "@", "[", "{"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    check_middles(table)
    forms = {r["form"] for r in fill_middle.transformed(table).select("form").collect()}
    assert forms == {"plain", "psm", "spm"}


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols, 3)
        at = np.arange(n + 1)
        for symbol in range(8):
            assert list(matrix.rank(symbol, at)) == [int((symbols[:i] == symbol).sum()) for i in at]


# Fingerprints -------------------------------------------------------------
def digest_by_hand(text):
    data = text.encode()
    counts = [0] * 512
    for i in range(len(data) - 2):
        v = data[i] + 256 * data[i + 1] + 65536 * data[i + 2]
        counts[(v * 2654435761) % 2**32 // 2**23] += 1
    q = [sorted(counts)[i] for i in (127, 255, 383)]
    codes = [sum(c > x for x in q) for c in counts]
    n = len(data)
    length = 0 if not n else 8 * n.bit_length() + (n * 8 >> (n.bit_length() - 1)) % 8
    return f"{length:04x}" + "".join(f"{4 * a + b:x}" for a, b in zip(codes[::2], codes[1::2])), length, codes


def near_by_hand(left, right):
    (_, l1, c1), (_, l2, c2) = digest_by_hand(left), digest_by_hand(right)
    return 1 - min(768, sum(abs(a - b) for a, b in zip(c1, c2)) + 30 * abs(l1 - l2)) / 768


def beside(doc_id, text, following):
    half = len(text) // 2
    changed = text[: len(text) - half] + following[:half]
    return (
        doc_id, len(text), sha(changed), digest_by_hand(text)[0], digest_by_hand(changed)[0],
        near_by_hand(text, changed), near_by_hand(text, following),
    )


@pytest.mark.parametrize("partitions", [1, 7])
def test_fingerprints_beside_the_next(docs, partitions):
    got = Counter(map(tuple, quartiles.beside_next(docs, partitions).collect()))
    hashes = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["h"], r["t"]) for r in hashes.collect()))
    listed = [(None if none else i, t) for none, i, _, t in rows]
    expected = Counter(beside(i, t, listed[(k + 1) % len(listed)][1]) for k, (i, t) in enumerate(listed))
    assert got == expected


def test_fingerprint_of_one_document_and_of_copies(spark):
    table = spark.createDataFrame([(3, "only one text here")], "doc_id long, text string")
    row = quartiles.beside_next(table, 3).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == sha("only one " + "only one ")
    copies = spark.createDataFrame([(i, t) for i in range(40) for t in ("same text again",)], "doc_id long, text string")
    assert {r["near_next"] for r in quartiles.beside_next(copies, 5).collect()} == {1.0}


def test_fingerprints_alone_and_their_likeness(docs):
    made = quartiles.fingerprints(docs)
    assert set(made.schema["rest"].dataType.names) >= set(docs.columns) - {"doc_id", "text"}
    expected = Counter((i, digest_by_hand(t or "")[0]) for i, t in pairs(docs))
    assert Counter(map(tuple, made.select("doc_id", "fingerprint").collect())) == expected
    alike = made.select(
        quartiles.likeness(F.col("fingerprint"), F.col("fingerprint")).alias("own"),
        quartiles.likeness(F.col("fingerprint"), F.lit(None).cast("string")).alias("none"),
    ).collect()
    assert all(r["own"] == 1.0 and r["none"] is None for r in alike)


def test_counting_in_parts_counts_alike(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8))
    whole = quartiles.digest_of(data)
    monkeypatch.setattr(quartiles, "PART_BYTES", 64)
    assert quartiles.digest_of(data) == whole


def test_edited_texts_are_nearer_than_other_texts(spark, sf):
    rows = quartiles.beside_next(spark.read.parquet(f"{sf}/documents.parquet"), 4).where("n_chars > 100").collect()
    nearer = sum(r["near_edited"] > r["near_next"] for r in rows)
    assert nearer >= 0.97 * len(rows)


# Hard negatives -----------------------------------------------------------
def negatives_by_hand(rows, percent=(80, 100), k=5, scale=256):
    usable = []
    for at, (ident, label, vector) in enumerate(rows):
        if ident is None or label is None or not vector:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((at, ident, label, [math.floor(scale * x) for x in vector]))
    out = Counter()
    for at, ident, label, q in usable:
        if ident % 100:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, p)), i, r, other)
            for r, i, other, p in usable if r != at and len(p) == len(q)
        ]
        for s, i, _, _ in sorted(x for x in scored if x[3] == label)[:k]:
            fit = [x for x in sorted(scored) if x[3] != label and percent[0] * -s <= 100 * -x[0] <= percent[1] * -s]
            for rank, x in enumerate(fit[:k], 1):
                out[ident, i, rank, x[1], -s, -x[0]] += 1
    return out


def check_negatives(spark, rows, kind="float", partitions=3, **options):
    table = spark.createDataFrame(rows, f"id long, label int, vector array<{kind}>").repartition(partitions)
    # Rows that share an id are ordered as they lie in the table.
    lying = [(r["id"], r["label"], r["vector"]) for r in table.collect()]
    found = segments.hard_negatives(table, F.col("id") % 100 == 0, **options)
    assert Counter(map(tuple, found.collect())) == negatives_by_hand(lying)
    return found


@pytest.mark.parametrize("d", [1, 2, 3, 10, 64, 65])
@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_hard_negatives(spark, monkeypatch, d, block_bytes):
    monkeypatch.setattr(segments, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(segments, "ROWS_PER_STEP", 37)
    monkeypatch.setattr(segments, "ANCHORS_PER_STEP", 3)
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(5, d))
    rows = [
        (i * 10, int(rng.integers(0, 4)), [float(x) for x in np.float32(centres[i % 5] + rng.normal(size=d) * rng.choice([0.0, 0.1, 1.0]))])
        for i in range(120)
    ]
    found = check_negatives(spark, rows)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 0.5, -0.25]
    rows = [
        (0, 1, base), (0, 1, base), (0, 2, base), (1, 1, base), (2, 2, base), (3, 2, base), (3, 2, base), (-100, 2, [0.9, 0.5, -0.2]),
        (4, None, base), (None, 1, base), (5, 1, None), (6, 1, []), (7, 1, [1.0, None, 0.0]), (8, 1, [nan, 1.0, 1.0]),
        (9, 2, [inf, 1.0, 1.0]), (100, 1, [0.0, 0.0, 0.0]), (200, 3, [-1.0, -1.0, -1.0]), (300, 1, [1.0, 1.0]), (301, 1, [1.0, 1.0]),
        (302, 2, [1.0, 0.9]), (400, 1, [2.0]), (401, 1, [2.0]), (402, 2, [2.0]), (403, 2, [1.7]), (404, 2, [1.5]),
    ]
    for partitions in (1, 4):
        check_negatives(spark, rows, partitions=partitions)
    check_negatives(spark, [], partitions=1)


def test_hard_negatives_with_large_components(spark):
    rows = [(i * 50, i % 3, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(9).normal(size=(24, 6)) * 2.0**20)]
    check_negatives(spark, rows, kind="double")
    with pytest.raises(Exception, match="64 bits"):
        segments.hard_negatives(
            spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1e30])], "id long, label int, vector array<double>"), F.col("id") == 0
        )


def test_bounds_hold_and_spare_exact_scores():
    rng = np.random.default_rng(4)
    x = np.floor(256 * (rng.normal(size=(8, 1, 64)) + 0.2 * rng.normal(size=(8, 100, 64))).reshape(-1, 64))
    stored = segments.summaries(x)
    at = 0
    truth = x @ x.T
    for n in segments.segment_counts(64):
        m, d = stored[:, at : at + n], stored[:, at + n : at + 2 * n]
        at += 2 * n
        middle, reach = 64 / n * (m @ m.T), 64 / n * (d @ d.T)
        assert (middle - reach <= truth + 1e-3).all() and (truth <= middle + reach + 1e-3).all()
    assert at == stored.shape[1]
    numbers = np.arange(len(x))
    levels = [(stored[:, a : a + n] * math.sqrt(64 / n), stored[:, a + n : a + 2 * n] * math.sqrt(64 / n)) for a, n in ((0, 1), (2, 4), (10, 16))]
    side = segments.Side(numbers, numbers, numbers // 200, x, levels)
    anchors = side.part(0, 20)
    goals = segments.Goals(anchors, True, 5, np.arange(20), np.full(20, segments.LEAST), np.full(20, segments.MOST))
    for begin in range(0, len(x), 50):
        goals.offer(side.part(begin, 50))
    assert 0 < goals.scored < 0.8 * 20 * 199
    best = defaultdict(list)
    for w, s in zip(*goals.best[:2]):
        best[w].append(s)
    for w in range(20):
        others = [int(truth[w, j]) for j in range(200) if j != w]
        assert best[w] == sorted(others, reverse=True)[:5]
