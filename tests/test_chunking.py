import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import unicode as U
from lodestone.operators import chunking as C
from lodestone.operators import citations, structured
from lodestone.sources import handbook as H
from lodestone.sources import tables


def sentences(text):
    out, begin = [], 0
    ends = [m.end() for m in re.finditer(r"[.!?。！？]+(?:\s+|$)|\n{2,}", text)] + [len(text)]
    for end in ends:
        piece = text[begin:end]
        if piece.strip():
            lead = len(piece) - len(piece.lstrip())
            out.append((begin + lead, begin + len(piece.rstrip())))
        begin = end
    return out


def packed(text, budget):
    out, current = [], None
    for start, end in sentences(text):
        if current and end - current[0] > budget:
            out.append(current)
            current = None
        current = (current[0], end) if current else (start, end)
        if end - start > budget:
            out.append(current)
            current = None
    return out + ([current] if current else [])


def windows(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        out.append((start, min(start + size, len(text))))
        if out[-1][1] == len(text):
            break
        start += size - overlap
    return out


EDGES = [
    "", "  ", "...", "? ? x", "a.. b", "A one. B two. C three.", "no end", "x\n\n\ny",
    "\n\n a. ", "日本。 語！ x", "a. b. c d. ", "!!!!!!x!!! y", "café. naïve! 😀 x. 😀",
]


@pytest.fixture(scope="module")
def corpus(spark, sf):
    rows = [(10**6 + i, 10**6 + i, t, "", "", {}) for i, t in enumerate(EDGES)]
    schema = H.DOCUMENT.replace("doc_id string", "doc_id bigint")
    frame = tables.documents(spark, sf).unionByName(spark.createDataFrame(rows, schema))
    return frame.persist()


def spans(chunks, order="position"):
    got = {}
    for row in chunks.orderBy(order).collect():
        got.setdefault(row["doc_id"], []).append((row["start"], row["end"], row["text"]))
    return got


@pytest.mark.parametrize("budget", [30, 200])
def test_sentence_chunks_match_brute_force(corpus, budget):
    got = spans(C.chunk_documents(corpus, budget, strategy="sentence"))
    for row in corpus.collect():
        expected = [(a, b, row["text"][a:b]) for a, b in packed(row["text"], budget)]
        assert got.get(row["doc_id"], []) == expected


@pytest.mark.parametrize("size,overlap", [(200, 0), (200, 60), (37, 30)])
def test_fixed_chunks_match_brute_force(corpus, size, overlap):
    got = spans(C.chunk_documents(corpus, size, overlap))
    for row in corpus.collect():
        expected = [(a, b, row["text"][a:b]) for a, b in windows(row["text"], size, overlap)]
        assert got.get(row["doc_id"], []) == expected


def test_split_sentences(corpus):
    got = spans(C.split_sentences(corpus), "sentence_index")
    for row in corpus.collect():
        expected = [(a, b, row["text"][a:b]) for a, b in sentences(row["text"])]
        assert got.get(row["doc_id"], []) == expected


@pytest.mark.parametrize(
    "call",
    [
        lambda d: C.chunk_documents(d, 0),
        lambda d: C.chunk_documents(d, 5, 5),
        lambda d: C.chunk_documents(d, 5, -1),
        lambda d: C.chunk_documents(d, 0, strategy="sentence"),
        lambda d: C.chunk_documents(d, 5, strategy="words"),
    ],
)
def test_bad_parameters_fail_before_any_job(corpus, call):
    with pytest.raises(ValueError):
        call(corpus)


def test_sample_measures(spark):
    doc = H.text_documents(spark, H.SAMPLE)
    seen = []
    for size, overlap, kind in [(120, 0, "f"), (120, 30, "f"), (120, 60, "f"), (120, 0, "s")]:
        frame = (
            C.with_fixed_chunks(doc, "text", "c", size, overlap)
            if kind == "f"
            else C.with_sentence_chunks(doc, "text", "c", size)
        )
        n, chunks = F.length("text"), F.col("c")
        row = frame.select(
            F.size("c"),
            F.round(C.duplication(n, chunks), 2),
            F.round(C.coverage(n, chunks), 2),
            C.spans_a_boundary(chunks, F.lit(H.BOUNDARY_FACT)),
        ).first()
        seen.append(tuple(row))
    assert seen == [
        (4, 1.0, 1.0, False), (5, 1.29, 1.0, True), (7, 1.86, 1.0, True), (6, 0.99, 0.99, True),
    ]


def test_guarded_split(spark):
    doc = H.text_documents(spark, H.ABBREVIATION_PROSE, "See Fig. 3 here. Then stop.")
    plain = C.split_sentences(doc).groupBy("doc_id").count().orderBy("doc_id").collect()
    rows = C.split_sentences(doc, guarded=True).orderBy("doc_id", "sentence_index").collect()
    assert plain[0]["count"] > sum(r["doc_id"] == "d0" for r in rows)
    assert [r["text"] for r in rows if r["doc_id"] == "d1"] == ["See Fig. 3 here.", "Then stop."]
    for row in rows:
        text = {"d0": H.ABBREVIATION_PROSE, "d1": "See Fig. 3 here. Then stop."}[row["doc_id"]]
        assert text[row["start"] : row["end"]] == row["text"]
    assert [r["text"] for r in rows if r["doc_id"] == "d0"][0].startswith("See Fig. 3 for")


def test_korean_density(spark):
    docs = H.text_documents(spark, H.PARALLEL_EN, H.PARALLEL_KO)
    frame = C.with_sentences(docs, "text", "s")
    rows = frame.select("doc_id", F.round(C.density(F.length("text"), F.col("s")), 1)).orderBy("doc_id")
    assert [r[1] for r in rows.collect()] == [59.0, 29.2]


def test_normalization_map_examples():
    assert [list(x) if not isinstance(x, str) else x for x in U.normalize_with_offsets("áb")] == [
        "\xe1b", [0, 2, 3],
    ]
    raw = unicodedata.normalize("NFD", "한글 café")
    norm, places = U.normalize_with_offsets(raw)
    assert norm == unicodedata.normalize("NFC", raw) and places[-1] == len(raw)
    bengali = "কো x"
    norm, places = U.normalize_with_offsets(bengali)
    assert norm == unicodedata.normalize("NFC", bengali)
    for a in range(len(norm)):
        piece = bengali[places[a] : places[a + 1]]
        assert unicodedata.normalize("NFC", piece) == norm[a : a + 1]
    with pytest.raises(ValueError):
        U.normalize_with_offsets("x", "NFX")


@pytest.mark.parametrize("form", ["NFD", "NFKC", "NFKD"])
def test_other_forms(form):
    raw = "ﬁ café ½ 한"
    norm, places = U.normalize_with_offsets(raw, form)
    assert norm == unicodedata.normalize(form, raw) and len(places) == len(norm) + 1


def test_offset_drift(spark):
    docs = H.multilingual_documents(spark)
    rows = docs.select("doc_id", F.length("text"), U.offset_drift(F.col("text"))).orderBy("doc_order")
    seen = [tuple(r) for r in rows.collect()]
    assert [r[1] for r in seen] == [132, 149, 63]
    assert seen[0][2] == 0 and seen[1][2] < 0 and seen[2][2] < 0


def test_positions_and_ordinals(spark, corpus):
    chunks = C.build_index(corpus, 200)
    rows = C.with_ordinals(chunks, chunks).orderBy("position").collect()
    assert [r["ordinal"] for r in rows] == list(range(len(rows)))


def test_select_and_metadata(spark):
    docs = H.multilingual_documents(spark)
    chunks = C.chunk_documents(docs, 40, strategy="sentence", section="x", page=3)
    row = chunks.select("metadata").first()["metadata"]
    assert row["section"] == "x" and row["page"] == "3" and "lang" in row
    assert C.select(chunks, lang="ko").count() + C.select(chunks, lang=["en", "fr"]).count() == chunks.count()
    assert C.select(chunks, missing=None).count() == chunks.count()
    assert C.select(chunks, lang=None).count() == 0
    assert C.select(chunks, lang=[]).count() == 0


def test_line_column(spark):
    frame = spark.createDataFrame([("ab\ncd", 0), ("ab\ncd", 3), ("ab\ncd", 5)], "t string, o int")
    rows = frame.select(T.line_column(F.col("t"), F.col("o")).alias("p")).collect()
    assert [tuple(r["p"]) for r in rows] == [(1, 1), (2, 1), (2, 3)]
    with pytest.raises(Exception, match="outside the text"):
        frame.select(T.line_column(F.col("t"), F.lit(6))).collect()


def test_long_texts_cost_in_proportion(spark):
    """One text of 60,000 sentences: split, rejoined, chunked, cited, cut as a table."""
    import time

    n = 60_000
    prose = " ".join(f"Sentence {i} is here.\n" if i % 3 == 0 else f"See fig. {i} now." for i in range(n))
    table = "|a|b|\n|--|--|\n" + "\n".join(f"|{i}|x|" for i in range(n))
    docs = H.text_documents(spark, prose).persist()
    begun = time.perf_counter()
    assert C.split_sentences(docs).count() == 100_000
    assert C.split_sentences(docs, guarded=True).count() == n
    last = citations.cited_chunks(docs, 200).orderBy(F.desc("start")).first()
    assert last["end"] == len(prose) and last["citation"]["line"] == prose.count("\n", 0, last["start"]) + 1
    cut = structured.with_table_chunks(H.text_documents(spark, table), "text", "c", 6)
    assert cut.select(F.size("c")).first()[0] == n // 6
    assert time.perf_counter() - begun < 60


def test_blocks_of_a_fold_leave_the_chunks_alone(spark, monkeypatch):
    corpus = H.documents(spark)
    whole = [spans(C.build_index(corpus, size)) for size in (1, 40, 80, 320)]
    monkeypatch.setattr(C, "BLOCK", 2)
    assert [spans(C.build_index(corpus, size)) for size in (1, 40, 80, 320)] == whole


def test_citations_of_one_reading(spark):
    for docs in (H.documents(spark), H.multilingual_documents(spark)):
        for strategy in ("sentence", "fixed"):
            chunks = C.chunk_documents(docs, size=60, strategy=strategy)
            key = lambda f: sorted((r["doc_id"], r["chunk_index"], tuple(r["citation"])) for r in f.collect())
            assert key(citations.cited_chunks(docs, 60, strategy)) == key(citations.cite(chunks, docs))


def test_scans(spark):
    from lodestone.functions import arrays as A

    rows = [([],), ([5],), ([1, 2, 3, 4, 5, 6, 7],), (list(range(33)),)]
    frame = spark.createDataFrame(rows, "v array<int>")
    for r in frame.select("v", A.running_sums(F.col("v")).alias("s"), *[A.count_below(F.col("v"), F.lit(x)).alias(f"b{x}") for x in (0, 3, 99)]).collect():
        assert r["s"] == [sum(r["v"][: i + 1]) for i in range(len(r["v"]))]
        assert [r[f"b{x}"] for x in (0, 3, 99)] == [sum(v < x for v in r["v"]) for x in (0, 3, 99)]
