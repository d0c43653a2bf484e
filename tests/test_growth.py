"""Steps whose cost was too high a gigabyte: the same results, and how they come about."""

import hashlib
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import cutting
from lodestone.functions import text as T
from lodestone.functions.models import TOKEN, HashingEmbedder, words
from lodestone.operators import ann, blocks, chunking as C, dense, lexical

TEXTS = [
    "The cat sat. The dog, 3.5 years old, ran!  Then it slept...\n\nNew part? Yes.",
    "Se que ñezll CIÓN del. Kelvin K and İstanbul: 10:30.",
    "한국어 문장입니다. Second one! 끝。다음", "", " \n\n ", "no end", "x" * 50 + ". short. " + "y" * 80 + "! z.",
    unicodedata.normalize("NFD", "Ré sumé à la carte. Çava? ") * 7, None,
]


def chunk_rows(spark, texts):
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate(texts)], "doc_id long, text string"
    ).select("doc_id", F.col("doc_id").alias("doc_order"), "text", F.create_map().cast("map<string,string>").alias("metadata"))
    return docs, C.build_index(docs, 30)


@pytest.mark.parametrize("size", (1, 30, 60))
def test_texts_are_cut_as_sentences_are_found(spark, size):
    """Packing sentences that the column functions find gives the spans of the cutter."""
    known = [t for t in TEXTS if t is not None]
    frame = spark.createDataFrame(list(enumerate(known)), "i int, text string")
    for row in C.with_sentences(frame, "text", "s").collect():
        packed = []
        for s in row["s"]:
            if packed and s["end"] - packed[-1][0] <= size:
                packed[-1] = (packed[-1][0], s["end"])
            else:
                packed.append((s["start"], s["end"]))
        assert cutting.sentence_spans(row["text"], size) == packed


def test_chunks_leave_in_small_steps_with_raw_offsets(spark):
    steps = list(cutting._steps(pa.array(["a" * 10_000] * 1_000)))
    assert max(map(len, steps)) <= cutting.TEXTS_PER_STEP and sum(map(len, steps)) == 1_000
    docs, chunks = chunk_rows(spark, TEXTS)
    rows = chunks.collect()
    assert {r["doc_id"] for r in rows} == {0, 1, 2, 5, 6, 7}
    for r in rows:
        assert unicodedata.normalize("NFC", TEXTS[r["doc_id"]][r["start"] : r["end"]]) == r["text"]


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    letters = "aZ09:,. \n\t_-ñÑéÉ가힣ㄱ。Kİ\x1c\x85 ß"
    for _ in range(2_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        assert words(text) == TOKEN.findall(text.lower())


def test_embedder_adds_signs_up():
    texts = [t or "" for t in TEXTS] + [""]
    plain = np.zeros((len(texts), 64))
    for row, text in enumerate(texts):
        for word in TOKEN.findall(text.lower()):
            digest = hashlib.md5(word.encode()).hexdigest()
            plain[row, int(digest[:7], 16) % 64] += 1 if int(digest[7], 16) % 2 == 0 else -1
    embedder = HashingEmbedder()
    assert (embedder.encode(texts) == plain).all() and (embedder.encode(texts) == plain).all()
    assert embedder.encode([]).shape == (0, 64)


def test_terms_are_counted_where_the_texts_are(spark):
    """The default tokenizer and one that only the JVM has give the same search."""
    _, chunks = chunk_rows(spark, TEXTS)
    asked = spark.createDataFrame([(1, "the cat and the dog"), (2, "한국어 sumé 10:30."), (3, "")], "query_id int, query string")
    fast, plain = lexical.BM25(chunks), lexical.BM25(chunks, tokenizer=lambda text: T.tokens(text))
    assert lexical.TermKernel("bm25").columns == ("text",)
    wanted = spark.createDataFrame([("the",), ("10:30.",), ("absent",), (lexical.EVERYTHING,)], "term string")
    assert sorted(fast.term_stats(wanted).collect()) == sorted(plain.term_stats(wanted).collect())
    assert sorted(fast.search(asked, 3).collect()) == sorted(plain.search(asked, 3).collect())


def test_scores_below_the_floor_are_not_ordered(monkeypatch):
    calls, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **k: calls.append(1) or partition(*a, **k))
    rng = np.random.default_rng(0)
    chosen = blocks._Selection(blocks.Keep(k=5), 20, ("id",), "size")
    scores = np.round(rng.random((40 * 64, 20)), 2)
    for begin in range(0, len(scores), 64):
        batch = pa.table({"id": np.arange(begin, begin + 64)})
        chosen.offer(scores[begin : begin + 64] - begin, batch)
    assert len(calls) == 1
    kept = {}
    for query, item in zip(chosen.rows.column("_query").to_pylist(), chosen.rows.column("id").to_pylist()):
        kept.setdefault(query, []).append(item)
    lowered = scores - np.arange(len(scores))[:, None] // 64 * 64
    for query in range(20):
        assert kept[query] == np.lexsort((np.arange(len(scores)), -lowered[:, query]))[:5].tolist()


def test_custom_scorer_sees_what_was_prepared_once(spark):
    _, chunks = chunk_rows(spark, TEXTS)
    asked = spark.createDataFrame([(i, f"the dog {i} a. 한국어") for i in range(7)], "query_id int, query string")

    def score(query, text):
        shared = F.size(F.array_intersect(query["words"], text["words"])) / text["n"]
        return F.when(text["n"] != 11, shared)

    def prepare(text):
        return F.struct(F.split(F.lower(text), " ").alias("words"), F.length(text).alias("n"))

    index = lexical.overlap(chunks, score, prepare)
    found = {(r["query_id"], r["rank"]): (r["position"], r["score"]) for r in index.search(asked, 100).collect()}
    split = index.search(asked, 100, broadcast_limit=200).collect()
    assert {(r["query_id"], r["rank"]): (r["position"], r["score"]) for r in split} == found
    texts = [(r["doc_id"], r["chunk_index"], r["position"], r["text"]) for r in chunks.collect()]
    for query, text in ((r["query_id"], r["query"]) for r in asked.collect()):
        ranked = []
        for doc, place, position, chunk in texts:
            value = len(set(text.lower().split(" ")) & set(chunk.lower().split(" "))) / len(chunk)
            value = None if len(chunk) == 11 else value
            ranked.append((-round(value, 9) if value is not None else 1, doc, place, position, value))
        for rank, (*_, position, value) in enumerate(sorted(ranked, key=lambda r: r[:3]), 1):
            assert found[query, rank][0] == position and found[query, rank][1] == (value if value is None else pytest.approx(value))
    none = index.search(asked.limit(0), 3)
    assert none.isEmpty()


@pytest.mark.parametrize("room", (0, 1 << 20))
def test_graph_stays_where_it_is(spark, monkeypatch, room):
    """Rounds that send the queries to the graph, and rounds that shuffle both."""
    monkeypatch.setattr(ann, "ROUND_BYTES", room)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = spark.createDataFrame(rows[:3], "query_id long, vector array<float>")
    index = ann.NSWIndex(4, m=3).fit(vectors)
    walked = {r["query_id"]: (sorted(r["visited"]), r["best"]) for r in index.walk(asked, 4, limit=0).collect()}
    shared = {r["query_id"]: (sorted(r["visited"]), r["best"]) for r in index.walk(asked, 4).collect()}
    assert walked == shared


def test_rows_that_ask_for_their_own_neighbours_meet_in_the_grid(spark):
    """Queries and items of one table, which Spark keeps once for both."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    edges = [sorted(ann.NSWIndex(4, m=3).fit(vectors, broadcast_limit=limit).edges.collect()) for limit in (None, 0)]
    assert edges[0] == edges[1] and len(edges[0]) > 100
    store = dense.VectorStore(4).add(vectors)
    asked = store.rows.select(F.col("id").alias("query_id"), "vector")
    found = [store.search_batch(asked, 3, broadcast_limit=limit).select("query_id", "rank", "id").collect() for limit in (None, 0)]
    assert sorted(found[0]) == sorted(found[1]) and len(found[0]) == 150


def test_shared_words_are_counted_for_a_batch_at_once(spark):
    """A scorer that is told the number of shared words gives what one that intersects gives."""
    _, chunks = chunk_rows(spark, TEXTS)
    asked = spark.createDataFrame([(i, f"the the dog {i} a. 한국어") for i in range(7)] + [(7, None), (8, ""), (8, "cat")], "query_id int, query string")

    def words(text):
        listed = F.transform(F.split(F.lower(text), " "), lambda w: F.when(w != "dog,", w))
        return F.when(F.length(text) != 11, listed)

    def intersected(query, text):
        return F.size(F.array_intersect(query["words"], text["words"])) / text["n"]

    def told(query, text, shared):
        return shared / text["n"]

    def prepare(text):
        return F.struct(words(text).alias("words"), F.length(text).alias("n"))

    key = lambda frame: sorted((r["query_id"], r["rank"], str(r["position"]), r["score"]) for r in frame.collect())
    plain, index = lexical.overlap(chunks, intersected, prepare), lexical.overlap(chunks, told, prepare, words)
    found = key(plain.search(asked, 100))
    assert any(score is None for *_, score in found) and any(score for *_, score in found)
    plans = index.search(asked, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plans
    for few in (None, 200):
        assert key(index.search(asked, 100, broadcast_limit=few)) == found
        assert key(index.search_within_budget(asked, 60, broadcast_limit=few)) == key(plain.search_within_budget(asked, 60))
    assert index.search(asked.limit(0), 3).isEmpty() and key(index.search(asked.where("query_id = 8"), 2)) == key(plain.search(asked.where("query_id = 8"), 2))


def test_custom_retrieval_does_not_intersect_pair_by_pair(spark, sf):
    from lodestone.catalog.search import retrieve_custom

    assert "array_intersect" not in retrieve_custom(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_later_items_are_not_scored():
    kernel, rng = ann._EarlierKernel(), np.random.default_rng(4)
    vectors = [[float(x) for x in rng.normal(size=3)] for _ in range(6)]
    state = kernel.prepare(pa.table({"query_id": [3, 4], "vector": vectors[:2]}))

    def scores(*ids):
        return kernel.score(state, kernel.load(pa.table({"id": list(ids), "vector": vectors[: len(ids)]})))

    assert scores(4, 5, 9) is None and np.isfinite(scores(1, 2)).all()
    assert np.isneginf(scores(2, 3, 4)).tolist() == [[False, False], [True, False], [True, True]]


@pytest.mark.parametrize("room", (0, 1 << 20))
def test_joined_walk_fetches_ahead_for_every_query(spark, monkeypatch, room):
    """Queries of one query_id, or of none, walk on their own, in fewer rounds than nodes."""
    monkeypatch.setattr(ann, "ROUND_BYTES", room)
    laid, rounds = ann._laid, []
    monkeypatch.setattr(ann, "_laid", lambda frame, path: rounds.append(path) or laid(frame, path))
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = spark.createDataFrame([(1, rows[3][1]), (1, rows[50][1]), (None, rows[70][1])], "query_id long, vector array<float>")
    index = ann.NSWIndex(4, m=3).fit(vectors)
    key = lambda frame: sorted((str(r["query_id"]), sorted(r["visited"]), r["best"]) for r in frame.collect())
    walked = key(index.walk(asked, 8, limit=0))
    assert walked == key(index.walk(asked, 8))
    assert 1 < len(rounds) < min(len(visited) for _, visited, _ in walked)
