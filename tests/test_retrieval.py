import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking as C
from lodestone.operators import blocks, containment, dense, fusion, lexical, metrics, structured
from lodestone.operators.ann import IVFIndex, NSWIndex, kmeans, recall_curve
from lodestone.operators.postings import StoredBM25
from lodestone.plans import experiment as E
from lodestone.sources import handbook as H
from lodestone.sources import tables

WORD = re.compile("[0-9a-z가-힣:,.]+")


def words(text):
    return WORD.findall(text.lower())


@pytest.fixture(scope="module")
def asked(spark):
    return H.questions(spark).persist()


@pytest.fixture(scope="module")
def handbook(spark):
    return C.build_index(H.documents(spark), 80).persist()


@pytest.fixture(scope="module")
def passages(spark, sf):
    q = tables.table(spark, sf, "benchmark")
    return q.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).persist()


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return C.build_index(tables.documents(spark, sf), 300).persist()


def bm25_scores(texts, query, k1=1.5, b=0.75):
    counts = [Counter(words(t)) for t in texts]
    sizes = [sum(c.values()) for c in counts]
    mean = sum(sizes) / len(sizes)
    df = Counter(w for c in counts for w in c)
    out = []
    for c, n in zip(counts, sizes):
        total = 0.0
        for w in words(query):
            if c[w]:
                idf = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
                total += idf * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * n / mean))
        out.append(total)
    return out


def test_handbook_index(handbook):
    assert handbook.count() == 26
    assert lexical.BM25(handbook).document_frequency().count() == 191


@pytest.mark.parametrize("b", [0.0, 0.75, 1.0])
def test_bm25_matches_brute_force(spark, corpus, passages, b):
    rows = corpus.orderBy("position").collect()
    texts = [r["text"] for r in rows]
    queries = passages.collect()
    found = lexical.BM25(corpus, b=b).search(passages, 7).collect()
    for q in queries[:12]:
        scores = bm25_scores(texts, q["query"], b=b)
        best = sorted(
            (i for i in range(len(texts)) if scores[i] > 0), key=lambda i: (-round(scores[i], 9), i)
        )[:7]
        got = sorted((r for r in found if r["query_id"] == q["query_id"]), key=lambda r: r["rank"])
        assert [r["position"] for r in got] == [rows[i]["position"] for i in best]
        assert np.allclose([r["score"] for r in got], [scores[i] for i in best])


@pytest.mark.parametrize("scorer", ["coverage", "occurrences"])
def test_overlap_budget_matches_brute_force(spark, corpus, passages, scorer):
    rows = corpus.orderBy("position").collect()
    found = lexical.Overlap(corpus, scorer).search_within_budget(passages, 700).collect()
    for q in passages.collect()[:12]:
        wanted = set(words(q["query"]))
        score = {
            "coverage": lambda t: len(wanted & set(words(t))),
            "occurrences": lambda t: sum(w in wanted for w in words(t)),
        }[scorer]
        ranked = sorted(rows, key=lambda r: (-score(r["text"]), r["position"]))
        kept, used = [], 0
        for r in ranked:
            if used + len(r["text"]) > 700:
                break
            kept.append(r)
            used += len(r["text"])
        kept = kept or ranked[:1]
        got = sorted((r for r in found if r["query_id"] == q["query_id"]), key=lambda r: r["rank"])
        assert [r["position"] for r in got] == [r["position"] for r in kept]


def same(left, right):
    key = lambda f: sorted((r["query_id"], r["rank"], r["position"], round(r["score"], 6)) for r in f.collect())
    return key(left) == key(right)


def test_grid_equals_broadcast(corpus, passages, monkeypatch):
    monkeypatch.setattr("lodestone.operators.blocks.GRID_QUERY_BYTES", 20_000)
    monkeypatch.setattr("lodestone.operators.blocks.QUERIES_PER_STEP", 7)
    monkeypatch.setattr("lodestone.operators.blocks.GRID_ITEM_ROWS", 500)
    index = lexical.BM25(corpus)
    assert same(index.search(passages, 5), index.search(passages, 5, broadcast_limit=0))
    small = index.search_within_budget(passages, 600)
    assert same(small, index.search_within_budget(passages, 600, broadcast_limit=0))
    hashed = dense.DenseIndex(corpus)
    assert same(hashed.search(passages, 5), hashed.search(passages, 5, broadcast_limit=0))


def test_bm25_parts(spark, corpus, passages):
    index = lexical.BM25(corpus)
    found = index.search(passages, 3)
    again = index.score(passages, found.select("query_id", "position"))
    joined = found.join(again.withColumnRenamed("score", "again"), ["query_id", "position"])
    assert joined.where(F.abs(F.col("score") - F.col("again")) > 1e-9).count() == 0
    assert joined.count() == found.count()
    stats = index.postings().groupBy("position").agg(F.sum("tf").alias("n"))
    assert stats.join(index.doc_stats(), "position").where("n <> dl").count() == 0
    assert index.idf().where("idf < 0").count() == 0


def test_empty_and_unmatched(spark, handbook):
    index = lexical.BM25(handbook)
    nothing = spark.createDataFrame([(1, "zzz qqq"), (2, "")], "query_id int, query string")
    assert index.search(nothing, 3).count() == 0
    assert index.search_within_budget(nothing, 100).count() == 0
    assert lexical.Overlap(handbook).search(nothing, 3).count() == 6
    assert lexical.Overlap(handbook).search_within_budget(nothing, 1).count() == 2
    none = nothing.limit(0)
    assert index.search(none, 3).count() == 0
    for bad in ({"k1": -1}, {"b": 1.5}):
        with pytest.raises(ValueError):
            lexical.BM25(handbook, **bad)
    with pytest.raises(ValueError):
        index.search(nothing, 0)
    with pytest.raises(ValueError):
        index.search_within_budget(nothing, 0)


def test_padding_demo(spark):
    chunks = H.text_chunks(spark, *H.PADDING_DEMO)
    query = spark.createDataFrame([(0, "what are the core hours")], "query_id int, query string")
    seen = {}
    for b in (0.0, 0.75, 1.0):
        rows = lexical.BM25(chunks, b=b).search(query, 2).orderBy("position").collect()
        seen[b] = [round(r["score"], 3) for r in rows]
    assert seen[0.0] == [1.058, 1.885] and seen[1.0] == [1.779, 1.585]
    assert seen[0.75][1] > seen[0.75][0]


def percent(frame, name="hit"):
    return [round(100 * r[name]) for r in frame.collect()]


def test_sweep_reproduces_published_rates(spark, asked):
    docs = H.documents(spark)
    rows = E.sweep(docs, asked, H.SIZES, "sentence").persist()
    assert percent(rows) == [88, 88, 88, 88, 94, 100, 94]
    assert [round(r["context"]) for r in rows.collect()][::6] == [218, 1182]
    assert percent(rows, "intact") == [100] * 7
    assert E.best_size(rows).first()["best_size"] == 320
    fixed = E.sweep(docs, asked, H.SIZES, "fixed").persist()
    assert percent(fixed) == [6, 65, 71, 82, 88, 100, 94]
    assert percent(fixed, "intact")[:4] == [41, 100, 88, 100]


def test_budgets_reproduce_published_rates(spark, asked):
    docs = H.documents(spark)
    for strategy, expected in (("sentence", [88, 94, 94]), ("fixed", [65, 88, 94])):
        chunks = C.build_index(docs, 80, strategy)
        got = [percent(E.evaluate_overlap(chunks, asked, k=None, budget=b))[0] for b in (300, 600, 1200)]
        assert got == expected
    wide = C.build_index(docs, 320, "fixed")
    gap = [percent(E.evaluate_overlap(wide, asked, s, None, 600))[0] for s in ("occurrences", "coverage")]
    assert gap == [65, 88]


def test_bm25_reproduces_published_rates(spark, asked, handbook):
    docs = H.documents(spark)
    got = [percent(E.evaluate_bm25(C.build_index(docs, s), asked))[0] for s in H.SIZES]
    assert got == [94, 94, 94, 88, 94, 94, 88]
    tabular, source = (H.text_documents(spark, t) for t in (H.EXPENSE_TABLE, H.POLICY_CODE))

    def extra(frame):
        rows = frame.select("doc_id", F.inline("c"))
        return rows.select(
            "doc_id", "chunk_index",
            C.placed(F.lit(0), F.col("chunk_index")).alias("position"),
            "text", "start", "end", F.create_map().cast("map<string,string>").alias("metadata"),
        )

    table = extra(structured.with_table_chunks(tabular, "text", "c", 6))
    code = extra(source.withColumn("c", structured.python_chunks(F.col("text"))))
    mixed = C.union_chunks(handbook, table, code).persist()
    assert mixed.count() == 33
    assert round(C.length_dispersion(mixed).first()["cv"], 2) == 0.80
    rates = []
    for b in (0.0, 0.25, 0.5, 1.0):
        found = lexical.BM25(mixed, b=b).search(asked, 3, payload=("text",))
        rates.append(percent(metrics.hit_rate(found, asked))[0])
    assert rates == [88, 94, 94, 94]


def test_containment_paths_agree(spark, sf, monkeypatch):
    docs = tables.documents(spark, sf)
    answers = tables.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("answer")
    )
    short = spark.createDataFrame([(900, "the"), (901, ""), (902, None)], answers.schema)
    both = answers.unionByName(short)
    pairs = lambda frame: sorted(tuple(r) for r in frame.collect())
    got = pairs(containment.containing(docs, both, ("doc_id",)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    expected = sorted(
        (q["query_id"], d) for q in both.collect() for d, t in texts.items()
        if q["answer"] is not None and q["answer"] in t
    )
    assert got == expected
    assert pairs(containment.containing(docs, both, ("doc_id",), limit=0)) == expected
    # Pieces shorter than the answers, and a filter that lets nearly everything pass.
    monkeypatch.setattr(containment, "PIECE_BYTES", 101)
    monkeypatch.setattr(containment, "MOST_BITS", 64)
    few = docs.where("length(text) < 3000")
    got = pairs(containment.containing(few, both, ("doc_id",), limit=0))
    assert got == [(q, d) for q, d in expected if len(texts[d]) < 3000]


def test_containment_by_fingerprints_of_odd_texts(spark):
    texts = [(1, "가나다 éa éa éa"), (2, None), (3, ""), (3, "éa"), (4, "a" * 300), (5, "ab" * 40 + "c")]
    asked = [(10, "éa"), (11, "나"), (12, ""), (13, None), (14, "a" * 65), (15, "babab"), (15, "abc"), (16, "a" * 301), (17, "zzz")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    answers = spark.createDataFrame(asked, "query_id long, answer string")
    for keep in (("doc_id",), ()):
        for few in (answers, answers.where("query_id in (13, 17)"), answers.where("answer = ''"), answers.limit(0)):
            one = containment.containing(docs, few, keep)
            other = containment.containing(docs, few, keep, limit=0)
            if not keep:
                one, other = one.distinct(), other.distinct()
            assert Counter(map(tuple, one.collect())) == Counter(map(tuple, other.collect()))
        assert containment.containing(docs.limit(0), answers, keep, limit=0).count() == 0


def test_only_candidates_leave_the_texts(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    answers = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))
    plan = containment.containing(docs, answers, ("doc_id",), limit=0)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("MapInArrow look")[0]
    assert "Join" in above and "_text" not in above and "text#" not in above


# --- vectors ---------------------------------------------------------------


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(600)]
    return spark.createDataFrame(rows, "id bigint, vector array<float>").persist()


@pytest.fixture(scope="module")
def probes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(12)]
    return spark.createDataFrame(rows, "query_id bigint, vector array<float>").persist()


def ids(frame):
    got = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    return got


def test_exact_search(cloud, probes):
    store = dense.VectorStore(16).add(cloud)
    m = np.array([r["vector"] for r in store.rows.orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(m, axis=1), 1, atol=1e-6)
    found = ids(store.search(probes, 5))
    for row in probes.collect():
        q = np.array(row["vector"]) / np.linalg.norm(row["vector"])
        assert found[row["query_id"]] == list(np.argsort(-(m @ q), kind="stable")[:5])
    assert found == ids(store.search_naive(probes, 5))
    assert store.count() == 600
    assert store.memory_bytes().first()["bytes"] == 600 * 16 * 4
    assert len(ids(store.search(probes, 1000))[0]) == 600
    assert dense.recall_at_k(store.search(probes, 5), store.search(probes, 5), 5).agg(F.min("recall")).first()[0] == 1


def test_store_checks(spark, cloud):
    for bad in (lambda: dense.VectorStore(0), lambda: dense.VectorStore(2, "half")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="expected dimension 8"):
        dense.VectorStore(8).add(cloud).rows.collect()
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "id bigint, vector array<float>")
    assert dense.VectorStore(2).add(zero).rows.first()["vector"] == [0.0, 0.0]
    assert dense.random_store(spark, 50, 4).count() == 50


def test_ivf(cloud, probes, tmp_path):
    store = dense.VectorStore(16).add(cloud)
    index = IVFIndex(16, n_lists=8).fit(cloud)
    assert np.allclose(np.linalg.norm(index.centroids, axis=1), 1)
    assert index.list_sizes().count() == 8
    exact = ids(store.search(probes, 5))
    assert ids(index.search(probes, 5, n_probe=8)) == exact
    for n in (1, 3):
        assert ids(index.search(probes, 5, n_probe=n)) == ids(index.search_gathered(probes, 5, n))
    curve = recall_curve(store, index, probes, 5, (1, 2, 4, 8)).orderBy("n_probe").collect()
    recalls, scanned = [r["recall"] for r in curve], [r["scanned"] for r in curve]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0
    assert scanned == sorted(scanned) and scanned[-1] == 600
    before = ids(index.search(probes, 5, 2))
    gathered = ids(index.search_gathered(probes, 5, 2))
    sizes = {r["list_id"]: r["members"] for r in index.list_sizes().collect()}
    index.write(str(tmp_path / "ivf"), segment_bytes=20 * (4 * 16 + 16))
    assert ids(index.search(probes, 5, 2)) == before == gathered == ids(index.search_gathered(probes, 5, 2))
    parts = index.rows.groupBy("list_id").agg(F.max("segment").alias("last"), F.count("*").alias("n")).collect()
    assert {r["list_id"]: r["n"] for r in parts} == sizes
    assert all(r["last"] < -(-r["n"] // 20) for r in parts) and max(r["last"] for r in parts) > 0
    again = IVFIndex(16, n_lists=8).read(index.rows.sparkSession, str(tmp_path / "ivf"))
    assert ids(again.search(probes, 5, 2)) == before and np.allclose(again.centroids, index.centroids)
    with pytest.raises(ValueError):
        index.search(probes, 5, 0)


def test_kmeans_reseeds_empty_clusters(spark):
    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(6, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "id bigint, vector array<float>")
    centroids = kmeans(frame, 2)
    assert sorted(c.round(6).tolist() for c in centroids) == [[0.0, 1.0], [1.0, 0.0]]
    assert len(kmeans(frame, 50, 1)) == 7


def graph_of(m, links):
    near = [[] for _ in m]
    for p in range(1, len(m)):
        for o in np.argsort(-(m[:p] @ m[p]), kind="stable")[:links]:
            near[p].append(int(o))
            if len(near[o]) < 2 * links:
                near[o].append(p)
    return near


def test_nsw(cloud, probes):
    index = NSWIndex(16, m=4).fit(cloud)
    m = np.array([r["vector"] for r in index.rows.orderBy("id").collect()], dtype=float)
    expected = graph_of(m, 4)
    got = {r["id"]: r["links"] for r in index.adjacency().collect()}
    assert all(sorted(expected[i]) == got[i] for i in range(len(m)))
    few = probes.where("query_id < 3")
    for k, ef in ((5, 8), (3, 2)):
        shared, joined = index.search(few, k, ef), index.search(few, k, ef, limit=0)
        assert ids(shared) == ids(joined)
    work = index.vectors_scanned(probes, 8).collect()
    assert all(1 < r["scanned"] < 600 for r in work)
    wide = ids(index.search(probes, 5, 600))
    store = dense.VectorStore(16).add(cloud)
    exact = ids(store.search(probes, 5))
    assert np.mean([len(set(wide[q]) & set(exact[q])) / 5 for q in exact]) > 0.8


def test_scaling_reports(spark):
    rows = spark.createDataFrame(
        [(10, 1.0), (100, 10.0), (1000, 100.0)], "count bigint, ms double"
    )
    assert round(dense.scaling_exponent(rows).first()["slope"], 6) == 1.0
    far = dense.extrapolate(rows, 10_000).first()
    assert far["ms"] == 1000.0 and far["gigabytes"] == 10_000 * 384 * 4 / 1e9
    table = dense.scaling_table(spark, [20, 40], 8, 2).collect()
    assert [r["count"] for r in table] == [20, 40] and table[0]["ms"] > 0


def test_truncation(spark):
    text = spark.range(1).select(H.overlong_text().alias("text"))
    assert text.first()["text"].endswith("ZEBRA.")
    chunks = H.text_chunks(spark, "short text", text.first()["text"])
    index = dense.DenseIndex(chunks)
    assert [r["position"]["chunk_index"] for r in index.truncated_chunks().collect()] == [1]


def stored_cases(spark, corpus):
    words = [f"term{i} common" for i in range(60)] + ["common " * (1 + i % 5) + f"rare{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[i:i + 4]) + ".") for i in range(110)], "doc_order long, text string")
    many = C.build_index(docs.select(F.col("doc_order").alias("doc_id"), "doc_order", "text", F.create_map().cast("map<string,string>").alias("metadata")), 40)
    asked = spark.createDataFrame([(1, "rare7 common"), (2, "term3 term4"), (3, "common"), (4, "unknown words"), (5, "")], "query_id long, query string")
    passages = H.questions(spark).select("query_id", "query")
    return [(many, asked), (corpus, passages)]


@pytest.mark.parametrize("range_chunks,buckets", [(1, 1), (4, 16), (10**6, 3)])
def test_stored_bm25_equals_bm25(spark, corpus, tmp_path, range_chunks, buckets):
    for case, (chunks, asked) in enumerate(stored_cases(spark, corpus)):
        index = lexical.BM25(chunks, k1=1.2, b=0.6)
        stored = StoredBM25.write(index, str(tmp_path / str(case)), range_chunks, buckets)
        again = StoredBM25(spark, str(tmp_path / str(case)))
        for k in (1, 3, 50):
            key = lambda f: sorted((r["query_id"], r["rank"], str(r["position"]), round(r["score"], 8)) for r in f.collect())
            assert key(again.search(asked, k)) == key(index.search(asked, k))
        work = stored.work(asked, 1).collect()
        assert all(r["read"] <= r["postings"] for r in work)
        if range_chunks == 1:
            assert sum(r["read"] for r in work) < sum(r["postings"] for r in work)
    with pytest.raises(ValueError):
        again.search(asked, 0)
    with pytest.raises(ValueError):
        StoredBM25.write(index, str(tmp_path / "none"), 0)
    with pytest.raises(ValueError, match="no chunks"):
        StoredBM25.write(lexical.BM25(chunks.limit(0)), str(tmp_path / "none"))


def test_postings_of_long_chunks_are_linear(spark):
    import time

    def seconds(n):
        text = " ".join(f"w{i}" for i in range(n)) + " w1 w1"
        frame = H.text_chunks(spark, text).persist()
        frame.count()
        begun = time.perf_counter()
        rows = lexical.BM25(frame).postings().where("term = 'w1'").collect()
        assert [r["tf"] for r in rows] == [3]
        return time.perf_counter() - begun

    seconds(1000)
    assert seconds(160_000) < 20


def test_a_scorer_may_be_any_function_of_columns(spark, corpus, monkeypatch):
    passages = H.questions(spark).select("query_id", "query")
    named = lexical.Overlap(corpus, "coverage")
    own = lexical.overlap(corpus, lexical.score_coverage)
    key = lambda f: sorted((r["query_id"], r["rank"], str(r["position"]), r["score"], r["text"]) for r in f.collect())
    for few in (None, 1000):
        assert key(own.search(passages, 3, ("text",), broadcast_limit=few)) == key(named.search(passages, 3, ("text",)))
        packed = own.search_within_budget(passages, 500, ("text",), broadcast_limit=few)
        assert key(packed) == key(named.search_within_budget(passages, 500, ("text",)))
    docs, asked = H.documents(spark), H.questions(spark)
    columns = ["size", "hit", "context", "intact"]
    rows = [E.sweep(docs, asked, (80, 160), scorer=s).select(*columns).orderBy("size").collect() for s in ("coverage", lexical.score_coverage)]
    assert rows[0] == rows[1]
    with pytest.raises(ValueError):
        lexical.overlap(corpus, "unknown")


def one_document(spark, doc_order, text):
    frame = spark.createDataFrame([(doc_order, text)], "doc_order long, text string")
    return frame.select(
        F.lit("d").alias("doc_id"), "doc_order", "text",
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def test_union_keeps_chunks_of_equal_documents_apart(spark):
    sources = [C.build_index(one_document(spark, 0, f"shared words {w}."), 200) for w in ("left", "right")]
    asked = spark.createDataFrame([(1, "shared words")], "query_id long, query string")
    found = lexical.BM25(C.union_chunks(*sources)).search(asked, 5, payload=("text",)).collect()
    assert sorted(r["text"] for r in found) == ["shared words left.", "shared words right."]
    assert [r["text"] for r in sorted(found, key=lambda r: r["position"])] == ["shared words left.", "shared words right."]


ORDERS = (-(2**63), -(2**40), -1, 0, 5, 2**35, 2**40, 2**62)


def test_any_document_order_keeps_its_place(spark):
    rows = [(o, f"shared words number {i}. And more here.") for i, o in enumerate(ORDERS)]
    docs = spark.createDataFrame(rows, "doc_order long, text string").repartition(3).select(
        F.col("doc_order").cast("string").alias("doc_id"), "doc_order", "text",
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    chunks = C.build_index(docs, 20)
    listed = chunks.orderBy("position").select("doc_id", "chunk_index").collect()
    assert [tuple(r) for r in listed] == [(str(o), i) for o in ORDERS for i in (0, 1)]
    placed = C.with_ordinals(chunks, chunks).orderBy("ordinal").collect()
    assert [(r["doc_id"], r["ordinal"]) for r in placed] == [(str(o), 2 * k + i) for k, o in enumerate(ORDERS) for i in (0, 1)]
    asked = spark.createDataFrame([(1, "shared words")], "query_id long, query string")
    # Equal scores go by position, in the kernels as in the plan.
    found = lexical.BM25(chunks).search(asked, 5, payload=("doc_id",)).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == [str(o) for o in ORDERS[:5]]


def test_unions_of_unions_keep_their_order(spark):
    def one(word):
        return C.build_index(one_document(spark, 7, f"shared words {word}."), 200)

    inner = C.union_chunks(one("b"), one("c"))
    outer = C.union_chunks(one("a"), inner, C.union_chunks(inner, one("d")))
    rows = outer.orderBy("position").collect()
    assert [r["text"][-2] for r in rows] == list("abcbcd")
    assert len({str(r["position"]) for r in rows}) == 6
    placed = C.with_ordinals(outer, outer).collect()
    assert sorted(r["ordinal"] for r in placed) == list(range(6))
    asked = spark.createDataFrame([(1, "shared words")], "query_id long, query string")
    found = lexical.BM25(outer).search(asked, 6, payload=("text",)).orderBy("rank").collect()
    assert [r["text"][-2] for r in found] == list("abcbcd")
    many = C.union_chunks(*[one(f"w{i}") for i in range(20)])
    assert [r["text"] for r in many.orderBy("position").collect()] == [f"shared words w{i}." for i in range(20)]


def test_orders_of_several_parts(spark):
    rows = [([2, 1], "z one."), ([1, 9], "y two."), ([1, 10], "x three."), ([-3, 0], "w four.")]
    docs = spark.createDataFrame(rows, "doc_order array<long>, text string").select(
        F.col("text").alias("doc_id"), "doc_order", "text", F.create_map().cast("map<string,string>").alias("metadata")
    )
    chunks = C.build_index(docs, 200)
    assert [r["text"][0] for r in chunks.orderBy("position").collect()] == list("wyxz")
    placed = {r["text"][0]: r["ordinal"] for r in C.with_ordinals(chunks, chunks).collect()}
    assert placed == {"w": 0, "y": 1, "x": 2, "z": 3}


def test_hybrid_search_over_documents_of_any_order(spark):
    """RRF ties go by the digits of the ordinal, whatever the ids are."""
    texts = [f"alpha beta gamma {i}." for i in range(12)]
    docs = spark.createDataFrame([(2**50 - 7 * i, t) for i, t in enumerate(texts)], "doc_order long, text string").select(
        F.col("text").alias("doc_id"), "doc_order", "text", F.create_map().cast("map<string,string>").alias("metadata")
    )
    chunks = C.build_index(docs, 200)
    asked = spark.createDataFrame([(1, "alpha beta")], "query_id long, query string")
    retriever = fusion.HybridRetriever(chunks)
    halves = [retriever.half(asked, 20, m).select("position", "rank").collect() for m in ("sparse", "dense")]
    ordinal = {str(r["position"]): r["ordinal"] for r in C.with_ordinals(chunks, chunks).collect()}
    score = {}
    for half in halves:
        for r in half:
            score[str(r["position"])] = score.get(str(r["position"]), 0) + 1 / (60 + r["rank"])
    expected = sorted(score, key=lambda p: (-round(score[p], 15), str(ordinal[p])))
    found = retriever.search(asked, 12, "rrf").orderBy("rank").collect()
    assert [str(r["position"]) for r in found] == expected
    plan = retriever.search(asked, 12, "rrf")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_texts_are_encoded_once_for_all_query_blocks():
    import numpy as np
    import pyarrow as pa
    from lodestone.operators import blocks, dense

    class Counting:
        seen = 0

        def encode(self, texts):
            self.seen += len(texts)
            return np.ones((len(texts), 4))

    embedder = Counting()
    asked = pa.table({"query_id": range(700), "vector": [[1.0, 0, 0, 0]] * 700})
    batch = pa.table({"position": range(50), "text": ["t"] * 50})
    schema = pa.schema([("query_id", pa.int64()), ("position", pa.int64()), ("score", pa.float64())])
    out = list(
        blocks._scan(dense.EncodingKernel(embedder), blocks.Keep(k=1), ("position",), "size", ["position"], asked, [batch], schema)
    )
    assert embedder.seen == 50 and sum(b.num_rows for b in out) == 700


def test_tokens_found_in_bytes_are_the_words_of_each_text():
    from lodestone.functions.models import token_lists, words

    letters = ["a", "Z", "K", "İ", "가", "나 ", "é", "ß", " ", "\n", ".", ",", "字", "9", "ힰ", "\xa0", "x:y"]
    rng = np.random.default_rng(3)
    texts = [None if i % 11 == 5 else "".join(rng.choice(letters, i % 9)) for i in range(2000)]
    for part in (texts, [t for t in texts if t and t.isascii()], ["ab", "cd"], ["", None], []):
        wanted = [None if t is None else words(t) for t in part]
        assert token_lists(pa.array(part, pa.string())).to_pylist() == wanted
        assert token_lists(pa.chunked_array([pa.array(part, pa.string()).slice(1)])).to_pylist() == wanted[1:]


@pytest.mark.parametrize("weigh", ["bm25", "coverage", "occurrences"])
def test_scoring_memory_does_not_grow_with_the_vocabulary(weigh):
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 6000, 12)) + " all" for _ in range(2048)]
    asked = [Counter([f"w{w}" for w in rng.integers(0, 6000, 200)] + ["all", ""]) for _ in range(40)]
    terms = [[{"term": w, "uses": n, "df": len(texts) if w in ("all", "") else 4, "dl": 13 * len(texts)} for w, n in c.items()] for c in asked]
    kernel = lexical.TermKernel(weigh)
    state = kernel.prepare(pa.table({"terms": terms}))
    loaded = kernel.load(pa.table({"text": texts}))
    tracemalloc.start()
    got = kernel.score(state, loaded)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    spelled = [Counter(t.split()) for t in texts]
    for i, q in ((0, 0), (7, 39), (2047, 11), (1000, 20)):
        want = 0.0
        for term in terms[q]:
            tf = spelled[i][term["term"]]
            if tf and weigh == "bm25":
                weight = term["uses"] * np.log1p((len(texts) - term["df"] + 0.5) / (term["df"] + 0.5))
                want += weight * tf * 2.5 / (tf + 1.5)
            elif tf:
                want += 1 if weigh == "coverage" else tf
        assert got[i, q] == pytest.approx(want)


@pytest.mark.parametrize("keep", [blocks.Keep(k=3), blocks.Keep(budget=40)])
def test_rows_that_others_of_a_batch_push_out_are_not_copied(keep):
    rng = np.random.default_rng(9)
    batch = pa.table({"position": rng.permutation(2000), "size": rng.integers(1, 30, 2000)})
    scores = rng.integers(0, 2, (2000, 5)).astype(float)
    chosen = blocks._Selection(keep, 5, ("position",), "size")
    chosen._take(scores, batch, None)
    assert chosen.rows.num_rows <= 5 * 42
    chosen._trim()
    position, size = (batch.column(c).to_numpy() for c in ("position", "size"))
    wanted = []
    for q in range(5):
        order, used = np.lexsort((position, -scores[:, q])), 0
        for n, i in enumerate(order):
            if n >= (keep.k or 2000) or (keep.budget and used > keep.budget):
                break
            wanted.append((q, int(position[i])))
            used += size[i]
    assert list(zip(chosen.rows.column("_query").to_pylist(), chosen.rows.column("position").to_pylist())) == wanted


def test_a_stored_index_has_a_row_for_each_segment(spark, tmp_path, monkeypatch):
    from lodestone.operators import postings

    monkeypatch.setattr(postings, "SEGMENT_CHUNKS", 16)
    rng = random.Random(4)
    rows = [(i, i, " ".join(rng.choices(["a", "b", "가c", "d.", "e7", "ü"], k=i % 9)), None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, doc_order long, text string, metadata map<string,string>")
    asked = spark.createDataFrame([(1, "a 가c"), (2, "d. d. e7"), (None, "b"), (4, "zz")], "query_id long, query string")
    for tokenizer in (lexical.T.tokens, lambda text: F.split(text, " ")):
        index = lexical.BM25(C.build_index(docs, 40), tokenizer=tokenizer)
        path = str(tmp_path / str(tokenizer is lexical.T.tokens))
        StoredBM25.write(index, path, 4, 3)
        stored = StoredBM25(spark, path, tokenizer)
        assert 1 < stored.blocks.count() <= stored.about["segments"] == 7
        key = lambda f: sorted((str(r["query_id"]), r["rank"], str(r["position"]), round(r["score"], 8)) for r in f.collect())
        assert key(stored.search(asked, 4)) == key(index.search(asked, 4))
        held = {r["term"]: r["df"] for r in index.document_frequency().collect()}
        work = {r["query_id"]: r for r in stored.work(asked, 1).collect()}
        assert work.keys() == {1, 2, None} and work[2]["postings"] == held.get("d.", 0) + held.get("e7", 0)


def test_stored_rows_that_share_a_position_add_up(spark, tmp_path):
    texts = [(1, "red blue."), (1, "red green."), (2, "red red."), (3, "blue"), (None, "red"), (None, "blue red")]
    rows = [(i, i, text, None) for i, text in texts]
    docs = spark.createDataFrame(rows, "doc_id long, doc_order long, text string, metadata map<string,string>")
    asked = spark.createDataFrame([(7, "red blue")], "query_id long, query string")
    index = lexical.BM25(C.build_index(docs, 40))
    every = index.search(asked, 10).groupBy("position").agg(F.sum("score").alias("score"))
    stored = StoredBM25.write(index, str(tmp_path / "twice")).search(asked, 10)
    key = lambda f: sorted((str(r["position"]), round(r["score"], 8)) for r in f.collect())
    assert key(stored) == key(every) and stored.count() == 4
