"""The pipeline's stages against brute force, each on its own input."""

import math
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lodestone.llm import quality
from test_llm_operators import WORD, base_statistics, check_packing, checksum, filled, grams, grouped, plain, same  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "pareto_mix", "best_fit_packing",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def check_quality(spark, before, after, sf):
    left = Counter(map(repr, rows_of(after)))
    assert not left - Counter(map(repr, rows_of(before)))
    _, rules = quality.judge(before.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    for r in before.collect():
        n, chars, symbols, dup, again = base_statistics(r["text"])
        failed = n < 10 or 100 * again > 20 * n
        text = r["text"] or ""
        words = WORD.findall(text)
        lines = max(sum(1 for x in text.split("\n") if WORD.search(x)), 1)
        values = {
            "symbol_share": sum(c in "#*$%&|<>" for w in words for c in w) / max(chars, 1),
            "capital_share": sum("A" <= c <= "Z" for c in text) / max(chars, 1),
            "word_length": chars / max(n, 1),
            "variety": math.log(max(len(set(words)), 1)) / math.log(max(n, 2)),
            "repeat_share": again / max(n, 1),
            "dup_line_share": dup / lines,
            "words_per_line": n / lines,
            "n_words": float(n),
        }
        bad = any(all((values[t.feature] >= t.threshold) == t.above for t in rule) for rule in rules.rules)
        near = any(abs(values[t.feature] - t.threshold) < 1e-9 for rule in rules.rules for t in rule)
        if failed or not near:
            assert (left[repr(tuple(r))] > 0) == (not failed and not bad)


def check_join(before, after):
    sets = {r["doc_id"]: grams(r["text"], 5) for r in before.collect() if r["doc_id"] is not None}
    ids = sorted(sets)
    linked = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    group = grouped(ids, linked)
    expected = [i for i in ids if group[i] == i] + [None for r in before.collect() if r["doc_id"] is None]
    same([r["doc_id"] for r in after.collect()], expected)
    assert not Counter(map(repr, rows_of(after))) - Counter(map(repr, rows_of(before)))


def check_suffixes(before, after):
    first, kept = {}, {}
    rows = sorted((r for r in before.collect() if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    for r in rows:
        data = (r["text"] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if first.setdefault(data[s : s + 100], (r["doc_id"], s)) != (r["doc_id"], s):
                gone[s : s + 100] = b"\1" * 100
        left = bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        kept[r["doc_id"]] = None if r["text"] is None else left if any(gone) else r["text"]
    got = {r["doc_id"]: r for r in after.collect() if r["doc_id"] is not None}
    assert {i: r["text"] for i, r in got.items()} == kept
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())


def check_mix(before, after):
    sizes = {repr(tuple(r)): (r["source"], len(WORD.findall(r["text"] or ""))) for r in before.collect()}
    taken = Counter(map(repr, rows_of(after)))
    assert set(taken) <= set(sizes) and max(taken.values(), default=0) <= 3
    total = Counter()
    for source, n in sizes.values():
        total[source] += n
    goals = filled(dict(total), (5, 2, 1), 3) if total else {}
    for source, goal in goals.items():
        own = [(row, n) for row, (s, n) in sizes.items() if s == source]
        off = abs(sum(n * taken[row] for row, n in own) - goal)
        assert off <= max((n for _, n in own), default=0) / 2 + 1e-6


def run_stages(spark, docs, sf, plain):  # noqa: F811
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held[-1], sf).cache()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        held.append(out)
    check_quality(spark, held[0], held[1], sf)
    check_join(held[1], held[2])
    check_suffixes(held[2], held[3])
    check_mix(held[3], held[4])
    expected = []
    for r in held[4].collect():
        ids = [*plain(r["text"]), 0]
        expected += [(r["doc_id"], k, at, len(ids[at : at + 2048]), checksum(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    check_packing(held[5].collect(), expected, 2048)


def test_pipeline_on_documents(spark, sf, plain):  # noqa: F811
    run_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, plain)


def test_pipeline_on_odd_rows(spark, sf, odd, plain):  # noqa: F811
    unique = odd.dropDuplicates(["doc_id"])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert out.count() >= 0
        if name != "best_fit_packing":
            assert out.columns == odd.columns
    check_mix(unique, corpus_pipeline.pareto_mix(spark, unique, sf))
    check_suffixes(unique, corpus_pipeline.suffix_array_dedup(spark, unique, sf))
    assert corpus_pipeline.ngram_jaccard_join(spark, odd, sf).where("doc_id = 2").count() == 1


def test_pipeline_keeps_different_texts_that_share_an_id(spark, sf):
    a = " ".join(f"word{i % 97} runs{i % 13}" for i in range(120))
    b = " ".join(f"other{i} goes{i % 7}" for i in range(120))
    rows = [(0, a), (1, a + " end"), (1, b), (1, b), (3, b + " more"), (None, a)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    joined = corpus_pipeline.ngram_jaccard_join(spark, table.repartition(3), sf)
    assert joined.columns == COLUMNS
    same([(r["doc_id"], r["text"]) for r in joined.collect()], [(0, a), (1, b), (None, a)])
    cut = corpus_pipeline.suffix_array_dedup(spark, table, sf).collect()
    assert Counter(r["text"] for r in cut)[b] == 2


def test_run_leaves_only_its_result_behind(spark, sf):
    from pathlib import Path

    from lodestone.llm.common import shared_folder

    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, sf)
    new = set(folder.iterdir()) - before
    assert len(new) == 1 and "best_fit_packing" in new.pop().name and out.count() > 0


def test_pipeline_on_an_empty_table(spark, sf, empty, plain):  # noqa: F811
    run_stages(spark, empty, sf, plain)


def test_run_reads_documents(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
