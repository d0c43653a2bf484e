"""Each operator against brute force, on given rows and on odd ones."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import cover, fm_index, jaccard, licenses, mixing, packing, quality, records, suffixes, toxicity
from lodestone.llm.queries import QUERIES, tokenizer_file
from lodestone.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def same(left, right):
    assert Counter(map(repr, left)) == Counter(map(repr, right))


@pytest.fixture(scope="module")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module", params=["given", "odd", "empty"])
def docs(request, given, odd, empty):
    return {"given": given, "odd": odd, "empty": empty}[request.param]


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# Quality ------------------------------------------------------------------
def base_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_statistics(docs):
    out = docs.select("doc_id", "text", quality.statistics(F.col("text")).alias("q")).select("doc_id", "text", "q.*")
    for r in out.collect():
        assert tuple(r[n] for n in quality.BASE) == base_statistics(r["text"])


def test_colliding_window_hashes_fall_back_to_words(spark, monkeypatch):
    monkeypatch.setattr(quality, "_window_hashes", lambda w: F.transform(F.slice(w, 1, F.size(w) - 4), lambda x: F.lit(1)))
    text = "a b c d e f a b c d e g h i j"
    row = spark.createDataFrame([(text,)], "text string").select(quality.statistics(F.col("text"))["n_repeat_words"]).first()
    assert row[0] == base_statistics(text)[4] == 10


def learned_by_hand(rows, names, cuts):
    """Sequential covering over plain rows ``(values, bad, grow)``."""
    rules, rest = [], rows

    def holds(test, values):
        name, above, cut = test
        return (values[name] >= cut) == above

    def gain(test, covered):
        inside = [bad for values, bad, _ in covered if holds(test, values)]
        share = sum(bad for _, bad, _ in covered) / len(covered)
        return sum(inside) * (math.log2(sum(inside) / len(inside)) - math.log2(share)) if any(inside) else 0.0

    while len(rules) < quality.MAX_RULES:
        covered, tests = [r for r in rest if r[2]], []
        while len(tests) < quality.MAX_TESTS and 0 < sum(r[1] for r in covered) < len(covered):
            best, chosen = 0.0, None
            for name in names:
                for cut in cuts[name]:
                    for above in (False, True):
                        if gain((name, above, cut), covered) > best + 1e-9:
                            best, chosen = gain((name, above, cut), covered), (name, above, cut)
            if chosen is None:
                break
            tests.append(chosen)
            covered = [r for r in covered if holds(chosen, r[0])]
        sums = []
        for k in range(1, len(tests) + 1):
            inside = [bad for values, bad, grow in rest if not grow and all(holds(t, values) for t in tests[:k])]
            sums.append((sum(inside), len(inside) - sum(inside)))
        if not sums:
            break
        size = max(range(len(sums)), key=lambda k: ((sums[k][0] - sums[k][1]) / max(sum(sums[k]), 1), -k))
        p, n = sums[size]
        if p < quality.MIN_COVER or p < quality.MIN_PRECISION * (p + n):
            break
        rules.append(tuple(tests[: size + 1]))
        rest = [r for r in rest if not all(holds(t, r[0]) for t in rules[-1])]
    return rules


def labelled_texts(noisy):
    rng = np.random.default_rng(5)
    junk = [(i, "$$ %% ## " + " ".join(f"w{i}x{j}" for j in range(17 + i % 5)), 0) for i in range(60)]
    long = [(60 + i, " ".join(f"{'q' * 15}{i}y{j}" for j in range(20 + i % 5)), 0) for i in range(60)]
    good = [(200 + i, " ".join(f"plain{i}x{j}" for j in range(20 + i % 5)), 1) for i in range(90)]
    rows = junk + long + good
    return [(i, t, int(1 - q) if noisy and rng.random() < 0.04 else q) for i, t, q in rows]


@pytest.mark.parametrize("noisy", [False, True])
def test_decision_list_is_that_of_a_plain_learner(spark, noisy):
    table = spark.createDataFrame(labelled_texts(noisy), "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").union(spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int"))
    judged, learned = quality.judge(table.select("doc_id", "text"), labels)
    values = quality.features(F.col("s"))
    flat = quality.labelled_rows(judged, labels).select(
        "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *[v.alias(n) for n, v in values.items()]
    ).collect()
    assert len(flat) == 210
    cuts = {}
    for name in values:
        ordered = sorted(r[name] for r in flat)
        cuts[name] = sorted({ordered[math.ceil((i + 1) / (quality.BINS + 1) * len(ordered)) - 1] for i in range(quality.BINS)})
    rows = [({n: r[n] for n in values}, r["bad"], r["grow"]) for r in flat]
    expected = learned_by_hand(rows, list(values), cuts)
    assert [tuple((t.feature, t.above, t.threshold) for t in rule) for rule in learned.rules] == expected
    assert len(expected) >= (1 if noisy else 2)


def test_decision_list_learns_and_orders_rules(spark):
    rows = labelled_texts(False)
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    judged, rules = quality.judge(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    assert rules.rules and any("symbol_share" in str(t) for r in rules.rules for t in r)
    kept = {r["doc_id"]: r["kept"] for r in judged.collect()}
    assert all(kept[i] == (q == 1) for i, _, q in rows)


def test_quality_without_labels_uses_the_base_rule(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for frame in (odd, empty):
        judged, rules = quality.judge(frame.select("doc_id", "text"), none)
        assert rules.rules == ()
        for r in judged.collect():
            n, _, _, _, again = base_statistics(r["text"])
            assert r["kept"] == (not (n < 10 or 100 * again > 20 * n))


# Licenses -----------------------------------------------------------------
def test_license_base(docs):
    texts = defaultdict(list)
    for i, t in pairs(docs):
        texts[i].append(t)
    for r in licenses.digest(licenses.scan(docs)).collect():
        expected = []
        for text in texts[r["doc_id"]]:
            words, at, labels = TOKEN.findall(lowered(text)), [], set()
            for phrase, label in licenses.PHRASES:
                p = phrase.split()
                hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
                at += hits
                labels |= {label} if hits else set()
            expected.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in expected
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_rules_and_suppression(spark):
    assert len(licenses.rules()) > 200
    cases = {
        "Released under the GNU General Public License version 3.": "gpl-3",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "cc by nc cc by nc, under the MIT license under the MIT license": "cc-by-nc,mit",
        "licensed under the Creative Commons Attribution-ShareAlike license": "",
        "Anc ccby nothing here": "",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(frame)).collect()}
    for i, (_, label) in enumerate(cases.items()):
        if label:
            assert got[i]["labels"] == label
    assert got[2]["n_base"] == 4 and got[4]["labels"] == ""


def test_running_maximum_and_containment(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 100):
        found = [(int(a), int(a + rng.integers(0, 9)), int(rng.integers(1, 4)), i) for i, a in enumerate(rng.integers(0, 40, n))]
        ordered = sorted(found, key=lambda d: (d[0], -d[1], d[2], d[3]))
        expected = [
            d[3] for k, d in enumerate(ordered) if not any(e[1] >= d[1] and e[2] <= d[2] for e in ordered[:k])
        ]
        frame = spark.createDataFrame([([(a, -b, r, i, b, "x", 1.0) for a, b, r, i in found],)],
            "f array<struct<start:int,longest:int,rank:int,rule:int,end:int,label:string,score:double>>")
        got = frame.select(licenses.survivors(F.col("f")).alias("k")).first()["k"]
        assert [d["rule"] for d in got] == expected


# Mixing -------------------------------------------------------------------
def filled(sizes, weights, most):
    """Targets by resharing again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [n for n in names if n not in full]
        share = (total - sum(full.values())) / max(sum(weight[n] for n in rest), 1e-300)
        above = [n for n in rest if share * weight[n] > most * sizes[n]]
        if not above:
            return full | {n: share * weight[n] for n in rest}
        full |= {n: most * sizes[n] for n in above}


def test_mix_reaches_targets(docs):
    sizes = mixing.measured(docs)
    out = mixing.mix(sizes).collect()
    again = mixing.mix(sizes.repartition(5)).collect()
    same(out, again)
    assert len(out) == docs.count()
    per = Counter()
    for r in out:
        per[r["source"]] += r["size"]
    goals = filled(dict(per), (5, 2, 1), 3) if per else {}
    for r in out:
        assert r["source_size"] == per[r["source"]] and r["target"] == pytest.approx(goals[r["source"]])
        assert 0 <= r["copies"] <= 3
    for source, goal in goals.items():
        own = [r for r in out if r["source"] == source]
        off = abs(sum(r["size"] * r["copies"] for r in own) - goal)
        assert off <= max((r["size"] for r in own), default=0) / 2 + 1e-6
    copies = {math.floor(min(3, r["target"] / r["source_size"])) for r in out if r["size"] and r["source_size"]}
    assert all(c <= 3 for c in copies)


def test_mix_prefers_by_affinity(spark):
    frame = spark.createDataFrame([(i, "ab"[i % 2], 10, 1.0 + 8 * (i % 4 < 2)) for i in range(4000)], "doc_id long, source string, size long, liked double")
    out = mixing.mix(frame, (1, 3), affinity="liked").groupBy((F.col("doc_id") % 4).alias("k")).agg(F.avg("copies").alias("c")).collect()
    mean = {r["k"]: r["c"] for r in out}
    assert mean[0] > 3 * mean[2] > 0


@pytest.mark.parametrize("seed", ["mix", "b", "c", "d", "e"])
def test_mix_fills_behind_long_texts(spark, seed):
    rng = np.random.default_rng(7)
    rows = [(i, "a", int(n)) for i, n in enumerate(rng.integers(5, 40, 400))]
    rows.append((1000, "a", sum(r[2] for r in rows)))  # half of its source
    rows += [(2000 + i, "b", int(n)) for i, n in enumerate(rng.integers(1, 2000, 300))]
    rows += [(3000 + i, "c", int(n)) for i, n in enumerate(rng.integers(5, 40, 100))]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(3)
    got = mixing.mix(frame, seed=seed).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")
    ).collect()
    assert sum(r["n"] for r in got) == len(rows)
    for r in got:
        assert r["taken"] == pytest.approx(r["target"], rel=0.02)


def test_mix_reshares_what_full_documents_cannot_take(spark):
    rows = [(i, "a", 10, 50.0 if i < 40 else 1.0) for i in range(400)] + [(1000 + i, "b", 10, 1.0) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long, liked double")
    out = mixing.mix(frame, (3, 1), affinity="liked").collect()
    words = Counter()
    for r in out:
        words[r["source"]] += r["size"] * r["copies"]
        assert r["copies"] == 3 or r["source"] != "a" or r["doc_id"] >= 40
    for r in out:
        assert words[r["source"]] == pytest.approx(r["target"], rel=0.01)


# Tokens, records, packing ---------------------------------------------------
@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain):
    import random

    rng, parts = random.Random(5), ["a", "B", "1", "é", "é", ".", ",$", "'s", " ", "\n", "\x01", "—", "<|endoftext|>", "中", "İ", "\x1d", "ǰ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, ""]
    encoder = Encoder(tokenizer_file())
    assert encoder.by_word
    for text, ids in zip(texts, encoder.ids(texts)):
        assert list(ids) == plain(text)


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_round_trip(docs, plain):
    manifest = records.write(docs, tokenizer_file(), 2)
    got = sorted(records.read(manifest).collect(), key=lambda r: r["start"])
    expected = sorted(((i is not None, i or 0, t or "") for i, t in pairs(docs)))
    start = 0
    assert len(got) == len(expected)
    ties = defaultdict(list)
    for r, (known, i, text) in zip(got, expected):
        assert r["doc_id"] == (i if known else None) and r["start"] == start
        start += r["n_tokens"]
        ties[r["doc_id"]].append((r["n_tokens"], r["ids_crc32"], text))
    for rows in ties.values():
        ids = [[*plain(t), 2] for _, _, t in rows]
        same([(len(i), checksum(i)) for i in ids], [(n, c) for n, c, _ in rows])
    shuffled = records.read_all(docs.sparkSession, manifest, 9).select("doc_id", "n_tokens", "ids").collect()
    assert len(shuffled) == len(got) and all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 2 for r in shuffled)


def test_damaged_records_are_noticed(tmp_path):
    import io

    data = records.record(b"abcd")
    stream = io.BytesIO(data + data)
    assert records.read_record(stream) == records.read_record(stream) == b"abcd" and records.read_record(stream) is None
    for at in (0, 9, 13, len(data) - 1):
        with pytest.raises(ValueError):
            records.read_record(io.BytesIO(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    with pytest.raises(ValueError):
        records.read_record(io.BytesIO(data[:-2]))


def check_packing(out, expected, capacity):
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out], expected)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("per_task", [100_000, 40])
def test_packing(docs, plain, monkeypatch, per_task):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", per_task)
    out = packing.pack_documents(docs, tokenizer_file(), 0, 2048).collect()
    expected, total = [], 0
    for i, text in pairs(docs):
        ids = [*plain(text), 0]
        total += len(ids)
        expected += [(i, k, at, len(ids[at : at + 2048]), checksum(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    n = check_packing(out, expected, 2048)
    assert n <= math.ceil(1.03 * total / 2048) + 1


def test_packing_matches_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 50)
    sizes = [60] * 300 + [40] * 300 + [5] * 200 + [100] * 3
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, length int")
    out = packing.pack(items, 100).collect()
    assert sorted(r["id"] for r in out) == list(range(len(sizes)))
    load = Counter()
    for r in out:
        load[r["sequence_id"]] += sizes[r["id"]]
    assert max(load.values()) <= 100 and len(load) <= math.ceil(1.05 * sum(sizes) / 100)


# Similarity ---------------------------------------------------------------
def grams(text, k):
    words = WORD.findall(lowered(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1)))


def grouped(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard(docs, k, percent):
    sets = defaultdict(list)
    for i, t in pairs(docs):
        sets[i].append(grams(t, k))
    ids = [i for i in sets if i is not None]
    linked = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = sets[a][0], sets[b][0]
            if p and q and 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                if 100 * len(p & q) >= percent * len(p | q):
                    linked.append((a, b))
    expected = grouped(ids, linked)
    members, links = jaccard.join(docs, k, percent)
    got = members.collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
        assert r["component_id"] == (expected[r["doc_id"]] if r["doc_id"] is not None else None)
    assert links.count() <= len(linked)


def test_jaccard_of_a_large_near_copy_group(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 200, 3):
            words[at] = f"z{i}x{at}"
        texts.append((i, " ".join(words)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {i: grams(t, 3) for i, t in texts}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    members, links = jaccard.join(frame, 3, 90)
    assert {r["doc_id"]: r["component_id"] for r in members.collect()} == grouped(sets, linked)


@pytest.mark.parametrize("part", [256, 16])
def test_jaccard_gives_every_link(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard, "PART_SETS", part)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    rng = np.random.default_rng(3)
    texts = []
    for group in range(3):
        for i in range(80):
            words = [f"g{group}w{x}" for x in range(200 + int(rng.integers(0, 40)))]
            for at in rng.integers(0, 200, 1):
                words[at] = f"z{i}x{at}"
            texts.append((100 * group + i, " ".join(words)))
    texts += [(900 + i, texts[i][1]) for i in range(5)] + [texts[0], (1000, "alone"), (1001, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {i: grams(t, 3) for i, t in texts if i < 900}
    expected = [
        (a, b) for a in sets for b in sets
        if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and sets[a] != sets[b]
    ]
    members, links = jaccard.join(frame, 3, 90)
    same([tuple(r) for r in links.collect()], expected)
    assert len(expected) > 3 * 80 and {r["class_id"] for r in members.where("doc_id >= 900").collect()} == {*range(5), 1000, 1001}


def test_jaccard_links_of_given_texts(docs):
    sets = {i: grams(t, 3) for i, t in pairs(docs) if i is not None}
    smallest = {}
    for i in sorted(sets):
        smallest.setdefault(sets[i], i)
    ids = [i for s, i in smallest.items() if s]
    expected = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])]
    same([tuple(r) for r in jaccard.join(docs, 3, 60)[1].collect()], expected)


@pytest.mark.parametrize("block", [8192, 40])
def test_cover_tree(spark, sf, monkeypatch, block):
    monkeypatch.setattr(cover, "BLOCK_ROWS", block)
    monkeypatch.setattr(cover, "DIRECT", 16)
    rng = np.random.default_rng(2)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    base = rng.standard_normal(64)
    near = [base + 0.25 * rng.standard_normal(64) for _ in range(60)]
    rows += [(10_000 + i, [float(v) for v in x]) for i, x in enumerate(near)]
    rows += [(20_000, rows[0][1]), (20_001, rows[0][1]), (20_002, [2 * v for v in rows[0][1]])]
    bad = [(30_000, None), (30_001, []), (30_002, [0.0] * 64), (30_003, [1.0, None] * 32), (30_004, [float("nan")] * 64),
           (30_005, [float("inf")] + [0.0] * 63), (30_006, [1.0, 2.0]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(np.triu(hit))
    expected = grouped(ids.tolist(), zip(ids[a].tolist(), ids[b].tolist()))
    got = {r["id"]: r for r in cover.near_duplicates(frame, 0.9).collect()}
    for i, n in zip(ids.tolist(), hit.sum(1)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (n, expected[i])
    for i, _ in bad:
        assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)
    assert cover.near_duplicates(frame.limit(0), 0.9).count() == 0


@pytest.mark.parametrize("sample", [2048, 40])
def test_cover_tree_links_vectors_of_every_length(spark, monkeypatch, sample):
    monkeypatch.setattr(cover, "SAMPLE", sample)
    monkeypatch.setattr(cover, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    sizes = [1] * 5 + [2] * 30 + [3] * 60 + [8] * 100
    rows = [(i, [float(c) for c in rng.standard_normal(n)]) for i, n in enumerate(sizes)]
    rows += [(500, [1.0, 0.0]), (501, [1.0, 0.0, 0.0]), (502, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found, n_links = [], Counter()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if len(x) == len(y) and np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.9:
                found.append((a, b))
                n_links.update((a, b))
    expected = grouped([a for a, _ in rows], found)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in cover.near_duplicates(frame, 0.9).collect()}
    assert got == {a: (n_links[a], expected[a]) for a, _ in rows} and len(found) > 100


def test_cover_tree_lists_no_block_pairs_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(cover, "BLOCK_ROWS", 3)
    monkeypatch.setattr(cover, "MAX_CELLS", 4)
    sent, create = [], type(spark).createDataFrame
    x = np.random.default_rng(4).standard_normal((60, 8)) + 1.5
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    def recorded(self, data, *args, **named):
        sent.append(len(data))
        return create(self, data, *args, **named)

    monkeypatch.setattr(type(spark), "createDataFrame", recorded)
    got = {r["id"]: r["n_links"] for r in cover.near_duplicates(frame, 0.9).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert got == dict(enumerate(((x @ x.T >= 0.9).sum(1) - 1).tolist()))
    assert max(sent) <= 4 * 5 // 2


# Repeats ------------------------------------------------------------------
@pytest.mark.parametrize("max_group", [50_000, 2])
def test_suffix_dedup(docs, monkeypatch, max_group):
    monkeypatch.setattr(suffixes, "MAX_GROUP", max_group)
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    texts = sorted((i, (t or "").encode()) for i, t in pairs(docs) if i is not None)
    first, expected = {}, defaultdict(set)
    for i, data in texts:
        for s in range(len(data) - 99):
            first.setdefault(data[s : s + 100], (i, s))
    for i, data in texts:
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if first[data[s : s + 100]] != (i, s):
                gone[s : s + 100] = b"\1" * 100
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        left = bytes(c for c, g in zip(data, gone) if not g)
        expected[i].add((len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    got = suffixes.digest(suffixes.removed(docs.select("doc_id", "text"), 100)).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert tuple(r)[1:] in expected[r["doc_id"]]


def test_texts_that_share_an_id_are_cut_apart(spark):
    a = " ".join(f"word{i % 97} runs{i % 13}" for i in range(120))
    b = " ".join(f"other{i} goes{i % 7}" for i in range(130))
    schema = "doc_id long, text string, few string, many string, starts long, own long, rest string"
    rows = [(0, a), (1, a), (1, b), (2, None), (None, a)]
    table = spark.createDataFrame([(*r, "f", "m", 1, 2, "r") for r in rows], schema).repartition(3)
    for module, length in ((suffixes, 100), (fm_index, 35)):
        cut = module.removed(table, length)
        assert set(cut.schema["rest"].dataType.names) == {"few", "many", "starts", "own", "rest"}
        left = {(r["doc_id"], r[1]): r["n_removed"] for r in module.digest(cut).collect()}
        size = (lambda t: len(t.encode())) if module is suffixes else (lambda t: len(t.split()))
        assert left[1, size(b)] == 0 and left[1, size(a)] == size(a) and left[None, size(a)] == 0
        assert left[0, size(a)] == (0 if module is suffixes else size(a))


def test_very_frequent_anchors_go_another_way(spark, monkeypatch):
    lines = "the same long line stands in very many documents and is always written in just this way so that its anchors are seen again and again by every task of the whole job that reads them as it goes"
    table = spark.createDataFrame([(i, f"start {i} {lines} end {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    for module, length in ((suffixes, 100), (fm_index, 30)):
        plain = sorted(map(tuple, module.digest(module.removed(table, length)).collect()))
        monkeypatch.setattr(module, "MAX_GROUP", 40)
        assert sorted(map(tuple, module.digest(module.removed(table, length)).collect())) == plain
        assert sum(r[2] > 0 for r in plain) >= 399


def test_suffix_sort_orders_and_verifies(monkeypatch):
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (300, 20)).astype(np.uint8)
    rows[100:200] = rows[:100]
    lengths = rng.integers(0, 21, 300)
    for i, n in enumerate(lengths):
        rows[i, n:] = 0
    group = np.sort(rng.integers(0, 5, 300))
    plain = sorted(range(300), key=lambda i: (group[i], rows[i, : lengths[i]].tobytes(), i))
    texts = suffixes.Suffixes(rows, lengths)
    order, shared = texts.checked(texts.order(group), group)
    assert [rows[i, : lengths[i]].tobytes() for i in order] == [rows[i, : lengths[i]].tobytes() for i in plain]
    texts.prefix[:] = 0  # every prefix collides
    order, shared = texts.checked(texts.order(group), group)
    assert [rows[i, : lengths[i]].tobytes() for i in order] == [rows[i, : lengths[i]].tobytes() for i in plain]
    for k in range(1, 300):
        a, b = order[k - 1], order[k]
        n = 0
        while group[a] == group[b] and n < min(lengths[a], lengths[b]) and rows[a, n] == rows[b, n]:
            n += 1
        assert shared[k] == n


@pytest.mark.parametrize("max_group", [50_000, 2])
def test_fm_index_dedup(docs, monkeypatch, max_group):
    monkeypatch.setattr(fm_index, "MAX_GROUP", max_group)
    monkeypatch.setattr(fm_index, "INDEXED", 100)
    texts = [(i, WORD.findall(t or "")) for i, t in pairs(docs)]
    often = Counter(tuple(w[s : s + 35]) for i, w in texts if i is not None for s in range(len(w) - 34))
    expected = defaultdict(set)
    for i, words in texts:
        gone = bytearray(len(words))
        for s in range(len(words) - 34):
            if i is not None and often[tuple(words[s : s + 35])] > 1:
                gone[s : s + 35] = b"\1" * 35
        left = " ".join(w for w, g in zip(words, gone) if not g)
        expected[i].add((len(words), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    got = fm_index.digest(fm_index.removed(docs.select("doc_id", "text"), 35)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:] in expected[r["doc_id"]]


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 37, 1000)
    tree = fm_index.WaveletMatrix(values, 6)
    symbols, at = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert list(tree.rank(symbols, at)) == [int((values[:p] == c).sum()) for c, p in zip(symbols, at)]


# Toxicity -----------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    out = QUERIES["op6_toxicity"](spark, big)
    rows = out.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    toxic = [r["score"] for r in held if r["toxic"] == 1]
    clean = [r["score"] for r in held if r["toxic"] == 0]
    better = np.mean([[a > b for b in clean] for a in toxic])
    assert better > 0.85 and np.mean([s < 0.5 for s in clean]) > 0.97


def test_toxicity_reads_no_held_out_label_and_survives_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [toxicity.score(odd, toxicity.train(odd, x)).collect() for x in (labels, flipped)]
    same(*scores)
    assert len(scores[0]) == odd.count() and all(0 <= r["score"] <= 1 for r in scores[0])
    none = toxicity.train(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.score(empty, none).count() == 0


def test_pairs_of_a_long_block_are_looked_at_a_few_at_a_time():
    import tracemalloc

    def pairs(ids, n, place, component):
        names = ["gram", "id", "n", "place", "component"]
        columns = [np.zeros(len(ids), np.int64), ids, n, place, component]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        return [p for out in jaccard._across(80)(iter([batch])) for p in zip(*(c.to_pylist() for c in out.columns))]

    ids = np.arange(12_000)
    tracemalloc.start()
    assert pairs(ids, np.full(12_000, 100), np.full(12_000, 90), ids) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    rng = np.random.default_rng(2)
    ids, n = rng.permutation(1500), np.sort(rng.integers(3, 60, 1500))
    place, component = rng.integers(0, 3, 1500), rng.integers(0, 9, 1500)
    wanted = {
        (min(ids[i], ids[j]), max(ids[i], ids[j]))
        for i in range(1500)
        for j in range(i + 1, np.searchsorted(n, 100 * n[i] // 80, "right"))
        if component[i] != component[j] and jaccard._may_link(n[i], place[i], n[j], place[j], 80)
    }
    found = pairs(ids, n, place, component)
    assert wanted and set(found) == wanted and len(found) == len(wanted)


def test_the_join_sends_few_rows_to_python_at_a_time(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(jaccard, "saved", lambda frame, name, kept=jaccard.saved: seen.append(spark.conf.get(key)) or kept(frame, name))
    frame = spark.createDataFrame([(i, f"some words of a text that is not long {i % 3}") for i in range(9)], "doc_id long, text string")
    jaccard.join(frame, 3, 90)
    assert seen and {int(n) for n in seen} == {jaccard.BATCH_ROWS}
    assert spark.conf.get(key) == before
