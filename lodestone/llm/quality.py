"""Quality rules: statistics of a text and a learned decision list over them.

The list is learned by sequential covering. Rows with a quality label are split
into a growing and a pruning part by a hash of their id. A rule starts empty and
takes the threshold test with the highest information gain until it covers no
good row of the growing part; then its last tests are cut as far as that helps on
the pruning part. Rules that do not hold there end the list. The result is one
ordered CASE WHEN expression over the statistics: everything runs as DataFrame
expressions and aggregates, and the driver sees counts per (statistic, bin) only.

Defined cases: a null or empty text has all statistics 0 and fails the base rule;
labels that are null are ignored, of several labels of a document the smallest
counts; without labels the list is empty and only the base rule decides; repeated
rows are judged one by one; other columns of the input are kept as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, saved

WINDOW = 5
BINS = 48
MAX_RULES = 8
MAX_TESTS = 3
#: Share of bad rows a rule must reach on the pruning part, and rows it must cover.
MIN_PRECISION = 0.95
MIN_COVER = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(at: Column) -> Column:
    """Words inside windows that start at these places, in ascending order."""
    own = F.transform(
        at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))
    )
    return F.aggregate(own, F.lit(0), lambda total, n: total + n)


def _repeated(words: Column, keys: Column) -> Column:
    """Words inside windows whose key occurs at least twice; ``keys[i]`` is window i's."""

    def twice(ordered: Column) -> Column:
        same = F.transform(
            ordered,
            lambda e, j: F.when(
                F.coalesce(F.get(ordered, j - 1)["k"] == e["k"], F.lit(False))
                | F.coalesce(F.get(ordered, j + 1)["k"] == e["k"], F.lit(False)),
                e["i"],
            ),
        )
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    keyed = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    return let(F.sort_array(keyed), lambda o: let(twice(o), _covered))


def _collide(words: Column, hashes: Column) -> Column:
    """Whether windows with one hash differ: the hashes then do not tell."""

    def differs(ordered: Column) -> Column:
        return F.exists(
            F.sequence(F.lit(1), F.size(ordered) - 1),
            lambda j: (F.get(ordered, j)["k"] == F.get(ordered, j - 1)["k"])
            & (
                F.slice(words, F.get(ordered, j)["i"] + 1, WINDOW)
                != F.slice(words, F.get(ordered, j - 1)["i"] + 1, WINDOW)
            ),
        )

    return let(
        F.sort_array(F.transform(hashes, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), differs
    )


def _window_hashes(words: Column) -> Column:
    """Hashes of the windows, from hashes of words, pairs and fours of words."""

    def both(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    def shifted(values: Column, by: int) -> Column:
        return F.slice(values, by + 1, F.size(values))

    def fives(ones: Column) -> Column:
        return let(
            F.zip_with(ones, shifted(ones, 1), both),
            lambda twos: let(
                F.zip_with(twos, shifted(twos, 2), both),
                lambda fours: F.slice(
                    F.zip_with(fours, shifted(ones, 4), both), 1, F.size(ones) - WINDOW + 1
                ),
            ),
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), fives)


def _repeat_words(words: Column) -> Column:
    as_text = F.transform(
        F.sequence(F.lit(1), F.size(words) - WINDOW + 1),
        lambda i: F.array_join(F.slice(words, i, WINDOW), " "),
    )
    return let(
        _window_hashes(words),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
        .when(_collide(words, h), _repeated(words, as_text))
        .otherwise(_repeated(words, h)),
    )


def statistics(text: Column) -> Column:
    """Struct of the counts of one text; every count is of the whole text.

    Windows are first compared by hash; where equal hashes hide different words,
    the text's windows are compared as words.
    """
    plain = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        n = F.size(words)
        joined = F.array_join(words, "")
        lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(WORD))
        repeats = F.when(n <= WINDOW, F.lit(0)).otherwise(_repeat_words(words))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            (F.length(joined) - F.length(F.regexp_replace(joined, r"[#*$%&|<>]++", "")))
            .cast("long")
            .alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeats.cast("long").alias("n_repeat_words"),
            (F.length(joined) - F.length(F.regexp_replace(joined, r"[A-Z]++", "")))
            .cast("long")
            .alias("n_capitals"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return let(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)), of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """What the rules test: shares and lengths, defined for empty texts too."""
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    return {
        "symbol_share": s["n_symbols"] / chars,
        "capital_share": s["n_capitals"] / chars,
        "word_length": s["word_chars"] / words,
        # Grows little with the length, unlike the plain share of distinct words.
        "variety": F.log(F.greatest(s["n_distinct"], F.lit(1)))
        / F.log(F.greatest(words, F.lit(2))),
        "repeat_share": s["n_repeat_words"] / words,
        "dup_line_share": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "words_per_line": s["n_words"] / F.greatest(s["n_lines"], F.lit(1)),
        "n_words": s["n_words"].cast("double"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, Column]) -> Column:
        x = values[self.feature]
        return (x >= self.threshold) if self.above else (x < self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects, none means kept."""

    rules: tuple[tuple[Test, ...], ...]

    def rejects(self, s: Column) -> Column:
        values = features(s)
        chain = F.lit(False)
        for rule in reversed(self.rules):
            holds = F.lit(True)
            for test in rule:
                holds = holds & test.holds(values)
            chain = F.when(holds, F.lit(True)).otherwise(chain)
        return chain

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nkeep"


def _counts(rows: DataFrame, names: list[str]) -> list[list[tuple[int, int]]]:
    """(bad, good) per feature and bin: a table of fixed size."""
    cells = (
        rows.select("bad", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("feature", "bin")
        .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
        .collect()
    )
    table = [[(0, 0)] * (BINS + 1) for _ in names]
    for c in cells:
        table[c["feature"]][c["bin"]] = (c["bad"], c["good"])
    return table


def _best(table, cuts: list[list[float]], bad: int, good: int):
    """The test with the highest FOIL gain, as (gain, feature, above, bin)."""
    start = math.log2(bad / (bad + good))
    best = (0.0, -1, False, 0)
    for f, row in enumerate(table):
        low_bad = low_good = 0
        for b in range(len(cuts[f])):
            low_bad, low_good = low_bad + row[b][0], low_good + row[b][1]
            for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if p:
                    gain = p * (math.log2(p / (p + n)) - start)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, above, b)
    return best


def learn(labelled: DataFrame) -> DecisionList:
    """A list from rows ``(doc_id, s, bad 0/1)``; all of them are used."""
    names = list(features(F.col("s")))
    values = features(F.col("s"))
    shares = [(i + 1) / (BINS + 1) for i in range(BINS)]
    flat = labelled.select("doc_id", "bad", *[values[n].alias(n) for n in names])
    found = flat.agg(*[F.percentile_approx(n, shares, 2000).alias(n) for n in names]).first()
    cuts = [sorted(set(found[n] or ())) for n in names]
    if not any(cuts):
        return DecisionList(())

    def bin_of(name: str, at: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in at]), lambda c: c <= F.col(name)))

    binned = saved(
        flat.select(
            "bad",
            (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"),
            F.array(*[bin_of(n, at) for n, at in zip(names, cuts)]).alias("bins"),
        ),
        "binned",
    )

    def holds(test) -> Column:
        _, f, above, b = test
        x = F.get("bins", F.lit(f))
        return (x > b) if above else (x <= b)

    rest, rules = binned, []
    while len(rules) < MAX_RULES:
        covered, tests = rest.where("grow"), []
        while len(tests) < MAX_TESTS:
            table = _counts(covered, names)
            bad, good = (sum(c[i] for c in table[0]) for i in (0, 1))
            if not bad or not good:
                break
            test = _best(table, cuts, bad, good)
            if test[1] < 0:
                break
            tests.append(test)
            covered = covered.where(holds(test))
        if not tests:
            break
        kept = F.lit(True)
        sums = []
        for k, test in enumerate(tests):
            kept = kept & holds(test)
            sums += [
                F.sum(F.when(kept, F.col("bad"))).alias(f"p{k}"),
                F.sum(F.when(kept, 1 - F.col("bad"))).alias(f"n{k}"),
            ]
        seen = rest.where("not grow").agg(*sums).first()
        worth = [
            ((seen[f"p{k}"] or 0) - (seen[f"n{k}"] or 0)) / max((seen[f"p{k}"] or 0) + (seen[f"n{k}"] or 0), 1)
            for k in range(len(tests))
        ]
        size = max(range(len(tests)), key=lambda k: (worth[k], -k)) + 1
        p, n = seen[f"p{size - 1}"] or 0, seen[f"n{size - 1}"] or 0
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rule = tests[:size]
        rules.append(tuple(Test(names[f], above, cuts[f][b]) for _, f, above, b in rule))
        match = F.lit(True)
        for test in rule:
            match = match & holds(test)
        rest = rest.where(~match)
    return DecisionList(tuple(rules))


def labelled_rows(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``scored`` (doc_id, s) that have a quality label, as ``bad`` 0/1."""
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((1 - F.min("quality")).cast("long").alias("bad"))
    )
    return scored.select("doc_id", "s").join(known, "doc_id").where(~base_failed(F.col("s")))


def judge(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> tuple[DataFrame, DecisionList]:
    """``docs`` with ``s``, ``base_failed`` and ``kept``, and the list that decided.

    The statistics are computed once, written (with the texts if they are wanted
    again), learned from and then judged.
    """
    scored = docs.withColumn("s", statistics(F.col("text")))
    scored = saved(scored if keep_text else scored.drop("text"), "statistics")
    rules = learn(labelled_rows(scored, labels))
    failed = base_failed(F.col("s"))
    return (
        scored.withColumn("base_failed", failed).withColumn(
            "kept", F.when(failed, F.lit(False)).otherwise(~rules.rejects(F.col("s")))
        ),
        rules,
    )
