"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. A document's expected copies are its
source's target over its source's size, times its own affinity if there is one.
The whole part of that is allocated with certainty. The rest is an inclusion
probability p: documents are ranked by random odds over inclusion odds,
u(1-p) / ((1-u)p), and taken in this order while the source's remaining words last.
The random number u comes from the id and a seed, so reruns agree.

A text that holds much of its source's open words is decided first, by its own odds,
or because the smaller texts cannot fill the target without it. A document too long
for what is left is passed over: further passes fill from the documents behind it
until the source is near its target or nothing fits; the last place goes to the
document that comes nearest to what is left.

Only DataFrame expressions are used. The rank order is cut into buckets of the
ranking value, put so that a source's mean odds spread evenly over them; sums per
bucket are running-summed (at most BUCKETS rows a source), then documents inside
each bucket, so that one source with most of the rows is spread over all tasks.
Documents without open odds are in no window, and a pass touches only sources that
are not near their targets.

Defined cases: null or empty texts have size 0 and take 0 words; a null source is
a source of its own, ordered last; repeated rows are separate documents with
equal rank, and how many of them are taken is defined, which of them is not
visible; an empty table gives an empty mix; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, saved

BUCKETS = 4096
#: Tables of one row per source are broadcast up to so many sources.
BROADCAST_SOURCES = 100_000
MAX_REPEATS = 3
#: A text is long if it holds more than this share of its source's open words.
LONG = 1 / 32
#: A source is near its target if at most this share of it is open.
NEAR = 0.001
#: Times that the excess of documents at ``max_repeats`` is shared anew (affinity only).
RESHARES = 6


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.size(found).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """Target words per source ``(source, source_size)``: weights repeat in source order.

    Targets share the sum of all sizes by weight, none above ``max_repeats`` times
    its source. Sources reach that bound in the order of bound over weight, so the
    common level is the first one at which the next source stays below its bound.
    The table has one row per source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everything = W.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    fill = everything.orderBy("full_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("bound", F.lit(float(max_repeats)) * F.col("source_size"))
        .withColumn("full_at", F.col("bound") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("used", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("used_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn(
            "level", (F.col("total") - F.col("used")) / (F.col("all_weight") - F.col("used_weight"))
        )
        .withColumn("common", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    )
    return ranked.select(
        "source",
        "source_size",
        F.least("bound", F.col("weight") * F.coalesce("common", F.lit(float("inf")))).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_repeats: int = MAX_REPEATS,
    seed: str = "mix",
    affinity: str | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every row of ``docs``.

    ``affinity`` names a positive column by which documents of one source are
    preferred to each other; without it all have the same chance.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    liked = F.lit(1.0) if affinity is None else F.col(affinity).cast("double")
    rows = docs.select("doc_id", "source", "size", key.alias("_key"), liked.alias("_liked"))
    per_source = rows.groupBy("_key").agg(
        F.first("source").alias("source"),
        F.sum("size").alias("source_size"),
        F.sum(F.col("size") * F.col("_liked")).alias("_mass"),
    )
    goals = targets(per_source.select("source", "source_size"), weights, max_repeats)
    level = F.when(F.col("_mass") > 0, F.col("target") / F.col("_mass")).otherwise(0.0)
    per_source = saved(
        per_source.select("_key", "_mass").join(goals.withColumn("_key", key).drop("source"), "_key")
        .withColumn("_level", level).drop("_mass"),
        "sources",
    )
    few = per_source.count() <= BROADCAST_SOURCES

    def by_source(table: DataFrame) -> DataFrame:
        """A table of one row per source, sent to the documents if it is small."""
        return F.broadcast(table) if few else table

    most = F.lit(float(max_repeats))
    for _ in range(0 if affinity is None else RESHARES):
        full = F.col("_level") * F.col("_liked") >= most
        shares = rows.join(by_source(per_source), "_key").groupBy("_key").agg(
            F.sum(F.when(full, F.col("size") * most).otherwise(0.0)).alias("_full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("_liked"))).alias("_mass"),
        )
        again = F.when(F.col("_mass") > 0, (F.col("target") - F.col("_full")) / F.col("_mass"))
        per_source = saved(
            per_source.join(shares, "_key")
            .withColumn("_level", F.greatest(F.col("_level"), F.coalesce(again, F.col("_level"))))
            .drop("_full", "_mass"),
            "sources",
        )

    # Odds q = u(1-p) / ((1-u)p), over the odds of the source's mean p, as x / (1 + x).
    mean = F.least(F.greatest(F.col("_mean"), F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = F.col("_u") * (1 - F.col("_p")) * mean
    against = (1 - F.col("_u")) * F.col("_p") * (1 - mean)
    rows = (
        rows.join(by_source(per_source), "_key")
        .withColumn("_expected", F.least(F.col("_level") * F.col("_liked"), most))
        .withColumn("_whole", F.floor("_expected"))
        .withColumn("_p", F.when(F.col("size") > 0, F.col("_expected") - F.col("_whole")).otherwise(0.0))
        .withColumn("_u", uniform(F.col("doc_id"), seed))
        .withColumn("_mean", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_mean", F.col("_mean") - F.floor("_mean"))
        .withColumn("_rank", F.when(F.col("_p") > 0, odds / (odds + against)))
        .withColumn("_bucket", F.least(F.floor(F.col("_rank") * BUCKETS), F.lit(BUCKETS - 1)))
    )
    budgets = saved(
        rows.groupBy("_key").agg(
            F.first("target").alias("_target"),
            (F.first("target") - F.sum(F.col("size") * F.col("_whole"))).alias("_budget"),
        ),
        "budgets",
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "_whole"]
    kept = [*columns, "_key", "_p", "_u", "_rank", "_bucket", "_nr", "_taken"]
    waiting = rows.where("_p > 0").withColumn("_nr", F.monotonically_increasing_id()).withColumn("_taken", F.lit(False))
    state = saved(waiting.select(*kept), "mixing")

    def gaps() -> DataFrame:
        """Words of each source that are still open."""
        used = state.where("_taken").groupBy("_key").agg(F.sum("size").alias("_used"))
        return saved(
            budgets.join(used, "_key", "left").select(
                "_key", "_target", (F.col("_budget") - F.coalesce("_used", F.lit(0))).alias("_gap")
            ),
            "open-words",
        )

    def take(gap: DataFrame, turn: Column, also: Column | None = None) -> DataFrame:
        """``state`` after the documents whose turn it is were taken in rank order."""
        seen = state.join(by_source(gap), "_key", "left")
        turn = F.coalesce(turn & ~F.col("_taken") & (F.col("size") <= F.col("_gap")), F.lit(False))
        active = seen.where(turn)
        earlier = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = active.groupBy("_key", "_bucket").agg(F.sum("size").alias("_sum"))
        sums = sums.select("_key", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
        inside = W.partitionBy("_key", "_bucket").orderBy("_rank", "doc_id", "size", "_nr")
        end = F.col("_before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))
        placed = active.join(sums, ["_key", "_bucket"]).withColumn("_end", end)
        fits = F.col("_end") <= F.col("_gap")
        placed = placed.withColumn("_taken", fits if also is None else fits & also)
        return saved(placed.select(*kept).union(seen.where(~turn).select(*kept)), "mixing")

    long = F.col("size") > F.col("_budget") * LONG
    short = F.sum(F.when(long, 0).otherwise(F.col("size")))
    needed = (
        state.join(by_source(budgets), "_key").groupBy("_key")
        .agg(F.first("_budget").alias("_gap"), (F.first("_budget") - short).alias("_need"))
    )
    chosen = (F.col("_u") <= F.col("_p")) | (F.col("_end") - F.col("size") < F.col("_need"))
    state = take(saved(needed, "needs"), F.col("size") > F.col("_gap") * LONG, chosen)
    state = take(gaps(), F.lit(True))
    while True:  # each pass takes a document of every source that has one that fits
        gap = gaps()
        far = gap.where(F.col("_gap") > F.col("_target") * NEAR)
        fitting = state.where("not _taken").join(by_source(far), "_key").where("size <= _gap")
        if fitting.isEmpty():
            break
        state = take(far, F.lit(True))
    off = F.abs(F.col("size") - F.col("_gap"))
    last = (
        state.where("not _taken")
        .join(by_source(gap), "_key")
        .where(off < F.col("_gap"))
        .groupBy("_key")
        .agg(F.min(F.struct(off.alias("off"), "_rank", "doc_id", "_nr"))["_nr"].alias("_last"))
    )
    taken = F.col("_taken") | F.coalesce(F.col("_nr") == F.col("_last"), F.lit(False))
    drawn = state.join(by_source(last), "_key", "left").withColumn("_more", F.when(taken, 1).otherwise(0))
    rest = rows.where("_p = 0").withColumn("_more", F.lit(0))
    return (
        drawn.select(*columns, "_more")
        .union(rest.select(*columns, "_more"))
        .withColumn("copies", (F.col("_whole") + F.col("_more")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies")
    )


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of every document, written once."""
    return saved(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
