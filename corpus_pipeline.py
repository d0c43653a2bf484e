"""A training corpus from ``documents``: filter, deduplicate, trim, mix, pack.

Each stage takes all that its predecessor kept, as a table, and returns the columns
of ``documents``; the last returns packed pieces. Stages are written as Parquet in
the folder of ``spark.checkpoint.dir`` and read again, so a lost executor never
costs more than the stage it was part of. A stage is called once its predecessor's
result is written, and deletes the tables that the predecessor made on the way;
shuffle files go with the job they belong to.

Defined cases, beyond those of the operators: rows with a null doc_id pass the
deduplicating stages as they are; texts that share a doc_id are documents of their
own there; in the mix, rows that share a doc_id are taken equally often.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, mixing, packing, quality, suffixes
from lodestone.llm.common import delete, delete_all, narrowed, new_path, restored, saved, sent_if_small, written
from lodestone.llm.queries import table, tokenizer_file

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
REPEATED_BYTES = 100
SOURCE_WEIGHTS = (5, 2, 1)
SEQUENCE_TOKENS, END_ID = 2048, 0
#: A row number in a table that is sent to all tasks.
DROPPED_BYTES = 16
#: Removes the shuffle files of every job once it has ended.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list."""
    judged, _ = quality.judge(narrowed(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return restored(judged.where("kept"), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies.

    Where rows share a doc_id, they get a number, written once with them, that tells
    them apart; else the doc_id does.
    """
    rows = narrowed(docs, "doc_id", "text")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        rows = rows.withColumn("row", F.col("doc_id").cast("long"))
    else:
        rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    numbered = rows.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text")
    found, _ = jaccard.join(numbered, SHINGLE_WORDS, SIMILARITY_PERCENT)
    members = saved(found.select(F.col("doc_id").alias("row"), "component_id"), "members")
    shared = members.where("row <> component_id").select("component_id").distinct()
    grouped = members.join(shared, "component_id").join(rows.select("row", "doc_id"), "row")
    firsts = grouped.groupBy("component_id").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    dropped = saved(grouped.select("row").join(firsts.select("row"), "row", "left_anti"), "dropped")
    return restored(rows.join(sent_if_small(dropped, DROPPED_BYTES), "row", "left_anti"), docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that repeat an earlier text; lengths follow."""
    cut = suffixes.removed(docs, REPEATED_BYTES)
    kept = suffixes.kept_text(F.col("text"), F.col("starts"), F.col("ends"))
    out = restored(cut.withColumn("text", kept), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pareto_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mixing.mix(mixing.measured(docs), SOURCE_WEIGHTS)
    often = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").cast("int").alias("_copies"))
    each = narrowed(docs, "doc_id")
    taken = each.join(often.where("_copies > 0"), each["doc_id"].eqNullSafe(F.col("_id")))
    copied = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return restored(copied.select("doc_id", "rest"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, packed into sequences."""
    return packing.pack_documents(docs, tokenizer_file(), END_ID, SEQUENCE_TOKENS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last call of a stage made on the way to its result.
_made: dict[str, list[str]] = {}


def _staged(*builds: Stage) -> list[tuple[str, Stage]]:
    """Stages that clean up after their predecessors."""

    def of(build: Stage, before: str | None) -> Stage:
        @wraps(build)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            spark.conf.set(CLEANUP_KEY, "true")
            # A cached predecessor may not have read its tables yet.
            if before in _made and not docs.is_cached:
                delete_all(spark, _made.pop(before))
            with written() as _made[build.__name__]:
                return build(spark, docs, sf_dir)

        return stage

    names = [None, *(b.__name__ for b in builds)]
    return [(b.__name__, of(b, before)) for b, before in zip(builds, names)]


STAGES = _staged(quality_rules, ngram_jaccard_join, suffix_array_dedup, pareto_mix, best_fit_packing)

#: The learned list and the tokenizer have no SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    cleanup = spark.conf.get(CLEANUP_KEY, "false")
    try:
        for name, stage in STAGES:
            path = new_path(spark, f"stage-{name}")
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            if last is not None:
                delete(spark, last)
            last = path
        delete_all(spark, _made.pop(name))
    finally:
        spark.conf.set(CLEANUP_KEY, cleanup)
    return docs
