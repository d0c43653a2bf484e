"""The registered queries of this subpackage over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_pareto_mix": oracles.MIX,
    "op3_cover_tree": oracles.COVER,
    "op4_suffix_dedup": oracles.SUFFIXES,
    "op5_jaccard_join": oracles.JACCARD,
    "op7_fm_index_dedup": oracles.WINDOWS,
    "op11_quartile_digest": oracles.QUARTILES,
    "op12_segment_negatives": oracles.NEGATIVES,
    "op13_fill_middle": oracles.FILL_MIDDLE,
}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every text and the verdict of the learned list."""
    from .quality import judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = judge(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return out.select(
        "doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", "base_failed", "kept"
    )


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections of every text."""
    from .licenses import digest, scan

    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    from .mixing import measured, mix

    mixed = mix(measured(table(spark, sf_dir, "documents")))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def tokenizer_file() -> str:
    """Where the public tokenizer file lies on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token records of every document, written to files and read back from them."""
    from .records import read, write

    return read(write(table(spark, sf_dir, "documents"), tokenizer_file(), end=2))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids of every document, packed into sequences."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), end=0, capacity=2048)


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, 3-word shingles, similarity 0.9."""
    from .jaccard import join

    members, _ = join(table(spark, sf_dir, "documents"), k=3, percent=90)
    return members.select("doc_id", "n_shingles", "component_id")


@query
def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.9 or more and components of all vectors."""
    from .cover import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.expr("id <=> component_id").alias("kept")
    )


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text; a fifth of the labels is held out."""
    from .toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without the 100-byte strings it repeats."""
    from .suffixes import digest, removed

    return digest(removed(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100))


@query
def op7_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without the 35-word windows that occur again."""
    from .fm_index import digest, removed

    return digest(removed(table(spark, sf_dir, "documents").select("doc_id", "text"), length=35))


@query
def op11_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited one, and their likeness."""
    from .quartiles import beside_next

    return beside_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; some labels are shifted first."""
    from .segments import hard_negatives

    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), shifted.alias("label"), F.col("embedding").alias("vector")
    )
    return hard_negatives(vectors, F.col("id") % 100 == 0)


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its middle moved to the end, and the text rebuilt from it."""
    from .fill_middle import digest, transformed

    return digest(transformed(table(spark, sf_dir, "documents").select("doc_id", "text")))
