"""Shared pieces of the operators: tables in the shared folder, ids, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Tables up to this size may be sent to all tasks.
BROADCAST_BYTES = 64 << 20
_written: list[str] = []
# Words of the contracts: runs of anything but these six characters. Java looks
# single Latin characters up in a bit table, but tests ranges one by one.
WHITE = r"[ \t\n\x0B\f\r]++"
WORD = r"[^ \t\n\x0B\f\r]++"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-machine session without that setting gets a folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="lodestone-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lodestone-{name}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    It cuts the lineage: what follows survives lost executors without repeating
    the work behind the table.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    _written.append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def written() -> Iterator[list[str]]:
    """Paths of the tables that ``saved`` writes meanwhile.

    Once all that is made of them is written too, they can be deleted.
    """
    begin, paths = len(_written), []
    try:
        yield paths
    finally:
        paths += _written[begin:]
        del _written[begin:]


def delete_all(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        delete(spark, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows at a time go to Python in jobs that are run meanwhile."""
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def sent_if_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table``, which must be cheap to count, marked to be sent to all tasks where its
    rows fit the bound, else to be shuffled."""
    small = table.count() * row_bytes <= BROADCAST_BYTES
    return F.broadcast(table) if small else table.hint("shuffle_hash")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def narrowed(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` as the needed columns and one struct ``rest`` of all others.

    Operators add columns of their own; inside the struct no name can clash.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*others or [F.lit(0).alias("none")]).alias("rest"))


def restored(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order, from a frame that ``narrowed`` began."""
    inside = set(frame.schema["rest"].dataType.names)
    return frame.select(*[F.col(f"rest.`{c}`").alias(c) if c in inside else F.col(f"`{c}`") for c in docs.columns])


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(id, component_id)`` of every node of ``edges``: the smallest id it reaches.

    Each round, every node takes the smallest label among its own and its
    neighbours' (summed up per task before the shuffle, so a node with very many
    links is one row per task) and then the label of that label, which halves the
    length of chains. Rounds end when no label changes.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x <> y")
    both = saved(
        pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(),
        "links",
    )
    labels = saved(
        both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("l")),
        "labels",
    )
    while True:
        offered = (
            both.join(labels, both.y == labels.id)
            .select(F.col("x").alias("id"), "l")
            .union(labels.select("id", "l"))
            .groupBy("id")
            .agg(F.min("l").alias("n"))
        )
        jumped = labels.select(F.col("id").alias("n"), F.col("l").alias("far"))
        step = saved(
            offered.join(jumped, "n", "left")
            .join(labels, "id")
            .select("id", F.least("n", "far").alias("new"), "l"),
            "labels",
        )
        changed = step.where("new <> l").limit(1).count()
        labels = step.select("id", F.col("new").alias("l"))
        if not changed:
            return spark.createDataFrame([], "id long, component_id long").union(
                labels.select("id", F.col("l").alias("component_id"))
            )
