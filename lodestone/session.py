"""Session helpers: local defaults, the shared checkpoint folder, bounded reads."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ceiling for anything collected to the driver and broadcast to executors.
BROADCAST_BYTES = 64 * 1024 * 1024
CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "lodestone", **extra) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Tasks already fill the cores; their matrix products use one each.
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        # A few large row groups would otherwise run on a single core.
        .config("spark.sql.files.maxPartitionBytes", str(2 * 1024 * 1024))
        .config("spark.sql.files.openCostInBytes", str(256 * 1024))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoints(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` usable and return the folder it writes to.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="lodestone-checkpoints-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def fits_broadcast(frame: DataFrame, size_of_row, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the summed row sizes of ``frame`` stay within ``limit`` bytes."""
    total = frame.agg(F.coalesce(F.sum(size_of_row), F.lit(0)).alias("bytes")).first()["bytes"]
    return total <= limit
