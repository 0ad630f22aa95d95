"""Session settings, lineage cuts and size checks shared by the operators."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows one side of a join may have before it is no longer broadcast.
BROADCAST_ROWS = 20_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """Session used by the tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skyquill")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.compress", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="skyquill-checkpoint-")  # one machine
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place for tables and stream checkpoints in the folder the cluster names in ``spark.checkpoint.dir``."""
    return f"{_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Partitions and the order of rows in them are fixed afterwards, which the
    ordered scans rely on, and a lost executor costs a re-read, not a recompute.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpointed_with_count(df: DataFrame) -> tuple[DataFrame, int]:
    """As ``checkpointed``, with the number of rows, counted on the way."""
    seen = Observation()
    stored = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return stored, seen.get["n"]


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows; reads no further than needed."""
    return df.limit(rows + 1).count() <= rows


def _optimized(df: DataFrame):
    try:
        return df._jdf.queryExecution().optimizedPlan()
    except AttributeError:  # remote sessions do not show their plans
        return None


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate. It only chooses between plans that are all exact."""
    plan = _optimized(df)
    return None if plan is None else int(str(plan.stats().sizeInBytes()))


def is_plain_scan(df: DataFrame) -> bool:
    """True when reading the input again costs a scan and nothing more."""
    plan = _optimized(df)
    if plan is None:
        return False
    nodes = {line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in plan.toString().splitlines() if line.strip()}
    return nodes <= {"Project", "Filter", "Relation", "LogicalRDD"}


def spread(df: DataFrame, small: int = 256 << 20) -> DataFrame:
    """Deal a small input, which may come in a single split, over all cores. Large inputs have splits enough."""
    size = estimated_bytes(df)
    if size is None or size > small:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
