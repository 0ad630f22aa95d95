"""Streams run to the end of what is there, into tables that a restart neither doubles nor cuts short."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Seconds to wait for a stream to reach its end.
PATIENCE = 3600
_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
_BY_FILE_SYSTEM = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


@contextmanager
def _with_conf(spark: SparkSession, conf: dict[str, str | int]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _log_conf(spark: SparkSession, checkpoint: str) -> dict[str, str]:
    """How a stream writes its logs, several files a batch: on local disks the default way took 28 ms a file, the file
    system 8 ms. A way the session chose stays, and other stores keep the default."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    local = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    return {_MANAGER: _BY_FILE_SYSTEM} if local and spark.conf.get(_MANAGER, None) is None else {}


def _run(spark: SparkSession, writer, checkpoint: str, conf: dict[str, str | int] | None = None) -> None:
    with _with_conf(spark, _log_conf(spark, checkpoint) | (conf or {})):
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if not query.awaitTermination(PATIENCE):
            query.stop()
            raise TimeoutError("the stream did not reach its end")


def drained(stream: DataFrame, path: str, checkpoint: str, state_partitions: int | None = None) -> DataFrame:
    """Everything the stream emits, appended to Parquet in ``path``. The sink's log makes each batch count once.

    Every batch commits the state of every partition, so small batches over few keys want few (``state_partitions``,
    by default the session's shuffle partitions); a stream keeps the number it began with.
    """
    few = {"spark.sql.shuffle.partitions": state_partitions} if state_partitions else None
    _run(stream.sparkSession, stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, few)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drained_by_batch(stream: DataFrame, path: str, checkpoint: str, name: str = "batch") -> DataFrame:
    """As ``drained`` with the number of the micro-batch of every row; a batch that runs again overwrites its own."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{name}={number}")

    _run(stream.sparkSession, stream.writeStream.foreachBatch(keep), checkpoint)
    return stream.sparkSession.read.parquet(path)
