"""A folder of documents worked off bit by bit, resumable from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.ingest import run_state


def run_backlog(spark: SparkSession, schema: str, source: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], keys: list[str], files_per_batch: int = 100) -> int:
    """Process the files of a Parquet folder that the checkpoint has not seen; returns the rows in target.

    Each micro-batch is deduplicated by keys and stripped of the keys that other batches have written, so
    that a key that comes again in a later one is not written twice. It is written under its own batch folder,
    which a second run of the batch overwrites. work() must keep the key columns.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def batch(df: DataFrame, no: int) -> None:
        rows = df.dropDuplicates(keys)
        known = _written(spark, target, no)
        if known is not None:
            rows = rows.join(known.select(*keys), keys, "left_anti")
        work(rows).withColumn("batch_no", F.lit(no)).write.mode("overwrite").parquet(f"{target}/batch={no}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = _written(spark, target, -1)
    return 0 if done is None else done.count()


def _written(spark: SparkSession, target: str, but: int) -> DataFrame | None:
    """The rows of all finished batches but one, or None if there are none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(target)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    found = [x.getPath() for x in fs.listStatus(folder)]
    paths = [p.toString() for p in found if p.getName().startswith("batch=") and p.getName() != f"batch={but}" and fs.exists(hadoop.Path(p, "_SUCCESS"))]
    return spark.read.parquet(*paths) if paths else None


def status(state: DataFrame) -> DataFrame:
    """One row about a job from its items (name, status): total, counts by status, remaining and what failed."""
    return run_state(state)
