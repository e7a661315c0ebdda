"""Session helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "docmill", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    A file of one row group is read by one task; work that takes far longer than reading is spread by a
    shuffle of the few rows there are. Inputs of enough partitions, as large ones are, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def few_tasks(df: DataFrame, per_core: int = 4) -> DataFrame:
    """df in at most so many partitions a core, without a shuffle.

    For passes of which every task gives a table of fixed size: what they give together then grows with the
    cluster, not with the input.
    """
    most = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df


#: Where spark.checkpoint.dir is to be set, and folders to delete when this process ends.
SETTING = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master may leave it unset: there a temporary folder is made, filled in and deleted at the
    end. On a cluster a folder of one machine would lose data with it, so the setting is required.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="docmill-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is deleted by release(), or when the process ends."""
    path = f"{shared_dir(spark)}/docmill/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return path


def release(spark: SparkSession | None = None) -> None:
    """Delete what materialize() and scratch() wrote, for one session or for all. Results that were built on it
    must have been written or collected before."""
    for entry in [e for e in _written if spark is None or e[0] is spark]:
        _written.remove(entry)
        try:
            path = entry[0]._jvm.org.apache.hadoop.fs.Path(entry[1])
            path.getFileSystem(entry[0]._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  (the session is gone; its folder is the cluster's to clean)
            continue


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and survives lost executors.

    This runs a job at once, while the result is being built."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def package_root() -> str:
    return os.path.dirname(os.path.abspath(__file__))
