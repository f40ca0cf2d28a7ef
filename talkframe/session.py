"""Session settings and durable cut points."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is written for. A cluster's own settings win."""
    builder = (
        SparkSession.builder.appName("talkframe")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_fallback: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints.

    Only a local session, whose driver and tasks share one machine, may leave it unset.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="talkframe-"))
    return _fallback[0]


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for a stream's checkpoint or a handed-over table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage, so that later steps read it instead of redoing it.

    Used between ordered scans: each scan reads its input twice, and without a cut the
    number of readings would double with every further scan.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def widen(df: DataFrame) -> DataFrame:
    """Spread an input that comes in fewer splits than there are cores, before costly work on its rows.

    Large inputs have more splits than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def runs_in_tasks(module_name: str) -> None:
    """Send a module's functions to tasks by value, so that workers need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
