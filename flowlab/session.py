"""SparkSession helpers shared by tests, bench and pipelines."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "flowlab") -> SparkSession:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FLOWLAB_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the cluster
    (``spark.checkpoint.dir``).  Only when nothing is configured (local
    tests) a scratch folder is created and registered."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="flowlab-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the session's folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it is done, not when the
    driver happens to collect garbage: for tables written by a shuffle of all
    rows, by queries that are run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Parallelism floor for expensive row-wise stages (Python forward
    passes): when the input arrives in fewer partitions than the cluster has
    cores (e.g. one large row group), spread it round-robin first.  On large
    inputs -- thousands of splits -- this is a no-op."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.isStreaming:
        return df.repartition(cores)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


BROADCAST_MAX_BYTES = 32 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES, known_rows: int | None = None) -> DataFrame:
    """Broadcast a derived lookup table only when its size is bounded: its
    rows are measured (as JSON text, all columns) and tables over
    ``max_bytes`` are left to a shuffle join.  A caller that already knows an
    upper bound of narrow rows passes ``known_rows``."""
    from pyspark.sql import functions as F
    if known_rows is not None:
        return F.broadcast(df) if known_rows * 16 * len(df.columns) <= max_bytes else df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
