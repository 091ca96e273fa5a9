"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settings for a large cluster (about 100 TB of input, ~1000 executors): many initial shuffle
# partitions that AQE coalesces to ~256 MB each, scan splits of 256 MB, skewed partitions
# split when 5x the median, and hand broadcasts still bounded by plans/sizing.py.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, app: str = "bankspark", shuffle_partitions: int | None = None,
                conf: dict | None = None, profile: str = "local") -> SparkSession:
    """A session with AQE (coalescing, skew join) on and the UI off; ``profile='cluster'`` adds CLUSTER_CONF."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if profile == "cluster":
        settings.update(CLUSTER_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only when it is unset (tests) a local folder is made."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="bankspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def keep(df: DataFrame) -> DataFrame:
    """Cache an intermediate that several jobs of one operator read (MEMORY_AND_DISK).

    Lost or evicted blocks are recomputed from lineage. Spark's cache manager shares one
    copy among identical plans, so repeated calls reuse it instead of stacking copies.
    """
    from pyspark import StorageLevel

    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(kept)
    return kept


_KEPT: list[DataFrame] = []


def release_kept(spark: SparkSession) -> None:
    """Drop the cached intermediates of ``keep`` in this session. Frames built on them stay right: they recompute."""
    for df in [d for d in _KEPT if d.sparkSession is spark]:
        df.unpersist()
    _KEPT[:] = [d for d in _KEPT if d.sparkSession is not spark]
