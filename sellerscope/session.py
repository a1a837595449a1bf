"""Session helpers.

Library functions never change the caller's session configuration.  These
helpers are for entry points (bench, tests, command line) that own the session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings an entry point should use on a cluster.  AQE re-plans joins at run
# time from real sizes (broadcast only below autoBroadcastJoinThreshold, i.e. a
# size-checked broadcast), coalesces small shuffle partitions and splits skewed
# ones.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sellerscope", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in CLUSTER_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: What a query has shuffled is removed when it ends; else it stays until the driver happens to collect its garbage.
CLEAN_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def own_session(spark: SparkSession, extra: dict | None = None) -> SparkSession:
    """Another session of the application with the caller's settings, ``CLEAN_CONF`` and ``extra``; the caller's stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in {**CLEAN_CONF, **(extra or {})}.items():
        own.conf.set(key, value)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint directory.

    On a cluster the directory comes from ``spark.checkpoint.dir`` (a shared
    file system).  Only a local session without that setting gets a fresh
    scratch folder; on a cluster executors would not see one, so it raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="sellerscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir
