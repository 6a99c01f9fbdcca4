"""Spark session and cluster-facing settings.

Everything that decides how work is spread over a cluster lives here, so the
operators themselves stay plain DataFrame code.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. ANSI mode stays on (Spark 4 default): the
# operators use try_divide wherever the reference divides by a possible zero.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "panelforge") -> SparkSession:
    """Session for tests and the bench: local mode, no web UI."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cores)
    half = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 31
    conf["spark.driver.memory"] = f"{max(2, min(16, half))}g"     # of the machine's memory, at most half
    # Window stages are CPU-bound per row: on small local inputs, do not let
    # AQE fold the shuffle output into one or two partitions (1 MB default).
    conf["spark.sql.adaptive.coalescePartitions.minPartitionSize"] = "64k"
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_conf(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on (time zone) on any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3...)
    and is used as is. Only a local session without one (tests) gets a fresh
    scratch folder; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="panelforge-ckpt-",
                             dir=os.environ.get("PANELFORGE_SCRATCH", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)
