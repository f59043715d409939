"""Spark session defaults shared by tests, bench and the library.

Everything here is a configuration a Spark user would set for this workload:
UTC session zone (every timestamp in the lake is UTC by convention), ANSI on
(Spark 4 default, makes overflow raise instead of wrapping), AQE with skew
handling, ZSTD Parquet. Nothing is started besides the session itself; the UI
stays off.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every session of this package needs for correct results.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    # Parquet timestamps written without zone adjustment come back as TIMESTAMP_NTZ.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}

# Settings tuned for scale; safe defaults on any cluster.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Dimensions and hourly aggregates are broadcast only while the runtime size
    # is below this bound; above it AQE keeps the sort-merge join.
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    # A reliable checkpoint is deleted once nothing refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Settings for a cluster run (not used for local tests, which pass a small
# shuffle-partition count): start shuffles wide and let AQE coalesce them to
# ~128 MB, since AQE can merge partitions but never split ordinary ones.
CLUSTER_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "fleetpulse",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or create) a SparkSession configured for this package."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions is None:
        conf.update(CLUSTER_CONF)
    conf.update(REQUIRED_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_required(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_required(spark: SparkSession) -> None:
    """Pin the settings results depend on (safe on an existing session)."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)


def session_key(spark: SparkSession) -> str:
    """A stable id for memo tables."""
    return f"{spark.sparkContext.applicationId}:{id(spark)}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one (as in tests) gets a scratch folder, removed at exit; a cluster session without
    one is an error, since a folder of one machine would be missing on the others.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fleetpulse-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured
