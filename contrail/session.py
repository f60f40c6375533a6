"""Session helpers: the few settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# The one setting results depend on: zone-less timestamp text is UTC and
# NTZ<->LTZ casts must not shift, so the session zone is pinned to UTC.
REQUIRED_CONF = {"spark.sql.session.timeZone": "UTC"}

# Settings of a session that we build ourselves. Adaptive execution and its
# skew-join splitting are Spark's defaults; the last one is static (PySpark
# otherwise records the Python call site of every Column call) and so can
# only be given to the builder, never to a session made elsewhere.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need to any session
    (idempotent; static settings are left as the session has them)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v and spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    return spark


def local_session(app: str = "contrail", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CONTRAIL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**REQUIRED_CONF, **LOCAL_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediates, from ``spark.checkpoint.dir`` (or
    the context's checkpoint folder). Only a local master may fall back to a
    temporary folder of this machine: there driver and executors are one
    process. On a cluster an unset folder is an error, because executors
    would write to disks that nobody else can read."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="contrail-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base.rstrip("/")


_SCRATCH: dict[str, str] = {}  # application id -> this session's scratch folder


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in this application's scratch folder, which lies under the
    shared checkpoint folder and is removed when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        path = f"{checkpoint_root(spark)}/scratch-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _SCRATCH[app] = path
    return f"{_SCRATCH[app]}/{purpose}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder
    (never a local checkpoint): used when an expensive derived table feeds
    several branches of one plan."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)
