"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package assumes.  Shuffle partitions are only a
# default for local runs; on a cluster the caller sizes them to the data.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "shiftspark", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _local_base(spark: SparkSession) -> str:
    """A temporary folder, only where driver and executors are one process."""
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="shiftspark-")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def remove_scratch(spark: SparkSession, path: str) -> bool:
    """Delete a folder that ``scratch_dir`` named, once nothing reads it any more;
    other paths are left alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base or not path.startswith(base.rstrip("/") + "/"):
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    The location comes from ``spark.checkpoint.dir`` (or the context's
    checkpoint dir).  Only when neither is set -- local tests -- a temporary
    folder is created and registered as the checkpoint dir, so later
    ``DataFrame.checkpoint()`` calls use the same place.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        base = _local_base(spark)
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    base = base.rstrip("/")
    return f"{base}/{name or 'work'}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``DataFrame.checkpoint()`` has a reliable location."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _local_base(spark)
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the shared scratch folder
    and reading it back.  Unlike ``checkpoint()``, later plans then see the
    table's real (file) size, so Spark's own size check can broadcast it when
    it is small and shuffle it otherwise."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application, so that
    Python functions in tasks can import it wherever the driver was started.
    The archive is read by the driver only; Spark's file server hands it out."""
    sc = spark.sparkContext
    if getattr(sc, "_shiftspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="shiftspark-pkg-"), "shiftspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("shiftspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._shiftspark_shipped = True
