"""SparkSession construction and cluster-level settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every tidepanel job relies on. AQE re-plans joins/partition counts from
# runtime sizes and splits skewed shuffle partitions; the session time zone is pinned
# so event-time windows are deterministic.
DEFAULT_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tidepanel", extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with tidepanel's defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared, fault-tolerant folder and is always
    respected. Only when it is unset in a local session (tests) a scratch folder is
    created; executors of a cluster could not see one, so there it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tidepanel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written intermediate table."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidepanel`` importable in Python workers (pandas UDFs, ``applyInPandas``).

    The package is zipped on the driver once per SparkContext and distributed with
    ``addPyFile`` (Spark's own file distribution, so it reaches every executor).
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zdir = tempfile.mkdtemp(prefix="tidepanel-pkg-")
    zpath = os.path.join(zdir, "tidepanel.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for fn in files:
                if fn.endswith(".py"):
                    full = os.path.join(base, fn)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def committed(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a fully committed Spark write (its ``_SUCCESS`` marker).

    Works for any file system Spark can read; a partially written folder left by a
    lost job is not mistaken for a finished table.
    """
    return path_exists(spark, path.rstrip("/") + "/_SUCCESS")


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on any file system Spark can read."""
    fs, p = _file_system(spark, path)
    return bool(fs.exists(p))


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that its step has written and no longer needs."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def path_signature(spark: SparkSession, path: str) -> str:
    """Length, file count and change time of a file or folder."""
    fs, p = _file_system(spark, path)
    s = fs.getContentSummary(p)
    return f"{s.getLength()}:{s.getFileCount()}:{fs.getFileStatus(p).getModificationTime()}"


def materialize(df, name: str):
    """Write ``df`` once as parquet in the shared checkpoint folder and read it back.

    Used for engineered frames that several passes read (the survey's "engineered
    frame once per cell"): later passes scan only the columns they need, lineage is
    cut, and a lost executor costs a re-read instead of a recomputation.
    """
    import uuid

    spark = df.sparkSession
    path = checkpoint_path(spark, f"{name}_{uuid.uuid4().hex[:10]}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` into the shared checkpoint folder (ensured first).

    Reliable checkpoints survive executor loss; local checkpoints are never used.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def size_shuffles(spark: SparkSession, input_bytes: int, target_bytes: int = 256 << 20) -> int:
    """Size shuffle and scan partitions for an input of ``input_bytes``.

    Initial shuffle partitions ~ input / target (at least twice the cores), so that no
    partition has to spill at 100 TB; AQE then coalesces small ones toward the
    advisory size and splits skewed ones. Returns the partition count set.
    """
    cores = max(1, spark.sparkContext.defaultParallelism)
    n = max(2 * cores, -(-int(input_bytes) // int(target_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes // 2))
    return n
