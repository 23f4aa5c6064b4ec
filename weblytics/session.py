"""SparkSession settings the jobs rely on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the results depend on.  They are applied to whatever
# session the caller hands in (``configure``), so a cluster session built
# elsewhere computes the same results as the local one built by ``get_spark``.
SQL_SETTINGS = {
    # visit hours and day boundaries are UTC, like the source timestamps
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # runtime re-planning (joins whose measured side is small become
    # broadcast joins, skewed partitions are split)
    "spark.sql.adaptive.enabled": "true",
    # shard suffixes such as 20240115 must stay strings (lexicographic BETWEEN)
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # re-publishing one prediction date replaces only that date
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Tuning defaults of the sessions built here; a caller's own session keeps
# its own choices for these.
TUNING_DEFAULTS = {
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "weblytics", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.  On a cluster, pass ``master=None`` and let
    spark-submit decide; locally ``local[N]`` with partitions sized to cores."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    # checkpoint files of training data are removed once no plan refers to them
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**TUNING_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return configure(spark)


#: private folders of local applications that name no shared one
_PRIVATE: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for materialised tables and stored models.

    It is the cluster's ``spark.checkpoint.dir``.  A local session without one
    gets a private temporary folder; on a cluster that is an error, because
    executors would not see the driver's own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not path and sc is not None:
        path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # a running session cannot take that setting: the folder is remembered here
        app = app_id(spark)
        if app not in _PRIVATE:
            _PRIVATE[app] = tempfile.mkdtemp(prefix="weblytics-ckpt-")
        path = _PRIVATE[app]
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _context(spark: SparkSession):
    """The SparkContext, or None for a remote (Connect) session."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (changes with a new context)."""
    sc = _context(spark)
    return sc.applicationId if sc is not None else f"session-{id(spark)}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of ``path``: local, HDFS or object store."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = file_system(spark, path)
    return bool(fs.exists(jpath))


def file_stamp(spark: SparkSession, path: str) -> str:
    """``name:size:modification-time`` of every file of a file or folder; an
    unreadable path is an error."""
    fs, jpath = file_system(spark, path)
    if not fs.getFileStatus(jpath).isDirectory():
        found = [fs.getFileStatus(jpath)]
    else:
        found, files = [], fs.listFiles(jpath, True)
        while files.hasNext():
            found.append(files.next())
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of the sub-folders of ``folder`` (empty if it does not exist)."""
    fs, jpath = file_system(spark, folder)
    if not fs.exists(jpath):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(jpath) if f.isDirectory())


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: its lineage
    ends there and plans that use it know its real size."""
    path = f"{work_dir(df.sparkSession)}/weblytics/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cluster_settings(input_bytes: int, total_cores: int,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the bytes a job reads.

    * scan splits of ``target_partition_bytes`` (``maxPartitionBytes``);
    * shuffle partitions = enough for ~``target_partition_bytes`` per reducer
      before adaptive coalescing, and at least 3 waves of all cores, so one
      reducer never has to hold more than it can sort in memory; adaptive
      execution then merges small ones toward the advisory size;
    * skewed partitions (5x the median and > 1 GiB) are split at join time.
    These are passed to ``get_spark(extra=...)`` or spark-submit ``--conf``."""
    partitions = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.parquet.aggregatePushdown": "true",
    }


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python (as ``--py-files``
    would), once per application.  Nothing to do where PYTHONPATH has it."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    there = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = app_id(spark)
    if root in there or app in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="weblytics-"), "weblytics.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
