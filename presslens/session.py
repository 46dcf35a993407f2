"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

# Settings that matter at scale. They are only applied when the session is
# built here; on a cluster the submitter's values win (getOrCreate keeps them).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a file split of 128 MiB keeps scan tasks well inside executor memory
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.showConsoleProgress": "false",
    # RDD checkpoints only; stages written by materialize() are expired by application
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "presslens") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_session(cores: int = 8, driver_memory: str = "8g") -> SparkSession:
    """Session for tests and local benchmarks (local mode: the driver JVM
    is the executor, so its heap is the only memory setting)."""
    SparkSession.builder.config("spark.driver.memory", driver_memory)
    return get_session(master=f"local[{cores}]", shuffle_partitions=cores)


_LOCAL_CHECKPOINTS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the submitter sets it to shared storage. Only when it is
    unset (local tests) one scratch folder per application is created and
    registered.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = sc.applicationId
    if app not in _LOCAL_CHECKPOINTS:
        _LOCAL_CHECKPOINTS[app] = tempfile.mkdtemp(prefix="presslens-ckpt-")
        sc.setCheckpointDir(_LOCAL_CHECKPOINTS[app])
    return _LOCAL_CHECKPOINTS[app]


def stage_path(spark: SparkSession) -> str:
    """A new place for a stage: below the checkpoint folder, under the
    application's id, so that a finished application's stages can be expired
    together (a stage must outlive the plans that read it)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/presslens-stage/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df):
    """Cut lineage between pipeline stages: write ``df`` as a Parquet table
    in the shared checkpoint folder and continue from the written copy
    (columnar, so later stages prune columns and push filters into it).
    Stands in for reading a stored catalog layer; survives executor loss."""
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark resolves it to: one without scheme
    lies on the default file system, not on the local disk."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a qualified path, and the path in it, for tasks that read or write files themselves."""
    scheme, _, rest = uri.partition(":")
    if not rest.startswith("/"):
        raise ValueError(f"{uri} has no scheme: use session.qualified()")
    return fs.FileSystem.from_uri(f"file://{rest}" if scheme == "file" and not rest.startswith("//") else uri)
