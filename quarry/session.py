"""Session helpers: time zone, checkpoint directory, local test sessions."""
from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


def ensure_utc(spark: SparkSession) -> None:
    """All time arithmetic in this package assumes a UTC session clock."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints and intermediate tables.

    The context's own folder wins; else the one named by spark.checkpoint.dir.
    With neither, a local master gets one scratch folder for the life of the
    context; any other master is an error, because a machine-local folder
    would not be visible to the other machines.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, scheme included."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """`scratch_uri` as a plain path where the folder is on a file system."""
    uri = scratch_uri(spark, name)
    return "/" + uri[len("file:"):].lstrip("/") if uri.startswith("file:") else uri


def freeze(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts the
    lineage, keeps columns prunable and survives lost executors."""
    path = scratch_uri(df.sparkSession, name)
    for made in _SCOPES:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Lists of open `staged_paths` scopes.
_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def staged_paths() -> Iterator[list[str]]:
    """The paths of all tables that `stage` writes inside the block, in order."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop(next(i for i, s in enumerate(_SCOPES) if s is made))


def remove_staged(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = hadoop(p)
        path.getFileSystem(conf).delete(path, True)


def tune_for_scale(spark: SparkSession, shuffle_partitions: int | None = None,
                   max_partition_bytes: str = "256m") -> None:
    """Runtime settings for large inputs: AQE re-plans joins and partition
    counts from observed sizes, splits skewed shuffle partitions, and
    broadcasts a join side only when its measured size is under the
    threshold.  Call once per session on a cluster."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.files.maxPartitionBytes": max_partition_bytes,
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        spark.conf.set(k, v)


def local_session(cores: int = 8, partitions: int = 8, app: str = "quarry") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark
