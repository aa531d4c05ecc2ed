"""Session set-up, table access and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches. A cluster passes its own session to every operator instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` under the folder `root`; a file or a folder of files."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Without that setting a session on one machine gets a temporary folder of its own, and any other is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="docweave-shared-")
    return _LOCAL[app]


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    A written table survives the loss of executors, holds columns that later steps may prune, and is
    compressed. It is removed by `release`, or when the driver's JVM ends, also after the session was stopped.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, target = _file_system(spark, path)
    fs.deleteOnExit(target)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove every table `staged` wrote for this session. Frames that still read them become unusable."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        fs, target = _file_system(spark, path)
        fs.delete(target, True)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table whose size is bounded by contract, brought to the driver.

    Reads one row more than allowed and raises rather than truncating when the bound is broken.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} holds more than {most} rows; it cannot be used as a driver-side table")
    return rows


def broadcast_if_bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """`df` with a broadcast hint when it has at most `most` rows, else `df` as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
