"""Written tables in the cluster's shared folder, and broadcasts behind a check of size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows may go to the driver, some 10 MB.
BROADCAST_ROWS = 100_000

_local_dir: str | None = None
_to_clean: set[str] = set()


def _clean(spark: SparkSession, path: str) -> None:
    """Delete a folder while the driver's JVM still runs; lazily read results need it until then."""
    try:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001  the application is over: its JVM may have gone first
        return


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session (tests, notebooks) gets a temporary folder that goes with the
    process; on a cluster that is an error, as executors share no local folder.
    """
    global _local_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        path = f"{base.rstrip('/')}/corpusloom-{spark.sparkContext.applicationId}"
        if path not in _to_clean:  # what is written there goes with the application
            _to_clean.add(path)
            atexit.register(_clean, spark, path)
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind, which else wait until the driver collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if was is None else spark.conf.set(setting, was)


def save(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: lineage ends here, and a lost
    executor costs a re-read only."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_parts(spark: SparkSession, parts: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
    """One table of many parts, each written by a job of its own into one folder, so that no plan holds them all."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of the written table df if it has at most so many rows; else Spark shuffles both sides.

    The count reads Parquet footers only.
    """
    return F.broadcast(df) if df.count() <= rows else df


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, for a join that broadcasts it if they are few, and sorts both sides if not.

    Without the hint Spark goes by the sizes of files, and takes to the driver what they hold compressed.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")
