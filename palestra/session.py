"""Session settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a plan that splits a hot key beats one that saves a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # recording the Python call site of every column expression slows plan building
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A one-machine session for tests and timing."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palestra")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: what ``spark.checkpoint.dir`` names, or
    the context's checkpoint folder. Only a one-machine session may fall back to its own
    temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        return folder.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="palestra-"))
    return context.getCheckpointDir().rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def application_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the shared one. It is
    removed when the application ends."""
    folder = f"{scratch_folder(spark)}/palestra-{spark.sparkContext.applicationId}"
    if folder not in _to_remove:
        _to_remove.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


_to_remove: set[str] = set()
_workspaces: list[str] = []


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        delete_folder(spark, folder)
    except Exception:  # the engine is gone already; nothing reads the folder any more
        return


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made within the block are removed at its end. What is read from
    them must be written elsewhere before."""
    folder = f"{application_folder(spark)}/work-{uuid.uuid4().hex}"
    _workspaces.append(folder)
    try:
        yield folder
    finally:
        _workspaces.remove(folder)
        delete_folder(spark, folder)


def durable(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder. Lost executors then cost no
    recomputation, later steps see the same rows, and they read only the columns they use.
    ``codec`` packs a table that may be large tighter than the session's own."""
    spark = df.sparkSession
    folder = _workspaces[-1] if _workspaces else application_folder(spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
