"""Session helpers: local sessions for tests and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables written by this process that were not removed yet.
_PATHS: list[str] = []


def local_session(cores: int = 8, app: str = "trellisq") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset a local session (one JVM) gets a temporary folder; on a cluster it
    is an error, as executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="trellisq-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing the rows as a table in the shared folder and reading it again.

    The table outlives lost executors.  It is removed by :func:`discard`, by
    :func:`release` once a query's rows are taken, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trellisq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept_until_release(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def kept_until_release(spark: SparkSession, path: str) -> None:
    """Note a folder that is to be removed by :func:`release`, or else when the application ends."""
    files, where = _place(spark, path)
    files.deleteOnExit(where)
    _PATHS.append(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written` that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove all tables of :func:`written`: for callers that have taken the rows of their queries."""
    for path in list(_PATHS):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    files, where = _place(spark, path)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)
    if path in _PATHS:
        _PATHS.remove(path)
