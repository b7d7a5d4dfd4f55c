"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lexspark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on; a cluster normally supplies its own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{key: str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only in local mode, where all tasks share one machine, may a session name none: a temporary folder is then
    made, used by every job of that session, and removed when the driver ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lexspark.shared.dir", None)
    if not path:
        if not _is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lexspark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("lexspark.shared.dir", path)
    return path.rstrip("/")


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove a written scratch folder when the driver ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back; a checkpoint is not compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable; a directory that is already set is kept."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per session."""
    context = spark.sparkContext
    if getattr(context, "_lexspark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="lexspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(os.path.join(os.path.realpath(folder), "lexspark"), "zip", root, "lexspark")
    context.addPyFile(archive)
    context._lexspark_shipped = True
