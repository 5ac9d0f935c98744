"""The session, and this package on executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "tickframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; a cluster's own settings stay."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application, so that Python functions are
    imported by name there and module-level caches live as long as a Python worker does."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(top)
    with tempfile.NamedTemporaryFile(prefix=f"{name}-", suffix=".zip", delete=False) as handle:
        with zipfile.ZipFile(handle, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, files in os.walk(top):
                for file in files:
                    if file.endswith(".py"):
                        path = os.path.join(folder, file)
                        archive.write(path, os.path.join(name, os.path.relpath(path, top)))
    context.addPyFile(handle.name)
    # executors fetch it from here as long as the application runs
    atexit.register(lambda: os.path.exists(handle.name) and os.unlink(handle.name))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines share.  Only where that setting is absent and
    everything runs on one machine, as in tests, it is a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    where = context.getConf().get("spark.checkpoint.dir")
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = os.path.join(tempfile.gettempdir(), f"checkpoints-{context.applicationId}")
    context.setCheckpointDir(where)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(where, True)
    files.cancelDeleteOnExit(where)
