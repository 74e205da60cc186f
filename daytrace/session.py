"""Makes this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per context; they may not share the driver's folders."""
    sc = spark.sparkContext
    if getattr(sc, "_daytrace_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "daytrace_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("daytrace", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._daytrace_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine, as in tests, one of our own where none is set.

    On several machines a folder of the driver's would be another one on each executor, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_daytrace_folder", None)
    if own is None:
        own = spark.sparkContext._daytrace_folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path
