"""What operators need of a session: the package on the executors, and the folder that all of them share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (local runs, tests) a temporary folder is set."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="duoscope-")
    if not found.isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Has a folder of intermediate data, which is there already, removed when the driver ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop)


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the context's Python files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_duoscope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="duoscope-code-")) / "duoscope_sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._duoscope_shipped = True
