"""Tables that several steps of one job share, written to the folder that every executor sees."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, and only in local mode, a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="vertexloom-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers when neither PYTHONPATH nor the working folder does."""
    root = Path(__file__).resolve().parents[2]
    known = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in known or Path.cwd() == root or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    path = Path(tempfile.mkdtemp(prefix="vertexloom-")) / "vertexloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "vertexloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Parquet tables of one operator call; what the result still reads is removed when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _LEFT.append((spark, self.base))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, computed once: later steps read the files, so a lost executor costs nothing of it."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


@atexit.register
def _clear() -> None:
    for spark, path in _LEFT:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; nothing is left to remove through it
            return
