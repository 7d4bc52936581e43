"""Shared tables of one operator call, and what its session needs."""

from pyspark.sql import SparkSession

from vertexloom.plans.scratch import Scratch, remove, shared_folder, ship

__all__ = ["Scratch", "bounded", "remove", "shared_folder", "ship"]
#: Bytes of an Arrow batch between Spark and a worker, about.
BATCH_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Arrow batches end by their bytes, too, from now on in this session; a bound that it has already stays.

    A batch of 10,000 texts lies in an executor several times over: in the buffers that Spark fills and doubles, and in the worker.
    """
    if spark.conf.get(_BOUND, None) is None:
        spark.conf.set(_BOUND, str(BATCH_BYTES))
