"""Where edges and vertices are: partition sizes and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE, TARGET = 1, 2
#: Rows that one task sorts or joins where `parts_for` gives the number of partitions.
ROWS = 500_000


def parts_for(frame: DataFrame, rows: int = ROWS) -> int:
    """So many partitions that each has about `rows` of frame's rows, and no fewer than the cluster's cores. Adaptive execution would
    merge those of a shuffle up to its advisory size, whatever a task then has to sort. Counting files reads no columns."""
    return max(frame.sparkSession.sparkContext.defaultParallelism, -(-frame.count() // rows))


def partition_by_source(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges of a source in one partition, sorted by (src, dst)."""
    placed = edges.repartition(parts, "src") if parts else edges.repartition("src")
    return placed.sortWithinPartitions("src", "dst")


def partition_sizes(frame: DataFrame, part: Column | None = None) -> DataFrame:
    """part and the number of rows there, by an expression or by where the rows are now."""
    return frame.groupBy((F.spark_partition_id() if part is None else part).alias("part")).agg(F.count("*").alias("n"))


def routing_flags(edges: DataFrame, part: Column) -> DataFrame:
    """Which partitions of edges need which vertex: part, id, and flags (1 as a source, 2 as a target, 3 as both)."""
    placed = edges.select(part.alias("part"), "src", "dst")
    ends = placed.select("part", F.col("src").alias("id"), F.lit(SOURCE).alias("flag")).union(placed.select("part", "dst", F.lit(TARGET)))
    return ends.groupBy("part", "id").agg(F.bit_or("flag").alias("flags"))


def ship_to_targets(vertices: DataFrame, edges: DataFrame, part: Column) -> DataFrame:
    """part, id and attr: the attribute of each vertex, once for each partition of edges where it is a target."""
    wanted = edges.select(part.alias("part"), F.col("dst").alias("id")).distinct()
    return wanted.join(vertices.select("id", "attr"), "id").select("part", "id", "attr")
