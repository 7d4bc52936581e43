"""Keyed tables: one row for each id, made from edges or from pairs (id, attr)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Reduce = Callable[[Column], Column]


def vertices_from_edges(edges: DataFrame, default: object = 1) -> DataFrame:
    """Every id that is a source or a target, once, with a default attribute."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ids.withColumn("attr", default if isinstance(default, Column) else F.lit(default))


def sources_from_edges(edges: DataFrame, default: object = 1) -> DataFrame:
    """Every id with an out-edge, its default attribute and its out-degree (parallel edges count)."""
    found = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return found.select("id", (default if isinstance(default, Column) else F.lit(default)).alias("attr"), "out_degree")


def keyed(pairs: DataFrame, reduce: Reduce = F.min) -> DataFrame:
    """One row for each id of pairs (id, attr); equal ids are reduced, by default to the least attribute."""
    return pairs.groupBy("id").agg(reduce(F.col("attr")).alias("attr"))


def keyed_with_default(ids: DataFrame, pairs: DataFrame, default: object, reduce: Reduce = F.min) -> DataFrame:
    """Every id of `ids` once, with its attribute in `pairs` (null if that is null) or else the default; other pairs are left out."""
    own = keyed(pairs, reduce).withColumn("hit", F.lit(True))
    return ids.select("id").distinct().join(own, "id", "left").select("id", F.when(F.col("hit"), F.col("attr")).otherwise(F.lit(default)).alias("attr"))


def updates(pairs: DataFrame, reduce: Reduce = F.min) -> DataFrame:
    """Messages or changed values (id, msg), one for each id."""
    return pairs.groupBy("id").agg(reduce(F.col("msg")).alias("msg"))
