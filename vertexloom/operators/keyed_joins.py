"""Joins of keyed tables on their id. The right side is reduced to one row for each id first, so no join multiplies rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.names import fresh
from vertexloom.sources.keyed import keyed


def _right(other: DataFrame, unique: bool) -> DataFrame:
    return other if unique else keyed(other)


def left_join(left: DataFrame, other: DataFrame, f: Callable[[Column, Column, Column, Column], Column], unique: bool = False) -> DataFrame:
    """attr becomes f(id, attr, other's attr, whether other has the id) for every row of left; ids only in other are left out.

    unique: other is known to have each id once, which saves the aggregation; both sides hashed alike then join in place.
    """
    new, found = fresh(left.columns, "other", "hit")
    right = _right(other, unique).select("id", F.col("attr").alias(new), F.lit(True).alias(found))
    hit = F.coalesce(found, F.lit(False))
    rest = [c for c in left.columns if c not in ("id", "attr")]
    return left.join(right, "id", "left").select("id", f(F.col("id"), F.col("attr"), F.col(new), hit).alias("attr"), *rest)


def inner_join(left: DataFrame, other: DataFrame, f: Callable[[Column, Column, Column], Column], unique: bool = False) -> DataFrame:
    """attr becomes f(id, attr, other's attr) for the ids that both have."""
    (new,) = fresh(left.columns, "other")
    right = _right(other, unique).select("id", F.col("attr").alias(new))
    rest = [c for c in left.columns if c not in ("id", "attr")]
    return left.join(right, "id").select("id", f(F.col("id"), F.col("attr"), F.col(new)).alias("attr"), *rest)


def inner_join_keep_left(left: DataFrame, other: DataFrame) -> DataFrame:
    """The ids that both have, with the attribute of other."""
    return inner_join(left, other, lambda _, __, new: new)


def project_on_index(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of pairs whose id the index has, one for each id."""
    return keyed(pairs.join(index.select("id"), "id", "left_semi"))


def aggregate_using_index(index: DataFrame, messages: DataFrame, reduce: Callable[[Column], Column]) -> DataFrame:
    """Messages (id, msg) reduced by id, for the ids of the index that got any."""
    reduced = messages.groupBy("id").agg(reduce(F.col("msg")).alias("msg"))  # partly before the shuffle; then the index is met once an id
    return reduced.join(index.select("id"), "id", "left_semi")
