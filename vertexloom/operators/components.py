"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(edges: DataFrame) -> tuple:
    """The number of edges and a digest of their set; an exclusive or overflows at no size."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def star_components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], drop: Callable[..., None] | None = None) -> DataFrame:
    """edges: a, b of any one orderable type, none of them null. id and label, the least id of its component, for every id in edges.

    keep(df, name) must return df computed once (a table that is written and read again); drop(*names) removes such tables. A hub's
    edges are never gathered: each step is a grouped minimum, which is partly computed before the shuffle, and a join of two tables
    that are read from files, whose hot keys Spark splits. Every component ends as a star around its least id after about log(n) rounds.
    """
    nodes = keep(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "nodes")
    one_way = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, state, turn = keep(one_way, "star-0"), None, 0
    while (new := _state(now)) != state and new[0]:
        state, last, made = new, f"star-{turn}", []
        turn += 1
        # large star: the greater neighbours of u move to the least id around u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), made_name := f"large-{turn}")
        made.append(made_name)
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        moved = keep(moved, made_name := f"moved-{turn}")
        made.append(made_name)
        # small star: u and its smaller neighbours move to the least of them
        least = keep(moved.groupBy("u").agg(F.min("v").alias("m")), made_name := f"small-{turn}")
        made.append(made_name)
        pairs = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        now = keep(pairs.distinct(), f"star-{turn}")
        if drop:
            drop(last, *made)
    roots = now.groupBy("u").agg(F.min("v").alias("label"))
    return nodes.join(roots, nodes["id"] == roots["u"], "left").select("id", F.coalesce("label", "id").alias("label"))
