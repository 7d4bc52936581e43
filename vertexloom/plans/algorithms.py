"""PageRank and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.components import star_components
from vertexloom.plans.scratch import Scratch

#: Supersteps of PageRank in one plan; then the sums are written and read again.
CUT_EVERY = 10
#: Edges in a partition, where the session's number of partitions would give more.
HELD = 1_000_000


def rank_shares(edges: DataFrame, sums: DataFrame, reset: float) -> DataFrame:
    """What each target gets in a superstep. edges: src, dst, out_degree; sums: id and s, what came in before. The ranks themselves are
    never stored: a vertex without a sum has the reset value. If edges and sums are hashed alike, the new sums are the only shuffle."""
    rank = F.lit(reset) + F.lit(1 - reset) * F.coalesce("s", F.lit(0.0))
    return edges.join(sums, edges["src"] == sums["id"], "left").select(F.col("dst").alias("id"), (rank / F.col("out_degree")).alias("share"))


def _hubs(degrees: DataFrame, edges: int, parts: int) -> list[int]:
    """The sources with more edges than a partition has on average, so at most `parts` ids."""
    return [r["id"] for r in degrees.where(F.col("out_degree") > edges / parts).select("id").limit(parts).collect()]


def _placed(edges: DataFrame, parts: int) -> DataFrame:
    """src, dst and out_degree: hashed and sorted by source with one shuffle, so that no superstep sorts them again. Parallel edges
    become one with a share of the degree."""
    per_pair = edges.repartition(parts, "src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    degree = F.sum("n").over(Window.partitionBy("src"))
    return per_pair.select("src", "dst", (degree / F.col("n")).alias("out_degree")).sortWithinPartitions("src")


def _placed_hubs(edges: DataFrame, degrees: DataFrame, parts: int) -> DataFrame:
    """The same for hubs, whose degrees are few: combined before they move, and dealt out by both ends."""
    per_pair = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    found = per_pair.join(F.broadcast(degrees.withColumnRenamed("id", "src")), "src")
    return found.select("src", "dst", (F.col("out_degree") / F.col("n")).alias("out_degree")).repartition(parts, "src", "dst")


def pagerank(graph: Graph, iterations: int, reset: float = 0.15) -> Graph:
    """attr: the rank after so many supersteps. All ranks begin at `reset`; no mass is handed on from sinks, nothing is normalised.

    Edges are kept hashed by source, but those of a hub (more edges than a mean partition) are dealt out by both ends and meet the
    hub's sum by a broadcast of at most as many rows as there are partitions. What is kept is let go when the sums are written.
    """
    if iterations < 0:
        raise ValueError("iterations must not be negative")
    if iterations == 0:
        return graph.map_vertices(lambda _, __: F.lit(reset))
    spark = graph.edges.sparkSession
    scratch, parts = Scratch(spark, "pagerank"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    degrees = scratch.table(graph.out_degrees(), "degrees")
    edges, number = graph.edges.where("src is not null").select("src", "dst"), degrees.agg(F.sum("out_degree")).first()[0] or 0
    parts = max(parts, -(-number // HELD))
    hubs = _hubs(degrees, number, parts) if iterations > 1 else []
    held = []
    if hubs:
        hub = F.col("src").isin(hubs)
        held = [_placed(edges.where(~hub), parts).persist(), _placed_hubs(edges.where(hub), degrees.where(F.col("id").isin(hubs)), parts).persist()]
    elif iterations > 1:
        held = [_placed(edges, parts).persist()]
    else:
        placed = edges.join(degrees.withColumnRenamed("id", "src"), "src")
    first = held[0].union(held[1]) if hubs else (held or [placed])[0]
    sums = first.groupBy(F.col("dst").alias("id")).agg(F.sum(F.lit(reset) / F.col("out_degree")).alias("s"))
    for turn in range(1, iterations):
        if hubs or turn % CUT_EVERY == 0:
            sums = scratch.table(sums, f"sums-{turn}")
        shares = [rank_shares(held[0], sums, reset)]
        if hubs:
            shares.append(rank_shares(held[1], F.broadcast(sums.where(F.col("id").isin(hubs))), reset))
        sums = (shares[0].union(shares[1]) if hubs else shares[0]).groupBy("id").agg(F.sum("share").alias("s"))
    if held:
        sums = scratch.table(sums, "sums")
        for frame in held:
            frame.unpersist()
    rank = F.lit(reset) + F.lit(1 - reset) * F.coalesce("s", F.lit(0.0))
    return Graph(graph.vertices.select("id").join(sums, "id", "left").select("id", rank.alias("attr")), graph.edges)


def connected_components(graph: Graph) -> Graph:
    """attr: the least id of the vertex's weakly connected component."""
    scratch = Scratch(graph.edges.sparkSession, "components")
    labels = star_components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch.table, scratch.drop)
    found = graph.vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("attr"))
    return Graph(found, graph.edges)


def component_sizes(graph: Graph) -> DataFrame:
    """label and n, the number of vertices, of each component."""
    return connected_components(graph).vertices.groupBy(F.col("attr").alias("label")).agg(F.count("*").alias("n"))
