"""Bulk-synchronous iteration: vertices take up messages, then send new ones along edges, until none is sent or a bound is reached.

The state of each superstep is written to the shared folder and read again, so plans stay short and a lost executor costs one superstep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators import messages
from vertexloom.plans.scratch import Scratch

Program = Callable[[Column, Column, Column], Column]


def _apply(vertices: DataFrame, msgs: DataFrame, program: Program) -> DataFrame:
    """The program runs where there is a message, null or not; `changed` tells where the attribute became another."""
    hit = msgs.select("id", "msg", F.lit(True).alias("hit"))
    new = F.when(F.col("hit"), program(F.col("id"), F.col("attr"), F.col("msg"))).otherwise(F.col("attr"))
    return vertices.select("id", "attr").join(hit, "id", "left").select("id", new.alias("attr"), (~new.eqNullSafe(F.col("attr"))).alias("changed"))


def _kept(graph: Graph) -> DataFrame:
    """The edges, computed once and hashed by source: supersteps neither read them again nor move them."""
    parts = int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return graph.edges.repartition(parts, "src").persist(StorageLevel.DISK_ONLY)


def scatter_gather(graph: Graph, initial: object, program: Program, message: Callable, gather: Callable, max_iterations: int) -> Graph:
    """program(id, attr, initial) on all vertices; then, max_iterations times at most, messages along every edge and the program on
    the vertices that got one. message(target, source's attr, out-degree) sends one for each edge, so only the bound ends it."""
    scratch = Scratch(graph.edges.sparkSession, "scatter-gather")
    first = graph.map_vertices(lambda i, a: program(i, a, F.lit(initial)))
    vertices, edges = scratch.table(first.vertices, "state-0"), _kept(graph)
    degrees = scratch.table(messages.out_degrees(edges), "degrees")
    for turn in range(1, max_iterations + 1):
        msgs = messages.send_along(vertices, edges, message, gather, degrees=degrees)
        vertices = scratch.table(_apply(vertices, msgs, program), f"state-{turn}")
        scratch.drop(f"state-{turn - 1}")
    edges.unpersist()
    return Graph(vertices, graph.edges)


def scatter_gather_between(graph: Graph, initial: object, program: Program, send: Callable, gather: Callable, max_iterations: int = 2**31 - 1, frontier: str = "ends") -> Graph:
    """As scatter_gather, with messages from both ends (see messages.send_between). After the first round only edges with an end
    (frontier="ends") or a source ("sources") that changed send; it ends when nothing changes."""
    if frontier not in ("ends", "sources"):
        raise ValueError("frontier: ends or sources")
    scratch = Scratch(graph.edges.sparkSession, "scatter-gather")
    first = graph.map_vertices(lambda i, a: program(i, a, F.lit(initial)))
    vertices, whole = scratch.table(first.vertices.withColumn("changed", F.lit(True)), "state-0"), _kept(graph)
    edges = whole
    for turn in range(1, max_iterations + 1):
        if turn > 1:
            active = vertices.where("changed").select("id")
            pick = messages.with_active_ends if frontier == "ends" else messages.with_active_sources
            edges = pick(whole, active)
        msgs = messages.send_between(vertices, edges, send, gather)
        vertices = scratch.table(_apply(vertices, msgs, program), f"state-{turn}")
        scratch.drop(f"state-{turn - 1}")
        if vertices.where("changed").isEmpty():
            break
    whole.unpersist()
    return Graph(vertices, graph.edges)
