"""Messages along edges, reduced by the vertex that gets them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Reduce = Callable[[Column], Column]


def triplets(vertices: DataFrame, edges: DataFrame, both: bool = True) -> DataFrame:
    """Edges with the attributes of their ends: src, src_attr, dst, dst_attr (if both), attr."""
    out = edges.join(vertices.select(F.col("id").alias("src"), F.col("attr").alias("src_attr")), "src")
    if both:
        out = out.join(vertices.select(F.col("id").alias("dst"), F.col("attr").alias("dst_attr")), "dst")
    return out.select("src", "src_attr", "dst", *(["dst_attr"] if both else []), "attr")


def with_active_sources(edges: DataFrame, active: DataFrame) -> DataFrame:
    """The edges whose source is in active (id)."""
    return edges.join(active.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def with_active_ends(edges: DataFrame, active: DataFrame) -> DataFrame:
    """The edges with an end in active (id)."""
    ids = active.select("id").distinct()
    flag = lambda end: ids.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}"))
    return edges.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left").where("__src or __dst").select(*edges.columns)


def active_destinations(edges: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Distinct targets, of active sources only if they are given."""
    return (edges if active is None else with_active_sources(edges, active)).select(F.col("dst").alias("id")).distinct()


def out_degrees(edges: DataFrame) -> DataFrame:
    """id and out_degree of every source; parallel edges count."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))


def end_degrees(edges: DataFrame) -> DataFrame:
    """id and out_degree of every source and target, each edge read once; 0 for those that are targets only."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))
    return edges.select(F.inline(ends)).groupBy("id").agg(F.sum("out").alias("out_degree"))


def send_along(vertices: DataFrame, edges: DataFrame, message: Callable[[Column, Column, Column], Column], reduce: Reduce, target: Callable[[Column, Column, Column], Column] | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """One message for each edge from (target's id, source's attr, source's out-degree), reduced by id: id, msg.

    target gives the id that gets the message, by default the edge's own target. Degrees join the vertices before the edges do, so
    the edges move once, and the reduction is partly done before its shuffle. degrees (id, out_degree): those of the edges, if known.
    """
    degrees = out_degrees(edges) if degrees is None else degrees
    known = degrees.join(vertices.select("id", "attr"), "id").select(F.col("id").alias("src"), F.col("attr").alias("__attr"), "out_degree")
    args = (F.col("dst"), F.col("__attr"), F.col("out_degree"))
    to = target(*args) if target else args[0]
    return edges.select("src", "dst").join(known, "src").select(to.alias("id"), message(*args).alias("msg")).groupBy("id").agg(reduce(F.col("msg")).alias("msg"))


def send_between(vertices: DataFrame, edges: DataFrame, messages: Callable[[Column, Column, Column, Column], list[tuple[Column, Column, Column]]], reduce: Reduce, active: DataFrame | None = None, needs_target: bool = True) -> DataFrame:
    """Any number of messages for each edge from (src, src_attr, dst, dst_attr), reduced by id: id, msg.

    messages gives (condition, id, msg) triples; a message is sent where its condition holds. active: only edges with a source in it.
    needs_target=False leaves out the join with the targets' attributes, which are null then.
    """
    if active is not None:
        edges = with_active_sources(edges, active)
    found = triplets(vertices, edges, both=needs_target)
    if not needs_target:
        found = found.withColumn("dst_attr", F.lit(None))
    sent = messages(*(F.col(c) for c in ("src", "src_attr", "dst", "dst_attr")))
    options = F.array(*(F.when(when, F.struct(to.alias("id"), msg.alias("msg"))) for when, to, msg in sent))
    return found.select(F.inline(F.filter(options, lambda x: x.isNotNull()))).groupBy("id").agg(reduce(F.col("msg")).alias("msg"))


def reduce_pairwise(f: Callable[[Column, Column], Column]) -> Reduce:
    """A reducer from a binary function. It gathers the messages of an id, so a built-in aggregate is better wherever there is one."""
    def reduce(c: Column) -> Column:
        all_ = F.collect_list(c)
        return F.aggregate(F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0))), F.element_at(all_, 1), f)

    return reduce
