"""A directed property multigraph: a table of vertices and a table of edges."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators import keyed_joins, messages, partitioning
from vertexloom.sources.edge_list import read_edge_list
from vertexloom.sources.keyed import vertices_from_edges

_log = logging.getLogger(__name__)


def counted(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Array]]) -> Callable:
    """mapInArrow's function for f, which gives new attributes for the edges of a partition: as many as there are edges, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    waiting.append(b)
                    yield b

        for values in f(seen()):
            while len(values):
                if not waiting:
                    raise ValueError("more new attributes than edges")
                edge = waiting[0]
                n = min(len(values), edge.num_rows)
                yield pa.RecordBatch.from_arrays([edge.column(0).slice(0, n), edge.column(1).slice(0, n), values.slice(0, n)], ["src", "dst", "attr"])
                values = values.slice(n)
                if n == edge.num_rows:
                    waiting.pop(0)
                else:
                    waiting[0] = edge.slice(n)
        if waiting or any(True for _ in seen()):
            raise ValueError("fewer new attributes than edges")

    return run


class Graph:
    """vertices (id, attr) with one row for each id, and edges (src, dst, attr), parallel edges and loops among them.

    Nothing is changed in place: each operator gives a new graph. Functions take and give columns.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges = vertices.select("id", "attr"), edges.select("src", "dst", "attr")

    @classmethod
    def from_edges(cls, edges: DataFrame, default: object = 1) -> Graph:
        """A graph of the ids in edges (src, dst, attr)."""
        return cls(vertices_from_edges(edges, default), edges)

    @classmethod
    def from_edge_list(cls, spark: SparkSession, path: str, canonical: bool = False, malformed: str = "fail", parts: int | None = None, eager: bool = False) -> Graph:
        """A graph of text files of edges; all attributes are 1. parts: co-locate the edges of a source in so many partitions.
        eager: read and keep the edges now, and log their number and the milliseconds that took."""
        edges = read_edge_list(spark, path, canonical, malformed)
        edges = partitioning.partition_by_source(edges, parts) if parts else edges
        if eager:
            began, edges = time.perf_counter(), edges.persist(StorageLevel.MEMORY_AND_DISK)
            _log.info("%d edges of %s in %.0f ms", edges.count(), path, 1000 * (time.perf_counter() - began))
        return cls.from_edges(edges)

    @property
    def sources(self) -> DataFrame:
        """id, attr and out_degree of each vertex with an out-edge."""
        return messages.out_degrees(self.edges).join(self.vertices, "id").select("id", "attr", "out_degree")

    @property
    def triplets(self) -> DataFrame:
        return messages.triplets(self.vertices, self.edges)

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def counts(self) -> DataFrame:
        """One row: vertices that have an edge, edges, and sources, by one pass over the edges."""
        source = (F.col("out_degree") > 0) & F.col("id").isNotNull()
        edges = F.coalesce(F.sum("out_degree"), F.lit(0))
        return messages.end_degrees(self.edges).agg(F.count("*").alias("vertices"), edges.alias("edges"), F.count_if(source).alias("sources"))

    def out_degrees(self) -> DataFrame:
        return messages.out_degrees(self.edges)

    def lookup(self, vid: int) -> object:
        """The attribute of a vertex; a KeyError if there is no such vertex."""
        found = self.vertices.where(F.col("id") == vid).select("attr").limit(1).collect()
        if not found:
            raise KeyError(vid)
        return found[0]["attr"]

    def is_defined(self, vid: int) -> bool:
        """Whether the vertex is there."""
        return not self.vertices.where(F.col("id") == vid).isEmpty()

    def visit_edges(self, f: Callable[[Iterator[pa.RecordBatch]], None]) -> None:
        """f sees the edges of each partition as Arrow batches, on the executors, for what it does with them; nothing comes back."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f(batches)
            return iter(())

        self.edges.mapInArrow(run, "src long").write.format("noop").mode("overwrite").save()

    def persist(self, level: StorageLevel = StorageLevel.DISK_ONLY, edge_level: StorageLevel | None = None) -> Graph:
        """Keep vertices and edges, once they are computed; edge_level: another level for the edges."""
        self.vertices.persist(level)
        self.edges.persist(edge_level or level)
        return self

    def cache(self) -> Graph:
        return self.persist(StorageLevel.MEMORY_AND_DISK)

    def unpersist_vertices(self, blocking: bool = True) -> Graph:
        self.vertices.unpersist(blocking)
        return self

    def unpersist(self, blocking: bool = True) -> Graph:
        self.edges.unpersist(blocking)
        return self.unpersist_vertices(blocking)

    def map_vertices(self, f: Callable[[Column, Column], Column]) -> Graph:
        """attr becomes f(id, attr)."""
        return Graph(self.vertices.select("id", f(F.col("id"), F.col("attr")).alias("attr")), self.edges)

    def map_edges(self, f: Callable[[Column, Column, Column], Column]) -> Graph:
        """attr becomes f(src, dst, attr)."""
        return Graph(self.vertices, self.edges.select("src", "dst", f(F.col("src"), F.col("dst"), F.col("attr")).alias("attr")))

    def map_edge_partitions(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Array]], kind: str) -> Graph:
        """f gets the edges of a partition as Arrow batches and gives as many attributes of the SQL type `kind`, in their order."""
        return Graph(self.vertices, self.edges.mapInArrow(counted(f), f"src long, dst long, attr {kind}"))

    def filter_vertices(self, keep: Callable[[Column, Column], Column]) -> Graph:
        """The vertices for which keep(id, attr) holds; edges stay as they are."""
        return Graph(self.vertices.where(keep(F.col("id"), F.col("attr"))), self.edges)

    def reverse(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "attr"))

    def outer_join_vertices(self, other: DataFrame, f: Callable[[Column, Column, Column, Column], Column]) -> Graph:
        """attr becomes f(id, attr, other's attr, whether other (id, attr) has the id) for every vertex."""
        return Graph(keyed_joins.left_join(self.vertices, other, f), self.edges)

    def send_along(self, message: Callable, reduce: Callable, target: Callable | None = None) -> DataFrame:
        """See operators.messages.send_along."""
        return messages.send_along(self.vertices, self.edges, message, reduce, target)

    def send_between(self, send: Callable, reduce: Callable, active: DataFrame | None = None, needs_target: bool = True) -> DataFrame:
        """See operators.messages.send_between."""
        return messages.send_between(self.vertices, self.edges, send, reduce, active, needs_target)
