"""The graph queries over the driver's tables, and the same in SQL.

Graphs: `seq` joins each part of an order to the next one, `bip` customers to suppliers, `sparse` is seq for large discounted lines.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.functions.edges import edge_partition_1d, hash_partition, other_vertex
from vertexloom.graph import Graph
from vertexloom.operators import keyed_joins, messages, partitioning
from vertexloom.plans import algorithms, iteration
from vertexloom.plans.scratch import Scratch, ship
from vertexloom.sources import keyed
from vertexloom.sources.edge_list import read_edge_list, write_edge_list

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SEQ = """seq AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""
_SPARSE = """sparse AS (SELECT src, dst FROM (SELECT l_partkey AS src, l_quantity, l_discount, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS dst FROM lineitem)
    WHERE dst IS NOT NULL AND l_quantity >= 49 AND l_discount >= 0.08)"""
_BIP = """bip AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
_V = """v AS (SELECT id, p_size AS attr FROM (SELECT src AS id FROM seq UNION SELECT dst FROM seq) JOIN part ON p_partkey = id)"""
_DEG = """deg AS (SELECT src AS id, count(*) AS out_degree FROM seq GROUP BY src)"""
_SPREAD = 1125899906842597


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of lineitem, the lines of an order in one of as many partitions as there are lines for."""
    found = table(spark, sf_dir, "lineitem")
    return found.select("l_orderkey", *columns).repartition(partitioning.parts_for(found), "l_orderkey")


def seq_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = lines(spark, sf_dir, "l_linenumber", "l_partkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return rows.where("dst is not null").withColumn("attr", F.lit(1))


def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    rows = lines(spark, sf_dir, "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), "l_quantity", "l_discount")
    return rows.where("dst is not null and l_quantity >= 49 and l_discount >= 0.08").select("src", "dst", F.lit(1).alias("attr"))


def bip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    parts = max(partitioning.parts_for(orders), partitioning.parts_for(items))
    joined = orders.repartition(parts, "o_orderkey").join(items.repartition(parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.lit(1).alias("attr"))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and attr: the size of each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("attr"))


def seq_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """seq with the size of each part as attribute."""
    edges = seq_edges(spark, sf_dir)
    return Graph(keyed.vertices_from_edges(edges).select("id").join(sized(spark, sf_dir), "id"), edges)


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of size above 25, as updates of vertices."""
    return sized(spark, sf_dir).where("attr > 25")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with many rows for each id: the quantity of each line of a part."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").cast("long").alias("attr"))


def written(edges: DataFrame) -> DataFrame:
    """Edges that are read more than once: computed once, written and read again."""
    return Scratch(edges.sparkSession, "edges").table(edges, "all")


# sources


@query(f"WITH {_SEQ} SELECT id, 1 AS attr FROM (SELECT src AS id FROM seq UNION SELECT dst FROM seq)")
def graph_vertices_from_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(seq_edges(spark, sf_dir)).vertices


@query(f"WITH {_SEQ} SELECT src AS id, 1 AS attr, count(*) AS out_degree FROM seq GROUP BY src")
def graph_source_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.sources_from_edges(seq_edges(spark, sf_dir))


@query(f"WITH {_BIP} SELECT (SELECT count(*) FROM (SELECT src FROM bip UNION SELECT dst FROM bip)) AS vertices, (SELECT count(*) FROM bip) AS edges, (SELECT count(DISTINCT src) FROM bip) AS sources")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(bip_edges(spark, sf_dir)).counts()


@query(f"WITH {_BIP} SELECT src AS id, count(*) AS out_degree FROM bip GROUP BY src")
def graph_out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(bip_edges(spark, sf_dir)).out_degrees()


def _lists(spark: SparkSession, sf_dir: str) -> str:
    """The edges of seq, numbered from -500, as text with comments, empty lines, extra tokens and tabs."""
    scratch = Scratch(spark, "edge-list")
    shifted = seq_edges(spark, sf_dir).select((F.col("src") - 500).alias("src"), (F.col("dst") - 500).alias("dst"))
    text = shifted.select(F.explode(F.array(F.concat(F.lit("# "), F.col("src")), F.lit(""), F.concat(F.col("src"), F.when(F.col("src") % 2 == 0, "\t").otherwise("  "), F.col("dst"), F.when(F.col("dst") % 3 == 0, " more").otherwise("")))).alias("value"))
    text.write.text(scratch.path("text"))
    return scratch.path("text")


@query(f"WITH {_SEQ} SELECT src - 500 AS src, dst - 500 AS dst, 1 AS attr FROM seq")
def edge_list_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_edge_list(spark, _lists(spark, sf_dir))


@query(f"WITH {_SEQ} SELECT least(src, dst) - 500 AS src, greatest(src, dst) - 500 AS dst, 1 AS attr FROM seq")
def edge_list_load_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edge_list(spark, _lists(spark, sf_dir), canonical=True, parts=8).edges


@query(f"WITH {_SEQ} SELECT src, dst, 1 AS attr FROM seq")
def edge_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as text lines, and read again."""
    scratch = Scratch(spark, "edge-list")
    write_edge_list(seq_edges(spark, sf_dir), scratch.path("text"))
    return read_edge_list(spark, scratch.path("text"))


@query(f"WITH {_SEQ}, {_V} SELECT id, attr FROM v")
def persisted_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept, read, let go and computed again."""
    g = seq_graph(spark, sf_dir).persist(edge_level=StorageLevel.MEMORY_AND_DISK)
    g.num_vertices()
    return g.unpersist_vertices().unpersist().vertices


@query(f"WITH {_SEQ} SELECT src, dst, 1 AS attr FROM seq")
def cached_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and read while the vertices are let go."""
    g = Graph.from_edges(seq_edges(spark, sf_dir)).cache()
    g.num_edges()
    edges = g.unpersist_vertices().edges
    g.unpersist()
    return edges


# maps and filters


@query(f"WITH {_SEQ}, {_V} SELECT id, id * 10 + attr AS attr FROM v")
def map_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).map_vertices(lambda i, a: i * 10 + a).vertices


@query(f"WITH {_SEQ}, {_V} SELECT id, attr * 2 AS attr FROM v")
def vertex_map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).map_vertices(lambda _, a: a * 2).vertices


@query(f"WITH {_SEQ} SELECT src, dst, src * 3 - dst + 1 AS attr FROM seq")
def map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).map_edges(lambda s, d, a: s * 3 - d + a).edges


@query(f"WITH {_SEQ} SELECT src, dst, src % 7 AS attr FROM seq")
def edge_map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).map_edges(lambda s, _, __: s % 7).edges


@query(f"WITH {_SEQ} SELECT src, dst, src + dst AS attr FROM seq")
def map_edge_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return seq_graph(spark, sf_dir).map_edge_partitions(lambda batches: (pc.add(b.column(0), b.column(1)) for b in batches), "long").edges


@query(f"WITH {_SEQ} SELECT dst AS src, src AS dst, 1 AS attr FROM seq")
def reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).reverse().edges


@query(f"WITH {_SEQ}, {_V} SELECT id, attr FROM v WHERE attr > 25 AND id % 2 = 0")
def vertex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).filter_vertices(lambda i, a: (a > 25) & (i % 2 == 0)).vertices


@query(f"WITH {_SEQ} SELECT src, dst, dst AS other FROM seq")
def edge_other_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_edges(spark, sf_dir).select("src", "dst", other_vertex(F.col("src")).alias("other"))


@query(f"WITH {_SEQ}, {_V} SELECT id, attr FROM v WHERE id = 17")
def vertex_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).vertices.where("id = 17")


# joins


@query(f"WITH {_SEQ}, {_V} SELECT id, CASE WHEN attr > 25 THEN attr + attr ELSE -attr END AS attr FROM v")
def outer_join_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).outer_join_vertices(large(spark, sf_dir), lambda _, a, u, hit: F.when(hit, a + u).otherwise(-a)).vertices


@query(f"WITH {_SEQ}, {_V}, q AS (SELECT l_partkey AS id, min(CAST(l_quantity AS BIGINT)) AS m FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1) SELECT id, coalesce(attr + m, CAST(attr AS BIGINT)) AS attr FROM v LEFT JOIN q USING (id)")
def vertex_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_joins.left_join(seq_graph(spark, sf_dir).vertices, prices(spark, sf_dir).where("id % 3 = 0"), lambda _, a, u, hit: F.when(hit, a + u).otherwise(a.cast("long")))


@query(f"WITH {_SEQ}, {_V}, q AS (SELECT l_partkey AS id, min(CAST(l_quantity AS BIGINT)) AS m FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1) SELECT id, id + attr * m AS attr FROM v JOIN q USING (id)")
def vertex_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_joins.inner_join(seq_graph(spark, sf_dir).vertices, prices(spark, sf_dir).where("id % 3 = 0"), lambda i, a, u: i + a * u)


@query(f"WITH {_SEQ}, {_V}, {_DEG} SELECT id, CASE WHEN attr > 25 THEN attr * 2 ELSE attr END AS attr, out_degree FROM v JOIN deg USING (id)")
def source_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_joins.left_join(seq_graph(spark, sf_dir).sources, large(spark, sf_dir), lambda _, a, u, hit: F.when(hit, a + u).otherwise(a), unique=True)


@query(f"WITH {_SEQ}, {_V}, {_DEG} SELECT id, attr * 3 AS attr, out_degree FROM v JOIN deg USING (id) WHERE attr > 25")
def source_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_joins.inner_join(seq_graph(spark, sf_dir).sources, large(spark, sf_dir), lambda _, a, u: a + 2 * u, unique=True)


@query(f"WITH {_SEQ}, {_V} SELECT id, attr * 10 AS attr FROM v WHERE attr > 25")
def inner_join_keep_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_joins.inner_join_keep_left(seq_graph(spark, sf_dir).vertices, large(spark, sf_dir).withColumn("attr", F.col("attr") * 10))


@query("SELECT l_partkey AS id, min(CAST(l_quantity AS BIGINT)) AS attr FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def project_on_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_joins.project_on_index(large(spark, sf_dir), prices(spark, sf_dir))


# keyed tables and merges


@query("SELECT l_partkey AS id, min(CAST(l_quantity AS BIGINT)) AS attr FROM lineitem GROUP BY 1")
def vertex_set_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keyed(prices(spark, sf_dir))


@query("SELECT l_partkey AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS attr FROM lineitem GROUP BY 1")
def vertex_set_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keyed(prices(spark, sf_dir), F.sum)


@query("SELECT p_partkey AS id, coalesce(m, -1) AS attr FROM part LEFT JOIN (SELECT l_partkey, max(CAST(l_quantity AS BIGINT)) AS m FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1) ON l_partkey = p_partkey")
def vertex_set_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keyed_with_default(sized(spark, sf_dir), prices(spark, sf_dir).where("id % 2 = 0"), -1, F.max)


@query("SELECT l_partkey AS id, min(CAST(l_quantity AS BIGINT)) AS msg FROM lineitem GROUP BY 1")
def updates_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.updates(prices(spark, sf_dir).withColumnRenamed("attr", "msg"))


@query("SELECT l_partkey AS id, max(CAST(l_quantity AS BIGINT)) AS msg FROM lineitem GROUP BY 1")
def updates_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.updates(prices(spark, sf_dir).withColumnRenamed("attr", "msg"), F.max)


@query("SELECT l_partkey AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS msg FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def aggregate_using_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_joins.aggregate_using_index(large(spark, sf_dir), prices(spark, sf_dir).withColumnRenamed("attr", "msg"), F.sum)


# messages


@query(f"WITH {_SEQ}, {_V}, {_DEG} SELECT dst AS id, CAST(sum(attr * 100 + out_degree) AS BIGINT) AS msg FROM seq JOIN v ON v.id = src JOIN deg ON deg.id = src GROUP BY dst")
def map_reduce_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).send_along(lambda _, a, degree: a * 100 + degree, F.sum)


_BOTH = "SELECT id, CAST(sum(m) AS BIGINT) AS msg FROM (SELECT dst AS id, a.attr AS m FROM {e} JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.attr < b.attr UNION ALL SELECT src, b.attr FROM {e} JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE b.attr < a.attr) GROUP BY id"


def _downhill(src, a, dst, b):
    return [(a < b, dst, a), (b < a, src, b)]


@query(f"WITH {_SEQ}, {_V} " + _BOTH.format(e="seq"))
def map_reduce_updates_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).send_between(_downhill, F.sum)


@query(f"WITH {_SEQ}, {_V}, act AS (SELECT seq.* FROM seq WHERE src IN (SELECT id FROM v WHERE attr > 25)) " + _BOTH.format(e="act"))
def map_reduce_updates_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).send_between(_downhill, F.sum, active=large(spark, sf_dir))


@query(f"WITH {_SEQ}, {_V} SELECT DISTINCT dst AS id FROM seq WHERE src IN (SELECT id FROM v WHERE attr > 48)")
def active_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = seq_graph(spark, sf_dir)
    return messages.active_destinations(g.edges, g.vertices.where("attr > 48"))


@query(f"WITH {_SEQ}, {_V} SELECT src, a.attr AS src_attr, dst, b.attr AS dst_attr, 1 AS attr FROM seq JOIN v a ON a.id = src JOIN v b ON b.id = dst")
def edge_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_graph(spark, sf_dir).triplets


# partitions

_PART = "CAST(abs(CASE WHEN p >= 9223372036854775808 THEN p - 18446744073709551616 ELSE p END) % 8 AS INTEGER)"
_MOD = f"((CAST({{x}} AS HUGEINT) * {_SPREAD}) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616"


@query(f"WITH {_SEQ} SELECT src, dst, {_PART} AS part FROM (SELECT src - 1000 AS src, dst, {_MOD.format(x='(src - 1000)')} AS p FROM seq)")
def edge_partition_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = seq_edges(spark, sf_dir).select((F.col("src") - 1000).alias("src"), "dst")
    return edges.withColumn("part", edge_partition_1d("src", 8))


@query(f"SELECT id, {_PART} AS part FROM (SELECT o_orderkey AS id, {_MOD.format(x='o_orderkey')} AS p FROM orders)")
def key_partition_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), hash_partition("o_orderkey", 8).alias("part"))


_PLACED = f"placed AS (SELECT src, dst, {_PART} AS part FROM (SELECT src, dst, {_MOD.format(x='src')} AS p FROM seq))"


@query(f"WITH {_SEQ}, {_PLACED} SELECT part, id, CAST(bit_or(flag) AS INTEGER) AS flags FROM (SELECT part, src AS id, 1 AS flag FROM placed UNION ALL SELECT part, dst, 2 FROM placed) GROUP BY part, id")
def routing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.routing_flags(seq_edges(spark, sf_dir), edge_partition_1d("src", 8))


@query(f"WITH {_SEQ}, {_V}, {_PLACED} SELECT DISTINCT part, id, attr FROM placed JOIN v ON id = dst")
def shipped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = seq_graph(spark, sf_dir)
    return partitioning.ship_to_targets(g.vertices, g.edges, edge_partition_1d("src", 8))


@query(f"WITH {_SEQ}, {_PLACED} SELECT part, count(*) AS n FROM placed GROUP BY part")
def edge_partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.partition_sizes(seq_edges(spark, sf_dir), edge_partition_1d("src", 8))


# iteration and algorithms


def _ranks(n: int, reverse: bool = False) -> str:
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    steps = [f"WITH {_SEQ}, d AS (SELECT {src} AS id, count(*) AS k FROM seq GROUP BY 1), ids AS (SELECT src AS id FROM seq UNION SELECT dst FROM seq), r0 AS (SELECT id, CAST(0.15 AS DOUBLE) AS r FROM ids)"]
    steps += [f"r{i} AS (SELECT ids.id, 0.15 + 0.85 * coalesce(s, 0) AS r FROM ids LEFT JOIN (SELECT {dst} AS id, sum(r / k) AS s FROM seq JOIN d ON d.id = {src} JOIN r{i - 1} ON r{i - 1}.id = {src} GROUP BY 1) m ON m.id = ids.id)" for i in range(1, n + 1)]
    return ", ".join(steps) + f" SELECT id, round(r, 6) AS attr FROM r{n}"


def _pagerank(n: int, reverse: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = Graph.from_edges(written(seq_edges(spark, sf_dir)) if n else seq_edges(spark, sf_dir))
        return algorithms.pagerank(g.reverse() if reverse else g, n).vertices.select("id", F.round("attr", 6).alias("attr"))

    return run


for _n, _reverse in ((0, False), (1, False), (5, False), (5, True)):
    _name = "pagerank_reversed" if _reverse else f"pagerank_{_n}"
    QUERIES[_name], ORACLES[_name] = _pagerank(_n, _reverse), _ranks(_n, _reverse)


@query(_ranks(2))
def scatter_gather_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank by the general driver."""
    g = Graph.from_edges(written(seq_edges(spark, sf_dir)), F.lit(1.0))
    done = iteration.scatter_gather(g, 0.0, lambda _, __, m: F.lit(0.15) + F.lit(0.85) * m, lambda _, a, degree: a / degree, F.sum, 2)
    return done.vertices.select("id", F.round("attr", 6).alias("attr"))


_REACH = f"""WITH RECURSIVE {_SPARSE}, ends AS (SELECT src AS a, dst AS b FROM sparse UNION SELECT dst, src FROM sparse),
    reach(v, l) AS (SELECT a, a FROM ends UNION SELECT b, l FROM reach JOIN ends ON a = v), labels AS (SELECT v AS id, min(l) AS attr FROM reach GROUP BY v)"""


@query(_REACH + " SELECT id, attr FROM labels")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.connected_components(Graph.from_edges(written(sparse_edges(spark, sf_dir)))).vertices


@query(_REACH + " SELECT attr AS label, count(*) AS n FROM labels GROUP BY attr")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.component_sizes(Graph.from_edges(written(sparse_edges(spark, sf_dir))))


@query(_REACH + " SELECT id, attr FROM labels")
def scatter_gather_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by the general driver: the smaller label goes to the end that has the larger one."""
    g = Graph.from_edges(written(sparse_edges(spark, sf_dir))).map_vertices(lambda i, _: i)
    return iteration.scatter_gather_between(g, 2**63 - 1, lambda _, a, m: F.least(a, m), _downhill, F.min).vertices


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
