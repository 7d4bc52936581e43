"""Operators on micro graphs: duplicates, loops, negative and large ids, isolated ends, malformed lines."""

import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark import StorageLevel
from pyspark.sql import functions as F

from vertexloom.functions.edges import edge_partition_1d, hash_partition, other_vertex
from vertexloom.graph import Graph
from vertexloom.operators import components, keyed_joins, messages, partitioning
from vertexloom.functions.names import fresh
from vertexloom.plans.algorithms import component_sizes, connected_components, pagerank, rank_shares
from vertexloom.plans.iteration import scatter_gather, scatter_gather_between
from vertexloom.sources import keyed
from vertexloom.sources.edge_list import parse_edge_lines, read_edge_list, write_edge_list

M1 = [(1, 2), (2, 3), (3, 1), (1, 3), (4, 3)]
M2 = [(1, 2), (1, 2), (1, 3), (2, 1)]
FAR = [(-5, 2**33 + 5), (2**33 + 5, 2**62), (2**62, -5), (-5, -5), (-5, 2**33 + 5)]


def edges(spark, pairs, attr=1):
    return spark.createDataFrame([(a, b, attr) for a, b in pairs], "src long, dst long, attr int")


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


def test_counts_and_vertices(spark):
    g = Graph.from_edges(edges(spark, M2))
    assert (g.num_vertices(), g.num_edges()) == (3, 4)
    assert rows(g.vertices) == [(1, 1), (2, 1), (3, 1)]
    assert rows(g.out_degrees()) == [(1, 3), (2, 1)]
    assert rows(g.sources) == [(1, 1, 3), (2, 1, 1)]
    assert rows(keyed.sources_from_edges(edges(spark, M2), 7)) == [(1, 7, 3), (2, 7, 1)]


def test_empty_graph(spark):
    g = Graph.from_edges(edges(spark, []))
    assert (g.num_vertices(), g.num_edges()) == (0, 0)
    assert rows(pagerank(g, 3).vertices) == [] and rows(connected_components(g).vertices) == []


def test_loader(spark, tmp_path):
    lines = ["# comment", "", "1   -5", "2\t7 extra", "3 3", "3 3", "+6 7"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert rows(parse_edge_lines(df)) == [(1, -5, 1), (2, 7, 1), (3, 3, 1), (3, 3, 1), (6, 7, 1)]
    assert rows(parse_edge_lines(df, canonical=True))[0] == (-5, 1, 1)
    for bad in ("x", " 3 4", "1", "9 y"):
        one = spark.createDataFrame([(bad,), ("1 2",)], "value string")
        assert rows(parse_edge_lines(one, malformed="drop")) == [(1, 2, 1)]
        with pytest.raises(Exception, match="malformed edge line"):
            parse_edge_lines(one).collect()
    with pytest.raises(ValueError):
        parse_edge_lines(df, malformed="keep")
    path = str(tmp_path / "edges")
    write_edge_list(edges(spark, FAR), path)
    assert rows(read_edge_list(spark, path)) == rows(edges(spark, FAR))
    g = Graph.from_edge_list(spark, path, parts=3)
    assert g.num_edges() == 5 and g.edges.rdd.getNumPartitions() == 3


def test_maps_and_filters(spark):
    g = Graph.from_edges(edges(spark, M1))
    assert rows(g.map_vertices(lambda i, a: i * 10 + a).vertices) == [(i, i * 10 + 1) for i in (1, 2, 3, 4)]
    assert rows(g.map_edges(lambda s, d, a: s * 100 + d + a).edges)[0] == (1, 2, 103)
    assert rows(g.filter_vertices(lambda i, _: i > 2).vertices, "id") == [(3,), (4,)]
    assert rows(g.reverse().reverse().edges) == rows(g.edges)
    assert rows(g.reverse().edges, "src", "dst") == sorted((b, a) for a, b in M1)
    assert rows(g.triplets)[0] == (1, 1, 2, 1, 1)


def test_map_edge_partitions(spark):
    g = Graph.from_edges(edges(spark, M1 * 50))
    got = g.map_edge_partitions(lambda bs: (pc.multiply(b.column(0), b.column(1)) for b in bs), "long").edges
    assert rows(got) == sorted((a, b, a * b) for a, b in M1 * 50)

    def all_at_once(batches):
        values = [v for b in batches for v in b.column(1).to_pylist()]
        yield pa.array(values, pa.int64())

    assert rows(g.map_edge_partitions(all_at_once, "long").edges) == sorted((a, b, b) for a, b in M1 * 50)
    for wrong in (lambda bs: (b.column(0).slice(1) for b in bs), lambda bs: (pa.concat_arrays([b.column(0)] * 2) for b in bs)):
        with pytest.raises(Exception, match="new attributes than edges"):
            g.map_edge_partitions(wrong, "long").edges.collect()


def test_other_vertex(spark):
    df = edges(spark, [(1, 2), (3, 3)])
    assert rows(df.select(other_vertex(F.col("src")).alias("o"))) == [(2,), (3,)]
    assert rows(df.where("src = 1").select(other_vertex(F.lit(2)).alias("o"))) == [(1,)]
    with pytest.raises(Exception, match="does not touch"):
        df.select(other_vertex(F.lit(9)).alias("o")).collect()


def test_joins_reduce_the_right_side_and_tell_null_from_missing(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, attr int")
    other = spark.createDataFrame([(1, 5), (1, 3), (2, None), (9, 1)], "id long, attr int")
    got = keyed_joins.left_join(left, other, lambda _, a, u, hit: F.when(hit, F.coalesce(u, F.lit(-1))).otherwise(a))
    assert rows(got) == [(1, 3), (2, -1), (3, 30)]
    assert rows(keyed_joins.inner_join(left, other.where("attr is not null"), lambda i, a, u: i + a + u)) == [(1, 14)]
    assert rows(keyed_joins.inner_join_keep_left(left, other.where("id = 1"))) == [(1, 3)]
    assert rows(keyed_joins.project_on_index(left, other.where("attr is not null"))) == [(1, 3)]
    g = Graph(left, edges(spark, [])).outer_join_vertices(other, lambda _, a, u, hit: F.when(hit, u).otherwise(a))
    assert sorted((r.id, r.attr) for r in g.vertices.where("id <> 2").collect()) == [(1, 3), (3, 30)]


def test_keyed_tables(spark):
    pairs = spark.createDataFrame([(1, 5), (1, 3), (2, None), (9, 1)], "id long, attr int")
    assert rows(keyed.keyed(pairs.where("id <> 2"))) == [(1, 3), (9, 1)]
    assert rows(keyed.keyed(pairs.where("id <> 2"), F.sum)) == [(1, 8), (9, 1)]
    ids = spark.createDataFrame([(1,), (1,), (2,), (4,)], "id long")
    got = {r.id: r.attr for r in keyed.keyed_with_default(ids, pairs, 7).collect()}
    assert got == {1: 3, 2: None, 4: 7}
    assert rows(keyed.updates(pairs.where("id = 1").withColumnRenamed("attr", "msg"), F.max)) == [(1, 5)]
    msgs = pairs.where("attr is not null").withColumnRenamed("attr", "msg")
    assert rows(keyed_joins.aggregate_using_index(ids, msgs, F.sum)) == [(1, 8)]


def test_messages(spark):
    g = Graph.from_edges(edges(spark, FAR)).map_vertices(lambda i, _: i % 100)
    got = dict(g.send_along(lambda d, a, k: a * 10 + k, F.sum).collect())
    degree, want = {-5: 3, 2**33 + 5: 1, 2**62: 1}, {}
    mod = lambda i: i % 100 if i >= 0 else -(-i % 100)
    for a, b in FAR:
        want[b] = want.get(b, 0) + mod(a) * 10 + degree[a]
    assert got == want
    moved = dict(g.send_along(lambda d, a, k: F.lit(1), F.sum, target=lambda d, a, k: d + 1).collect())
    assert moved == {b + 1: sum(y == b for _, y in FAR) for b in {y for _, y in FAR}}
    up = lambda s, a, d, b: [(a < b, d, a), (b < a, s, b)]
    small = Graph.from_edges(edges(spark, M1)).map_vertices(lambda i, _: i)
    assert dict(small.send_between(up, F.min).collect()) == {2: 1, 3: 1, 4: 3}
    active = spark.createDataFrame([(4,), (4,), (77,)], "id long")
    assert dict(small.send_between(up, F.min, active=active).collect()) == {4: 3}
    plain = small.send_between(lambda s, a, d, b: [(F.lit(True), d, a)], F.max, needs_target=False)
    assert dict(plain.collect()) == {1: 3, 2: 1, 3: 4}
    assert rows(messages.active_destinations(small.edges, active)) == [(3,)]
    product = messages.reduce_pairwise(lambda x, y: x * y)
    assert dict(small.send_along(lambda d, a, k: a, product).collect()) == {1: 3, 2: 1, 3: 8}


@pytest.mark.parametrize(
    ("pairs", "n", "want"),
    [
        (M1, 0, {1: 0.15, 2: 0.15, 3: 0.15, 4: 0.15}),
        (M1, 1, {1: 0.2775, 2: 0.21375, 3: 0.46875, 4: 0.15}),
        (M1, 3, {1: 0.640556, 2: 0.383086, 3: 0.738333, 4: 0.15}),
        (M1, 12, None),
        (M2, 1, {1: 0.2775, 2: 0.235, 3: 0.1925}),
        (M2, 2, {1: 0.34975, 2: 0.30725, 3: 0.228625}),
    ],
)
def test_pagerank(spark, pairs, n, want):
    got = {r.id: round(r.attr, 6) for r in pagerank(Graph.from_edges(edges(spark, pairs)), n).vertices.collect()}
    if want is None:
        rank = dict.fromkeys((1, 2, 3, 4), 0.15)
        degree = {a: sum(x == a for x, _ in pairs) for a, _ in pairs}
        for _ in range(n):
            rank = {v: 0.15 + 0.85 * sum(rank[a] / degree[a] for a, b in pairs if b == v) for v in rank}
        want = {v: round(r, 6) for v, r in rank.items()}
    assert got == want
    if 0 < n < 4:
        g = Graph.from_edges(edges(spark, pairs), F.lit(1.0))
        again = scatter_gather(g, 0.0, lambda _, __, m: F.lit(0.15) + F.lit(0.85) * m, lambda _, a, k: a / k, F.sum, n)
        assert {r.id: round(r.attr, 6) for r in again.vertices.collect()} == want


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([(1, 10), (10, 20), (5, 20)], {1: 1, 10: 1, 20: 1, 5: 1}),
        ([(1, 2), (2, 3), (3, 1), (4, 5)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}),
        ([(7, 7)], {7: 7}),
        (FAR, {-5: -5, 2**33 + 5: -5, 2**62: -5}),
        ([(i, i + 1) for i in range(40)], dict.fromkeys(range(41), 0)),
    ],
)
def test_components(spark, pairs, want):
    g = Graph.from_edges(edges(spark, pairs))
    assert dict(connected_components(g).vertices.collect()) == want
    if len(pairs) < 10:
        least = lambda _, a, m: F.least(a, m)
        send = lambda s, a, d, b: [(a < b, d, a), (b < a, s, b)]
        again = scatter_gather_between(g.map_vertices(lambda i, _: i), 2**63 - 1, least, send, F.min)
        assert dict(again.vertices.collect()) == want
        assert sum(r.n for r in component_sizes(g).collect()) == len(want)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-8, 30), st.integers(-8, 30)), max_size=40))
def test_components_of_random_graphs(spark, pairs):
    parent = {v: v for p in pairs for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(connected_components(Graph.from_edges(edges(spark, pairs).repartition(3))).vertices.collect())
    assert got == {v: root(v) for v in parent}


def test_partition_numbers(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 7, 2**33 + 5, -5, 2**62, -(2**63))] + [(None,)], "id long")
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    low = lambda x: (x + 2**31) % 2**32 - 2**31
    for r in ids.select("id", edge_partition_1d("id", 4).alias("e"), hash_partition("id", 4).alias("h")).collect():
        if r.id is None:
            assert r.h == 0
            continue
        assert r.e == abs(wrap(r.id * 1125899906842597)) % 4
        folded = low((r.id ^ ((r.id % 2**64) >> 32)) % 2**64)
        assert r.h == abs(wrap(folded * 1125899906842597)) % 4
    placed = edges(spark, [(1, 2), (2, 1), (1, 1)])
    assert rows(partitioning.routing_flags(placed, F.col("src").cast("int"))) == [(1, 1, 3), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    sizes = partitioning.partition_sizes(partitioning.partition_by_source(edges(spark, M1 * 4), 3))
    assert sum(r.n for r in sizes.collect()) == 20
    v = keyed.vertices_from_edges(placed, 9)
    assert rows(partitioning.ship_to_targets(v, placed, F.col("src").cast("int"))) == [(1, 1, 9), (1, 2, 9), (2, 1, 9)]


def test_persistence(spark):
    g = Graph.from_edges(edges(spark, M1)).cache()
    assert g.edges.storageLevel == StorageLevel.MEMORY_AND_DISK and g.vertices.is_cached
    g.unpersist_vertices()
    assert not g.vertices.is_cached and g.edges.is_cached
    g.unpersist()
    assert not g.edges.is_cached


def test_results_do_not_depend_on_partitions(spark):
    one = Graph.from_edges(edges(spark, M1 * 3).coalesce(1))
    many = Graph.from_edges(edges(spark, M1 * 3).repartition(7))
    send = lambda _, a, k: a * k
    assert rows(one.send_along(send, F.sum)) == rows(many.send_along(send, F.sum))


def test_components_of_the_whole_seq_graph(spark):
    from pathlib import Path

    from vertexloom import catalog

    where = "/root/testdata/sf0.001"
    if not Path(where).is_dir():
        pytest.skip("the driver's tables are not here")
    edges = catalog.seq_edges(spark, where)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in edges.collect():
        a, b = sorted((root(r.src), root(r.dst)))
        parent[b] = a
    got = catalog.algorithms.connected_components(catalog.Graph.from_edges(edges)).vertices
    assert {r.id: r.attr for r in got.collect()} == {x: root(x) for x in list(parent)}


def brute_ranks(pairs, n):
    degree, ids = {}, {x for p in pairs for x in p}
    for a, _ in pairs:
        degree[a] = degree.get(a, 0) + 1
    rank = dict.fromkeys(ids, 0.15)
    for _ in range(n):
        into = dict.fromkeys(ids, 0.0)
        for a, b in pairs:
            into[b] += rank[a] / degree[a]
        rank = {i: 0.15 + 0.85 * into[i] for i in ids}
    return {i: round(r, 9) for i, r in rank.items()}


def test_pagerank_with_a_hub(spark):
    pairs = [(0, i) for i in range(1, 60)] + [(i, 0) for i in range(1, 60, 3)] + [(i, i + 1) for i in range(1, 20)] + [(0, 5), (0, 5)]
    got = {r.id: round(r.attr, 9) for r in pagerank(Graph.from_edges(edges(spark, pairs)), 4).vertices.collect()}
    assert got == brute_ranks(pairs, 4)


def test_a_superstep_has_one_shuffle(spark):
    placed = spark.range(1000).select((F.col("id") % 50).alias("src"), (F.col("id") % 77).alias("dst"), F.lit(20.0).alias("out_degree")).repartition(4, "src").persist()
    sums = placed.groupBy(F.col("dst").alias("id")).agg(F.sum("out_degree").alias("s"))
    step = lambda s: rank_shares(placed, s, 0.15).groupBy("id").agg(F.sum("share").alias("s"))
    placed.count()
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shuffles = [f._jdf.queryExecution().executedPlan().toString() for f in (sums, step(sums))]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        placed.unpersist()
    moved = [len(re.findall(r"Exchange hashpartitioning\((?!src#)", x)) for x in shuffles]  # by another column than the source
    assert moved == [1, 2]


def test_the_state_of_many_edges_does_not_overflow(spark):
    n, h = components._state(spark.range(1 << 25).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert n == 1 << 25 and h is not None


def test_lookup_and_visits(spark, tmp_path, caplog):
    g = Graph.from_edges(edges(spark, M2))
    assert g.lookup(2) == 1 and g.is_defined(3) and not g.is_defined(9)
    with pytest.raises(KeyError):
        g.lookup(9)
    seen = str(tmp_path)

    def note(batches):
        import uuid

        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(b.num_rows for b in batches)))

    g.visit_edges(note)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 4
    write_edge_list(edges(spark, M1), str(tmp_path / "list"))
    with caplog.at_level("INFO"):
        loaded = Graph.from_edge_list(spark, str(tmp_path / "list"), eager=True)
    assert "5 edges of" in caplog.text and loaded.num_edges() == 5
    loaded.unpersist()


def test_names_that_clash(spark):
    left = spark.createDataFrame([(1, 2, 3, 4)], "id long, attr int, other int, hit int")
    right = spark.createDataFrame([(1, 5)], "id long, attr int")
    assert fresh(["A", "_a"], "a", "b") == ("__a", "b")
    assert rows(keyed_joins.left_join(left, right, lambda _, a, u, hit: F.when(hit, a + u))) == [(1, 7, 3, 4)]
    assert rows(keyed_joins.inner_join(left, right, lambda _, a, u: a * u)) == [(1, 10, 3, 4)]


def test_counts_in_one_pass(spark):
    assert rows(Graph.from_edges(edges(spark, M2)).counts()) == [(3, 4, 2)]
    assert rows(Graph.from_edges(edges(spark, [])).counts()) == [(0, 0, 0)]
    loose = spark.createDataFrame([(1, 2, 1), (None, 2, 1)], "src long, dst long, attr int")
    assert rows(Graph.from_edges(loose).counts()) == [(3, 2, 1)]  # as in SQL null is a row of the union, but no distinct source


@pytest.mark.parametrize("kind", ["bip_edges", "seq_edges", "sparse_edges"])
def test_partitions_of_edges_grow_with_the_lines(spark, tmp_path, monkeypatch, kind):
    from vertexloom import catalog

    line = "id as l_orderkey", "id % 7 as l_partkey", "id % 5 as l_suppkey", "1 as l_linenumber", "50d as l_quantity", "0.1d as l_discount"
    spark.range(1000).selectExpr(*line).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(300).selectExpr("id as o_orderkey", "id % 9 as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(partitioning.parts_for, "__defaults__", (50,))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = getattr(catalog, kind)(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() == 20  # adaptive execution would merge them to one
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_supersteps_do_not_sort_kept_edges(spark):
    from vertexloom.plans.algorithms import _placed

    pairs = [(i % 50, i % 77) for i in range(1000)] + [(3, 4)] * 5
    placed = _placed(edges(spark, pairs).select("src", "dst"), 4).persist()
    want = {p: sum(a == p[0] for a, _ in pairs) / pairs.count(p) for p in set(pairs)}
    assert {(r.src, r.dst): r.out_degree for r in placed.collect()} == want
    sums = spark.range(50).select("id", F.lit(0.5).alias("s"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1")):
            spark.conf.set(k, v)
        text = plan(rank_shares(placed, sums, 0.15)).split("InMemoryRelation")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        placed.unpersist()
    assert "Sort [src" not in text and not re.search(r"Exchange hashpartitioning\(src", text) and "SortMergeJoin" in text


@pytest.mark.parametrize("name", ["pagerank_5", "scatter_gather_ranks", "scatter_gather_components", "connected_components", "component_sizes"])
def test_iterations_get_edges_that_are_written(spark, monkeypatch, name):
    iterated_on_files(spark, monkeypatch, name)


def iterated_on_files(spark, monkeypatch, name):
    from pathlib import Path

    from vertexloom import catalog

    if not Path("/root/testdata/sf0.001").is_dir():
        pytest.skip("the driver's tables are not here")
    seen = []

    def stop(g, *_, **__):
        seen.append(plan(g.edges) + plan(g.vertices))
        raise InterruptedError

    for module, f in ((catalog.algorithms, "pagerank"), (catalog.algorithms, "connected_components"), (catalog.algorithms, "component_sizes"), (catalog.iteration, "scatter_gather"), (catalog.iteration, "scatter_gather_between")):
        monkeypatch.setattr(module, f, stop)
    with pytest.raises(InterruptedError):
        catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen and "Window" not in seen[0]
