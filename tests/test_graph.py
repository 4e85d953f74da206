"""Graph operators on hand-made graphs against plain Python."""
from collections import deque

import pytest

from lodestone.operators import analyses, graph

EDGES = {
    "two_cycle": [("a", "b"), ("b", "a"), ("b", "c")],
    "self_loop": [("a", "a"), ("a", "b")],
    "ring9": [(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)] + [("n0", "z"), ("y", "n3")],
    "two_rings": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c")],
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y")],
}


def table(spark, edges):
    return spark.createDataFrame([(a, "calls", b) for a, b in edges], "src string, rel string, dst string")


def reach(edges, start):
    seen, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for a, b in edges:
            if a == x and b not in seen:
                seen[b] = seen[x] + 1
                todo.append(b)
    return seen


def components(edges):
    nodes = {x for e in edges for x in e}
    out = {}
    for x in nodes:
        both = {y for y in reach(edges, x) if x in reach(edges, y)}
        if len(both) > 1:
            out[x] = min(both)
    return out


@pytest.mark.parametrize("name", EDGES)
def test_components_and_walks(spark, name):
    e = table(spark, EDGES[name])
    assert {r.key: r.component for r in graph.strongly_connected(e).collect()} == components(EDGES[name])
    seeds = spark.createDataFrame([("a",), ("n0",)], "key string")
    want = {}
    for s in ("a", "n0"):
        for k, d in reach(EDGES[name], s).items():
            want[k] = min(d, want.get(k, d))
    assert {r.key: r.depth for r in graph.traverse(e, seeds, 20).collect()} == want


def test_depth_is_capped(spark):
    e = table(spark, [(f"{i:02}", f"{i + 1:02}") for i in range(25)])
    got = graph.traverse(e, spark.createDataFrame([("00",)], "key string"), 99)
    assert got.count() == 21


def test_paths_break_ties_by_name(spark):
    e = table(spark, EDGES["diamond"])
    key = lambda *n: spark.createDataFrame([(x,) for x in n], "key string")
    assert [(r.key, r.hops, list(r.path)) for r in graph.shortest_paths(e, key("a"), key("d", "y")).collect()] == [("d", 2, ["a", "b", "d"])]


def test_longest_chain_weighs_components(spark):
    got = {r.component: r.length for r in graph.longest_chains(table(spark, EDGES["two_cycle"])).collect()}
    assert got == {"a": 3, "c": 1}
    assert {r.component: r.length for r in graph.longest_chains(table(spark, EDGES["ring9"])).collect()} == {"n0": 0, "y": 1, "z": 1}


def test_names_split_by_repository(spark):
    facts = spark.createDataFrame([("T", "r1"), ("T", "r2"), ("u", "r1"), ("v", "r3")], "name string, repo string")
    e = spark.createDataFrame([("u", "calls", "T"), ("v", "calls", "T")], "src string, rel string, dst string")
    assert {(r.src_key, r.dst_key) for r in graph.keyed_edges(e, facts).collect()} == {("u", "repo:r1 T"), ("v", "repo:r1 T"), ("v", "repo:r2 T")}


def test_innermost_span(spark):
    spans = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 10, 20, "inner"), ("f", 12, 14, "deep"), ("g", 5, 5, "one")], "file string, start_line long, end_line long, name string")
    points = spark.createDataFrame([("f", 13), ("f", 18), ("f", 70), ("f", 101), ("g", 5)], "file string, line long")
    assert {(r.file, r.line): r.name for r in graph.nested_spans(points, spans).collect()} == {("f", 13): "deep", ("f", 18): "inner", ("f", 70): "outer", ("g", 5): "one"}


def test_same_result_at_any_partitioning(spark):
    e = table(spark, EDGES["ring9"] + EDGES["two_rings"])
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, graph.strongly_connected(e).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_outliers_use_the_population(spark):
    d = spark.createDataFrame([(f"k{i}", 1, 1) for i in range(30)] + [("hub", 40, 9)], "key string, fan_in long, fan_out long")
    assert [r.key for r in analyses.hotspots(d).collect()] == ["hub"] == [r.key for r in analyses.god_classes(d).collect()]
