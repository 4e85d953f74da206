"""What a task holds and what is shuffled stays bounded: tables are dealt by their rows, and no row stands for a path."""
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as g
from lodestone.operators import links, snapshots
from lodestone.plans import adapter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("held, chunk", [(1 << 24, 1 << 20), (300, 5)])
def test_flow_reach_counts_unions(spark, monkeypatch, held, chunk):
    monkeypatch.setattr(snapshots, "HELD", held)
    monkeypatch.setattr(snapshots, "CHUNK", chunk)
    rng = random.Random(3)
    direct = {(f"r{rng.randrange(60)}", f"m{rng.randrange(40)}") for _ in range(500)} | {("alone", "nothing")}
    calls = {(f"m{rng.randrange(40)}", rng.choice("mxy") + str(rng.randrange(90))) for _ in range(900)} | {("m1", "m1"), ("other", "x1")}
    want = {}
    for root, key in direct:
        want.setdefault(root, set()).update({key}, (d for s, d in calls if s == key))
    twice = [*sorted(direct), *sorted(direct)[:20]]
    got = snapshots.flow_reach(spark.createDataFrame(twice, "root string, key string"), spark.createDataFrame(sorted(calls), "src string, dst string"), lambda c: F.substring(c, 1, 1))
    assert {(r["name"], r["reach"], r["modules"]) for r in got.collect()} == {(k, len(v), len({x[0] for x in v})) for k, v in want.items()}
    ranks = snapshots.flow_rank(got.withColumn("side", F.lit(False)).withColumn("kind", F.lit("route")))
    order = sorted(want, key=lambda k: (-len(want[k]), -len({x[0] for x in want[k]}), k))
    assert {(r["name"], r["rank"]) for r in ranks.collect()} == {(k, i + 1) for i, k in enumerate(order)}
    assert "SinglePartition" not in ranks._jdf.queryExecution().executedPlan().toString()


def test_edges_are_written_by_relation_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(adapter, "TASK_ROWS", 500)
    monkeypatch.setattr(adapter, "KEPT", {})
    t, before = adapter.Tables(spark, SF), spark.conf.get("spark.sql.shuffle.partitions")
    calls = t.edges_of("calls")
    assert [k[-1] for k in adapter.KEPT if k[-1] == "calls" or k[-1] == "depends_on"] == ["calls"]
    assert max(r["n"] for r in calls.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()) < 1000 < calls.count()
    assert sorted(calls.collect()) == sorted(t.part("edges").filter("rel = 'calls'").collect()) and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sorted(t.edges.collect()) == sorted(t.part("edges").collect()) and t.edges.columns == ["src", "rel", "dst"]


def test_joins_of_edges_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(g, "TASK_ROWS", 50)
    rng = random.Random(4)
    edges = sorted({(f"a{rng.randrange(50)}", rng.choice(["calls", "uses"]), f"b{rng.randrange(50)}") for _ in range(600)})
    e = spark.createDataFrame(edges, "src string, rel string, dst string")
    facts = spark.createDataFrame([(f"{x}{i}", f"r{i % 3}") for x in "ab" for i in range(50)] + [("b1", "r0"), ("b4", "r2")], "name string, repo string")
    assert g.keyed_edges(e, facts).rdd.getNumPartitions() >= len(edges) // 50
    owner = spark.createDataFrame([(f"{x}{i}", f"{x}/{i % 4}") for x in "ab" for i in range(45)], "name string, m string")
    rolled, own = links.roll_up(e, owner), {f"{x}{i}": f"{x}/{i % 4}" for x in "ab" for i in range(45)}
    want = {}
    for s, r, d in edges:
        if s in own and d in own and own[s] != own[d]:
            want[own[s], own[d], r] = want.get((own[s], own[d], r), 0) + 1
    assert {tuple(x)[:3]: x["n"] for x in rolled.collect()} == want
    assert "ShuffledHashJoin" in rolled._jdf.queryExecution().executedPlan().toString()


def test_degrees_keep_unnamed_ends_apart(spark):
    e = spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), ("b", "b")], "src string, dst string")
    assert sorted(map(tuple, g.degrees(e).collect()), key=str) == sorted([("a", 0, 2), ("b", 3, 1), (None, 1, 0), (None, 0, 1)], key=str)
