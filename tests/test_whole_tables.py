"""Queries over whole tables against plain Python on the smallest tables: no row is left out by its id."""
import os

import pyarrow.parquet as pq
import pytest

from lodestone.plans import registry

SMALL = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"  # sf0.001 has 200 parts only
STEPS = {"view": 1, "click": 2, "purchase": 3}
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def read(name, *cols, folder=SMALL):
    return pq.read_table(f"{folder}/{name}.parquet", columns=list(cols)).to_pylist()


def run(spark, name, folder=SMALL):
    return registry.QUERIES[name](spark, folder).collect()


def test_q18(spark):
    want = {d["doc_id"]: "\n".join(d["text"].split("\n")[1:4]) for d in read("documents", "doc_id", "text") if d["text"] and "\n" in d["text"]}
    assert {r.doc_id: r.src_window for r in run(spark, "q18_show_symbol")} == want and max(want) >= 50


def test_l16(spark):
    want = {}
    for p in read("part", "p_partkey", folder=MORE):
        a = p["p_partkey"]
        while a % 5:
            a //= 3
        want[p["p_partkey"]] = a
    assert {r.child: r.owner for r in run(spark, "l16_inherited_calls", MORE)} == want


def test_c11(spark):
    seen = {}
    for e in read("events", "user_id", "event_type", "ts"):
        if e["event_type"] in STEPS:
            seen.setdefault(f"{e['user_id']}:{e['ts'].day}", set()).add(STEPS[e["event_type"]])
    want = {u: ",".join(str(i) for i in range(1, max(s) + 1) if i not in s) for u, s in seen.items()}
    assert {r.name: r.missing for r in run(spark, "c11_protocol")} == {u: m for u, m in want.items() if m}


def test_h3(spark):
    revs = {}
    for e in read("events", "ts", "event_type", "user_id"):
        revs.setdefault(e["event_type"] + str(e["user_id"]), set()).add(e["ts"].day)
    assert {r.line: (r["first"], r["last"]) for r in run(spark, "h3_blame")} == {k: (min(v), max(v)) for k, v in revs.items()}


def test_flows(spark):
    owner = {o["o_orderkey"]: o["o_custkey"] for o in read("orders", "o_orderkey", "o_custkey")}
    deps, calls = {}, {}
    for x in read("lineitem", "l_orderkey", "l_suppkey", "l_partkey"):
        calls.setdefault(x["l_suppkey"], set()).add(x["l_partkey"])
        if x["l_orderkey"] in owner:
            deps.setdefault(owner[x["l_orderkey"]], set()).add(x["l_suppkey"])
    parts = {c: set().union(*(calls[s] for s in d)) for c, d in deps.items()}
    want = {f"Customer.{c}": len(parts[c]) + len(d) for c, d in deps.items()}
    assert {r.root: r.reach for r in run(spark, "f1_flows")} == want
    assert {r.name: r.reach for r in run(spark, "f2_rank")} == want
    assert {r.root for r in run(spark, "f6_through")} == {f"Customer.{c}" for c, p in parts.items() if 5 in p}
