"""Buckets with hubs against union-find over all pairs."""
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, linking


def test_components(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 90)] + [(7, 7), (-5, 1 << 50)]
    comp = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            comp[b] = a
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (1 << 20, 0):
        monkeypatch.setattr(common, "FEW_EDGES", few)
        assert {r.id: r.comp for r in common.components(df).collect()} == {x: root(x) for x in comp}
        assert common.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("slice_, wide, few", [(512, 1 << 22, 0), (4, 1 << 22, 1 << 20), (4, 8, 1 << 20)])
def test_buckets_go_by_hubs_and_signatures(spark, monkeypatch, slice_, wide, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    monkeypatch.setattr(linking, "SLICE", slice_)
    monkeypatch.setattr(linking, "WIDE", wide)
    members = {1: list(range(0, 60)), 2: list(range(100, 130)) + [300], 3: [5, 300], 4: [400, 401], 5: [7], 6: [500, 510, 511, 540, 541, 700]}
    rows = spark.createDataFrame([(b, i) for b, ids in members.items() for i in ids], "bucket long, id long")
    ids = sorted({i for m in members.values() for i in m})
    marks = {i: b"".join((b if i in m else 1000 * i + b).to_bytes(4, "little") for b, m in members.items()) for i in ids}
    sigs = spark.createDataFrame([(i, bytearray([i // 100] * 16) + marks[i]) for i in ids], "id long, sig binary")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.filter((F.abs(F.col("a") - F.col("b")) <= 25) | (F.col("b") == 401))

    got = {r.id: r.comp for r in linking.groups_of(rows, sigs, verify, 0.9, "test", None, 6).collect()}
    want = {i: 0 for i in range(60)} | {i: 100 for i in range(100, 130)} | {400: 400, 401: 400} | {500: 500, 510: 500, 511: 500, 540: 540, 541: 540}
    assert got == want
    given = spark.createDataFrame([(7, 700)], "a long, b long")
    assert {r.id: r.comp for r in linking.groups_of(rows, sigs, verify, 0.9, "test", given, 6).collect()} == want | {700: 0}
