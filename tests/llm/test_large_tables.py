"""Joins with tables too large to be broadcast: the same rows, and texts are neither sorted nor all shuffled."""
import random

from pyspark.sql import functions as F

from lodestone.llm import common, line_dedup


def corpus(spark):
    rng = random.Random(5)
    words = [f"word{i:03d}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(120)]
    rows = []
    for i in range(150):
        lines = rng.choices(base, k=rng.randint(0, 6)) + [" ".join(rng.choices(words, k=9)) for _ in range(3)]
        rows.append((i, "\n".join(x.replace("word1", "w0rd1", 1) if rng.random() < 0.2 else x for x in lines)))
    return spark.createDataFrame([*rows, (None, base[0]), (7, base[1])], "doc_id long, text string")


def test_sieve_keeps_all_that_is_wanted_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    ids = common.materialize(spark.range(300).select(F.xxhash64("id").alias("id")), "t")
    rows = spark.range(20_000).select(F.xxhash64(F.col("id") % 5000).alias("id"), F.col("id").alias("n"))
    assert common.sieved(rows, ids, "id").count() < 1300
    got = common.having(rows, ids, "id")
    assert {r.n for r in got.collect()} == {n for n in range(20_000) if n % 5000 < 300} and got.columns == ["id", "n"]
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert len(joins) == 2 and "_bits" not in joins[0] and "_bits" in joins[1]  # the sieve lies below the join that shuffles


def test_lines_are_removed_alike_without_broadcasts(spark, monkeypatch):
    docs = corpus(spark)
    want = sorted(map(tuple, line_dedup.without_repeated_lines(docs).collect()), key=str)
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    assert sorted(map(tuple, line_dedup.without_repeated_lines(docs).collect()), key=str) == want
    lists = line_dedup.removed_lines(docs)
    plan = line_dedup.cut(docs, lists)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
