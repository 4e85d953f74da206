"""Property comparison, sources, snapshots and streaming."""
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import query, rules, snapshots
from lodestone.sources import text
from lodestone.streaming import incremental

CASES = [("0.138.0", "lt", "0.150", True), ("v1.9", "lt", "v1.10", True), ("9", "lt", "10", True), ("b", "gt", "a", True), ("1.0", "ge", "1.0.0", True), ("x", "eq", "x", True),
         ("x", "ne", "y", True), ("abc", "prefix", "ab", True), ("abc", "contains", "d", False), ("10", "le", "9.5", False), ("true", "eq", "true", True)]


@pytest.mark.parametrize("got,op,want,result", CASES)
def test_comparison(spark, got, op, want, result):
    assert spark.createDataFrame([(got,)], "v string").select(query.holds(F.col("v"), op, want)).first()[0] is result


def test_list_matches_any_element(spark):
    d = spark.createDataFrame([(["a", "b"],), ([],)], "v array<string>")
    assert [r[0] for r in d.select(query.holds(F.col("v"), "eq", "b", True)).collect()] == [True, False]
    lists = spark.createDataFrame([(["a", "b"],), (["a"],), (None,)], "v array<string>")
    assert [r[0] for r in lists.select(query.holds(F.col("v"), "eq", "[a b]", True)).collect()] == [True, False, False]


def test_globs_and_names(spark):
    d = spark.createDataFrame([("a/b/c.py",), ("c.py",), ("a/test_x.py",), ("x.{a}",)], "p string")
    assert [r[0] for r in d.select(scalars.matches_glob(F.col("p"), ["**/*.py"])).collect()] == [True, True, True, False]
    assert [r[0] for r in d.select(scalars.is_test_path(F.col("p"))).collect()] == [False, False, True, False]
    w = spark.createDataFrame([("policies",), ("boxes",), ("bus",), ("parts",)], "w string")
    assert [r[0] for r in w.select(scalars.singular(F.col("w"))).collect()] == ["policy", "box", "bus", "part"]


def test_sources(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text("import os\nclass A(B):\n    def m(self):\n        for x in y:\n            if x: self.f(x)\n")
    (tmp_path / "pkg/bad.py").write_text("def (:\n")
    (tmp_path / "x.proto").write_text("service S {\n  rpc Get (A) returns (B);\n}\n")
    files = text.walk(spark, f"file://{tmp_path}", ["**/skip/**"])
    py = {r.name: r for r in text.extract_python(files).collect()}
    assert py["pkg.bad"].kind == "extraction" and py["pkg.a.A.m"].loop_depth == 1 and py["pkg.a.A.m"].cyclomatic == 3
    assert ("calls", "self.f") in {tuple(r) for r in py["pkg.a.A.m"].relations} and ("implements", "B") in {tuple(r) for r in py["pkg.a.A"].relations}
    assert ("Get", 2, "proto") in {(r.name, r.line, r.language) for r in text.extract_lines(files).collect()}
    last = text.manifest(files)
    assert text.changed(files, last).count() == 0 and text.drift(files, files.filter("path <> 'x.proto'")).collect()[0].drift == "removed"


def test_jsonl_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("r", "symbol", "n", "f", 1, 2, None, None, False, {"a": '"x"'}, [("calls", "t", None)], "id")], text.FACTS)
    text.write_jsonl(f, str(tmp_path / "facts"))
    assert text.read_jsonl(spark, str(tmp_path / "facts")).collect() == f.collect()


def test_patches(spark):
    old = spark.createDataFrame([("a",), ("a",), ("b",)], "line string")
    new = spark.createDataFrame([("a",), ("c",), ("c",)], "line string")
    p = snapshots.patch(old, new)
    assert sorted(map(tuple, p.collect())) == [("a", "-", 1), ("b", "-", 1), ("c", "+", 2)]
    assert sorted(map(tuple, snapshots.apply_patch(old, p).collect())) == [("a", 1), ("c", 2)]
    with pytest.raises(Exception, match="wrong parent"):
        snapshots.apply_patch(new, p).collect()


def test_moved_facts_are_unchanged(spark):
    s = "kind string, name string, v int"
    old = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("k", "b", 1)], s)
    new = spark.createDataFrame([("k", "a", 1), ("k", "a", 3), ("k", "c", 1)], s)
    got = {(r.name, r.change) for r in snapshots.diff_facts(old, new, ["kind", "name"], ["v"]).collect()}
    assert got == {("a", "changed"), ("b", "removed"), ("c", "added")}


def test_protocol_needs_lower_steps(spark):
    d = spark.createDataFrame([("x", 1), ("x", 3), ("y", 1), ("y", 2)], "name string, step int")
    assert [tuple(r) for r in rules.protocol(d).collect()] == [("x", 3, "2")]


def test_streams(spark, tmp_path):
    spark.range(6).selectExpr("id", "timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int)) as ts", "'click' as event_type").write.parquet(str(tmp_path / "in"))
    schema = "id long, ts timestamp, event_type string"
    q = incremental.reextract(spark, str(tmp_path / "in"), schema, lambda d: d.filter("id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert incremental.windowed_counts(spark.read.parquet(str(tmp_path / "in"))).count() == 6
    assert os.path.isdir(tmp_path / "ck")
