"""Diffs, OpenAPI, manifests, binders and findings on small cases worked out by hand."""
import json
import os

from lodestone.operators import analyses, binders, findings, graph, links, snapshots
from lodestone.sources import formats

PATCH = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,4 +1,5 @@ def f
 one
--- not a header
+++ neither
+two
 three
 four
\\ No newline at end of file
@@ -10 +11,0 @@
-gone
--- a/old/name.py
+++ b/new/name.py
@@ -0,0 +1,2 @@
+a
+b
-- trailing text
+++ text after the hunks"""


def test_unified_diff(spark):
    got = formats.diff_lines(spark.createDataFrame([(1, PATCH), (2, "no diff at all\n+x"), (3, None)], "patch int, body string")).collect()
    assert sorted((r.patch, r.file, r.side, r.line) for r in got) == [
        (1, "new/name.py", "new", 1), (1, "new/name.py", "new", 2), (1, "x.py", "new", 2), (1, "x.py", "new", 3), (1, "x.py", "old", 2), (1, "x.py", "old", 10)]


def test_openapi(spark):
    body = {"swagger": "2.0", "basePath": "/api/", "paths": {"/a/{id}": {"get": {"operationId": "getA"}, "parameters": [], "PATCH": {}}, "/b": {"x-note": "no verb"}}}
    text = "openapi: 3.0.0\nservers:\n  - url: https://h.example/v2\npaths:\n  /c:\n    post:\n      operationId: makeC\n"
    files = spark.createDataFrame([("a.json", json.dumps(body)), ("b.yaml", text), ("c.yml", "a: [1"), ("d.json", "{}"), ("e.json", None)], "path string, body string")
    got = formats.openapi_routes(formats.as_json(files)).collect()
    assert sorted((r.file, r.method, r.path, r.handler or "") for r in got) == [("a.json", "GET", "/api/a/{id}", "getA"), ("a.json", "PATCH", "/api/a/{id}", ""), ("b.yaml", "POST", "/v2/c", "makeC")]


def test_manifests(spark):
    files = spark.createDataFrame([
        ("w/package.json", json.dumps({"dependencies": {"react": "^18"}, "devDependencies": {"jest": "29"}, "peerDependencies": {"vue": "*"}})), ("go.mod", "module example.org/m\n\ngo 1.22\nrequire (\n\texample.org/a v1.2.3\n\texample.org/b v0.1.0 // indirect\n)\n"),
        ("requirements.txt", "# x\nFlask>=2.0,<3 ; python_version > '3'\n-r more.txt\nplain\n"), ("Cargo.toml", "[package]\nname = \"n\"\n[dependencies]\nserde = \"1.0\"\n[dev-dependencies]\nrand = { version = \"0.8\" }\n"), ("other.txt", "x==1")], "path string, body string")
    got = sorted((r.ecosystem, r.name, r.version, r.scope) for r in formats.manifest_dependencies(files).collect())
    assert got == [("crates", "rand", "0.8", "dev"), ("crates", "serde", "1.0", "runtime"), ("go", "example.org/a", "v1.2.3", "runtime"), ("go", "example.org/b", "v0.1.0", "indirect"), ("npm", "jest", "29", "dev"),
                   ("npm", "react", "^18", "runtime"), ("npm", "vue", "*", "peer"), ("pypi", "flask", ">=2.0,<3", "runtime"), ("pypi", "plain", "", "runtime")]


def test_paths(spark):
    cases = {"/devices/{id}.json": "/devices/{}", "/devices/:id": "/devices/{}", "/v2.5/a.xml": "/v2.5/a", "/a.json/b": "/a.json/b", "/orders/42/": "/orders/42", "/x/<int:id>": "/x/{}", "/[...rest]": "/{}",
             " /a/b// ": "/a/b", "/": "/", "": "", "/page.html": "/page.html", "/.json": "/.json"}
    df = spark.createDataFrame(list(cases.items()), "path string, want string")
    assert [r for r in df.select("path", "want", links.normalise_path(df.path).alias("got")).collect() if r.got != r.want] == []


def test_handlers(spark):
    symbols = spark.createDataFrame([("pkg.Users.list", "r", "app.Users.list"), ("pkg.Orders.show", "r", None), ("other.Orders.show", "r", None), ("pkg.solo", "r", None), ("pkg.solo", "q", None)], "name string, repo string, fqn string")
    routes = spark.createDataFrame([(1, "r", "app.Users.list"), (2, "r", "h.show"), (3, "r", "mux#solo"), (4, "r", "pkg.Orders.show"), (5, "q", "app.Users.list"), (6, "r", None), (7, "r", "")], "route int, repo string, handler string")
    assert {r.route: r.target for r in binders.handled_by(routes, symbols).collect()} == {1: "pkg.Users.list", 3: "pkg.solo", 4: "pkg.Orders.show"}


def test_import_aliases(spark):
    imports = spark.createDataFrame([(x,) for x in ("example.org/m/pkg/a", "example.org/m", "@s/lib/deep/x", "@s/lib/deep", "org.acme.Client.connect", "org.acme.Twice", "none", None)], "target string")
    modules = spark.createDataFrame([("example.org/m", "pkg/a", "A"), ("example.org/m", "", "ROOT")], "path string, dir string, key string")
    packages = spark.createDataFrame([("@s/lib", "LIB"), ("@s/lib/deep", "DEEP")], "package string, key string")
    types = spark.createDataFrame([("org.acme.Client", "C"), ("org.acme.Twice", "T1"), ("org.acme.Twice", "T2")], "fqn string, key string")
    got = {r.target: (r.via, r.key) for r in binders.import_aliases(imports, modules, packages, types).collect()}
    assert got == {"example.org/m/pkg/a": ("module", "A"), "example.org/m": ("module", "ROOT"), "@s/lib/deep/x": ("package", "DEEP"), "@s/lib/deep": ("package", "DEEP"), "org.acme.Client.connect": ("type", "C")}


def test_inherited(spark):
    parents = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "child string, parent string")
    children = spark.createDataFrame([("d",), ("a",), ("x",)], "child string")
    own = spark.createDataFrame([("b",), ("a",)], "name string")
    assert {r.child: r.owner for r in links.inherited(children, parents, own).collect()} == {"d": "b", "a": "a"}


def test_outliers_count_symbols_without_edges(spark):
    symbols = spark.range(100).selectExpr("concat('s', id) as key")
    degrees = spark.createDataFrame([("s1", 30, 0), ("s2", 9, 1), ("elsewhere", 500, 0)], "key string, fan_in int, fan_out int")
    got = {r.key for r in analyses.god_classes(analyses.population(symbols, degrees)).collect()}
    values = [30, 9] + [0] * 98
    mean = sum(values) / 100
    assert got == {k for k, v in (("s1", 30), ("s2", 9)) if v > mean + 2 * (sum((x - mean) ** 2 for x in values) / 100) ** 0.5}


def test_components_of_known_graphs(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    edges = ring + [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "r3"), ("self", "self"), ("lead", "a"), ("r5", "tail"), ("p", "q"), ("q", "s"), ("s", "p"), ("q", "p")]
    got = {r.key: r.component for r in graph.strongly_connected(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {f"r{i}": "r0" for i in range(9)} | {"a": "a", "b": "a", "c": "c", "d": "c", "p": "p", "q": "p", "s": "p"}
    loops = {r.key: r.cycle for r in graph.shortest_cycles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert loops == {f"r{i}": 9 for i in range(9)} | {"a": 2, "b": 2, "c": 2, "d": 2, "self": 1, "p": 2, "q": 2, "s": 3}
    assert graph.strongly_connected(spark.createDataFrame([("a", "b")], "src string, dst string")).count() == 0
    got = {(r.src, r.dst) for r in graph.reached(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("c",), ("tail",), ("p",)], "src string")).collect()}
    assert got == {("c", x) for x in ["c", "d", "tail", *[f"r{i}" for i in range(9)]]} | {("p", x) for x in "pqs"}


def test_findings_and_sinks(spark, tmp_path):
    rows = [("cycles", "Cycle of 3  modules", 0.95, False, "a/x.go", 3, "shop"), ("dead-code", "Nothing uses f", 0.6, False, "a/y.go", 0, "shop"), ("loops", "Depth 4", 0.9, True, None, None, "billing")]
    t = spark.createDataFrame(rows, "source string, title string, confidence double, informational boolean, file string, line long, repo string")
    assert findings.query_findings(t, "CYCLES", "", 0.5).count() == 1 and findings.query_findings(t, "", "SHO", 0.7).count() == 1
    findings.write_sarif(t, f"file://{tmp_path}/sarif")
    docs = [json.loads(x) for f in os.listdir(tmp_path / "sarif") if f.endswith(".txt") for x in open(tmp_path / "sarif" / f)]
    results = [r for d in docs for r in d["runs"][0]["results"]]
    assert {(r["ruleId"], r["ruleIndex"], r["level"]) for r in results} == {("cycles", 0, "error"), ("dead-code", 1, "warning"), ("loops", 2, "note")}
    assert all(d["version"] == "2.1.0" and len(d["runs"][0]["tool"]["driver"]["rules"]) == 3 for d in docs)
    findings.write_insights(t, f"file://{tmp_path}/insights")
    lines = [json.loads(x) for f in sorted(os.listdir(tmp_path / "insights")) if f.endswith(".json") for x in open(tmp_path / "insights" / f)]
    assert [x["source"] for x in lines] == ["cycles", "loops", "dead-code"] and lines[0]["evidence"][0]["file"] == "a/x.go"
    for n in (1, 2):
        findings.published(spark.range(n), f"file://{tmp_path}/out")
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == n
    assert sorted(os.listdir(tmp_path)) == ["insights", "out", "sarif"]


def test_walks_across_interfaces(spark):
    edges = spark.createDataFrame([("user", "calls", "I.run"), ("direct", "calls", "A.run"), ("far", "calls", "user"), ("A.run", "calls", "leaf"), ("x", "imports", "A.run")], "src string, rel string, dst string")
    members = spark.createDataFrame([("I", "I.run"), ("A", "A.run"), ("B", "B.run"), ("A", "A.stop")], "owner string, member string")
    hops = graph.dispatch_hops(spark.createDataFrame([("A", "I"), ("B", "I")], "type string, interface string"), members)
    assert {(r.src, r.dst) for r in hops.collect()} == {("A.run", "I.run"), ("B.run", "I.run")}
    seed = spark.createDataFrame([("A.run",)], "key string")
    walk = lambda *a, **k: {r.key: (r.depth, r.through_interface) for r in graph.traverse_dispatching(edges, *a, **k).collect()}
    assert walk(seed, hops, 5, True, ["calls"]) == {"A.run": (0, False), "direct": (1, False), "I.run": (1, True), "user": (2, False), "far": (3, False)}
    assert walk(seed, hops, 5, True, ["imports"]) == {"A.run": (0, False), "x": (1, False)}
    assert walk(spark.createDataFrame([("user",)], "key string"), hops, 3) == {"user": (0, False), "I.run": (1, False), "A.run": (2, True), "B.run": (2, True), "leaf": (3, False)}


def test_pruned_rules(spark):
    rules = [("a", "1", "b", "2", 10, 1.0), ("b", "2", "a", "1", 12, 1.0), ("a", "3", "a", "4", 9, 1.0), ("a", "5", "c", "5", 9, 0.9), ("c", "6", "d", "7", 5, 1.0), ("d", "7", "c", "6", 5, 1.0), ("e", "8", "f", "9", 7, 0.8), ("f", "9", "e", "8", 7, 1.0)]
    t = spark.createDataFrame(rules, "if_prop string, if_value string, then_prop string, then_value string, support long, confidence double")
    assert {(r.if_prop, r.then_prop) for r in snapshots.pruned_implications(t).collect()} == {("b", "a"), ("c", "d"), ("e", "f"), ("f", "e")}


def test_receipts_and_plans(spark):
    row = ("p", "r", "r", "1", "2", ["go", "js"], ["go", "py"], ["x"], ["x"], ["m"], ["n"])
    old = ("q", "r", "s", None, "2", ["go"], ["go"], ["x"], ["y"], ["m"], ["m"])
    fields = "pair string, was_repo string, now_repo string, was_version string, now_version string, was_extractors array<string>, now_extractors array<string>, was_globs array<string>, now_globs array<string>, was_members array<string>, now_members array<string>"
    got = {(r.pair, r.warning, r.blocking) for r in snapshots.comparability(spark.createDataFrame([row, old], fields)).collect()}
    assert got == {("p", "version", False), ("p", "extractor-lost", True), ("p", "extractor-new", False), ("p", "members", True), ("q", "repo", True), ("q", "pre-receipt", False), ("q", "globs", False)}
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert {r.name: r.verdict for r in snapshots.conformance(names("a", "b"), names("b", "c", "c")).collect()} == {"a": "untouched", "b": "kept", "c": "spilled"}


def test_folders_of_others_and_intent(spark):
    paths = ["third_party/z/LICENSE", "third_party/z/a.c", "third_party/z/sub/b.c", "third_party/LICENSE", "src/deps/g/p/COPYING.txt", "src/deps/g/p/q/x.c", "src/deps/g/p/q/LICENSE", "own/LICENSE", "licenses.go"]
    got = {(r.dir, r.licence, r.files) for r in analyses.vendored_candidates(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {("third_party/z", "LICENSE", 3), ("src/deps/g/p", "COPYING.txt", 3)}
    page = "---\ntitle: t\nintent:\n  owns:\n    - a/b\n    - c\n  empty:\nother:\n  owns:\n    - no\n---\nintent:\n  owns:\n    - no\n"
    files = spark.createDataFrame([("w/p.md", page), ("w/q.md", "# no front matter\n---\nintent:\n  owns:\n    - no\n---\n"), ("w/r.txt", page)], "path string, body string")
    assert sorted((r.page, r.section, r.entry, r.line) for r in formats.declared_intent(files).collect()) == [("w/p.md", "owns", "a/b", 5), ("w/p.md", "owns", "c", 6)]
