"""S rows read from bodies that are made of the tables, binders (L rows), and findings with their sinks (Q16, K2, K8)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyses as a
from ..operators import binders as b
from ..operators import findings as f
from ..operators import graph as g
from ..operators import links as ln
from ..operators import rules as c
from ..operators import snapshots as sn
from ..sources import code, formats
from .adapter import Tables, sql
from .registry import query

# ---- unified diffs: a patch for each supplier, by number a replacement, two added lines, or one beside every symbol ---

PATCHES = """SELECT s_suppkey AS patch, concat('--- a/', module, '/supplier.src', char(10), '+++ b/', module, '/supplier.src', char(10),
 CASE WHEN s_suppkey % 7 = 0 THEN concat('@@ -', s_suppkey * 10 + 6, ' +', s_suppkey * 10 + 6, ',2 @@', char(10), ' end', char(10), '+beside')
      WHEN s_suppkey % 4 = 0 THEN concat('@@ -', s_suppkey * 10, ',2 +', s_suppkey * 10, ',4 @@ class', char(10), ' a', char(10), '+--- x', char(10), '+++ y', char(10), ' b')
      ELSE concat('@@ -', s_suppkey * 10, ',3 +', s_suppkey * 10, ',3 @@', char(10), ' a', char(10), '-old', char(10), '+new', char(10), ' b', char(10), '-- signature') END) AS body
 FROM {supplier} s JOIN nat ON s.s_nationkey = nat.n_nationkey"""
LINES = """, p AS (SELECT s_suppkey AS k, module || '/supplier.src' AS file FROM supplier s JOIN nat ON s.s_nationkey = nat.n_nationkey),
 d AS (SELECT k AS patch, file, 'new' AS side, k * 10 + 7 AS line FROM p WHERE k % 7 = 0 UNION ALL SELECT k, file, 'new', k * 10 + 1 FROM p WHERE k % 7 <> 0
       UNION ALL SELECT k, file, 'new', k * 10 + 2 FROM p WHERE k % 7 <> 0 AND k % 4 = 0 UNION ALL SELECT k, file, 'old', k * 10 + 1 FROM p WHERE k % 7 <> 0 AND k % 4 <> 0)"""


def patches(t: Tables):
    from .adapter import NAT

    text = "WITH " + NAT + "\n" + PATCHES
    return t.spark.sql(text, region=t.raw("region"), nation=t.raw("nation"), supplier=t.raw("supplier"))


@query("s35_unified_diff", sql("nat", LINES + " SELECT patch, file, side, line FROM d"))
def s35(t: Tables):
    return formats.diff_lines(patches(t))


@query("d2_diff_lines", sql("facts", LINES + ", x AS (SELECT d.*, (SELECT name FROM facts f WHERE f.file = d.file AND f.kind = 'symbol' AND d.line BETWEEN f.line AND f.end_line) AS name FROM d) SELECT file, coalesce(name, '') AS name, side, count(*) AS lines FROM x GROUP BY ALL"))
def d2(t: Tables):
    """Changed lines of a patch by the symbol that holds them, the innermost; those outside every symbol count under no name."""
    d = g.checkpointed(formats.diff_lines(patches(t)))
    spans = t.facts.filter("kind = 'symbol'").select("file", F.col("line").alias("start_line"), "end_line", "name")
    held = g.nested_spans(d.select("file", "line").distinct(), spans)
    return d.join(held, ["file", "line"], "left").groupBy("file", F.coalesce("name", F.lit("")).alias("name"), "side").agg(F.count(F.lit(1)).alias("lines"))


# ---- OpenAPI and manifests -----------------------------------------------------------------------------------------


@query("s14_openapi", sql("routes", """, v AS (SELECT page_id, path, unnest(CASE WHEN page_id % 3 = 0 THEN ['GET', 'POST'] ELSE ['GET'] END) AS method FROM routes)
 SELECT 'api/' || page_id || '.json' AS file, 1 AS line, method, CASE WHEN page_id % 2 = 0 THEN '/v1' ELSE '' END || path AS path, 'op' || page_id || method AS handler, 'server' AS role FROM v"""))
def s14(t: Tables):
    def op(m):
        return F.to_json(F.struct(F.concat(F.lit("op"), F.col("page_id").cast("string"), F.lit(m)).alias("operationId"), F.array(F.lit("pages")).alias("tags")))

    verbs = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"get":'), op("GET"), F.lit(',"post":'), op("POST"), F.lit(',"parameters":[]}'))).otherwise(F.concat(F.lit('{"get":'), op("GET"), F.lit(',"summary":"a page"}')))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("path").alias("p"))), r'^\{"p":(.*)\}$', 1)
    servers = F.when(F.col("page_id") % 2 == 0, '"servers":[{"url":"https://host.example/v1/"}],').otherwise("")
    body = F.concat(F.lit('{"openapi":"3.0.1",'), servers, F.lit('"paths":{'), quoted, F.lit(":"), verbs, F.lit("}}"))
    files = t.part("routes").select(F.concat(F.lit("api/"), F.col("page_id").cast("string"), F.lit(".json")).alias("path"), body.alias("body"))
    return formats.openapi_routes(files)


@query("s5_manifests", """SELECT 'npm/' || p_partkey || '/package.json' AS file, 'npm' AS ecosystem, lower(p_type) || p_size AS name, '^' || p_size || '.0.0' AS version, 'runtime' AS scope FROM part
 UNION ALL SELECT 'npm/' || p_partkey || '/package.json', 'npm', 'dev-' || p_size, '1.0.' || p_size, 'dev' FROM part
 UNION ALL SELECT 'go/' || s_suppkey || '/go.mod', 'go', 'example.org/s' || s_suppkey, 'v1.' || s_nationkey || '.0', 'runtime' FROM supplier
 UNION ALL SELECT 'go/' || s_suppkey || '/go.mod', 'go', 'example.org/deep/n' || s_nationkey, 'v0.1.0', 'indirect' FROM supplier
 UNION ALL SELECT 'py/' || n_nationkey || '/requirements.txt', 'pypi', 'lib' || n_nationkey, '==1.' || n_regionkey, 'runtime' FROM nation
 UNION ALL SELECT 'rs/' || n_nationkey || '/Cargo.toml', 'crates', 'crate-' || n_nationkey, '0.' || n_regionkey, 'runtime' FROM nation
 UNION ALL SELECT 'rs/' || n_nationkey || '/Cargo.toml', 'crates', 'bench', '2.0', 'dev' FROM nation""")
def s5(t: Tables):
    n, s = t.raw("nation"), t.raw("supplier")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p[0].cast("string") for p in parts])
    c = lambda x: (F.col(x),)
    npm = t.raw("part").select(text("npm/", c("p_partkey"), "/package.json").alias("path"), F.to_json(F.struct(
        F.lit("x").alias("name"), F.create_map(F.concat(F.lower("p_type"), F.col("p_size").cast("string")), text("^", c("p_size"), ".0.0")).alias("dependencies"), F.create_map(text("dev-", c("p_size")), text("1.0.", c("p_size"))).alias("devDependencies"))).alias("body"))
    go = s.select(text("go/", c("s_suppkey"), "/go.mod").alias("path"), text("module example.org/own\n\ngo 1.22\n\nrequire example.org/s", c("s_suppkey"), " v1.", c("s_nationkey"), ".0\n\nrequire (\n\texample.org/deep/n", c("s_nationkey"), " v0.1.0 // indirect\n)\n").alias("body"))
    py = n.select(text("py/", c("n_nationkey"), "/requirements.txt").alias("path"), text("# pinned\nLib", c("n_nationkey"), "==1.", c("n_regionkey"), "\n-r other.txt\n").alias("body"))
    rs = n.select(text("rs/", c("n_nationkey"), "/Cargo.toml").alias("path"), text("[package]\nname = \"own\"\n[dependencies]\ncrate-", c("n_nationkey"), " = { version = \"0.", c("n_regionkey"), "\" }\n[dev-dependencies]\nbench = \"2.0\"\n").alias("body"))
    return formats.manifest_dependencies(npm.unionByName(go).unionByName(py).unionByName(rs))


# ---- binders -------------------------------------------------------------------------------------------------------

HANDLER = "CASE page_id % 4 WHEN 0 THEN 'Supplier.' || page_id WHEN 1 THEN repo || '.Customer.' || page_id WHEN 2 THEN 'ctrl/' || page_id ELSE NULL END"
SERVED = "(SELECT page_id, r_name AS repo FROM {pages} JOIN {region} ON page_id % 5 = r_regionkey)"


@query("l14_handled_by", sql("facts", f""", h AS (SELECT page_id AS route, repo, {HANDLER} AS handler FROM {SERVED.format(pages='pages', region='region')}), s AS (SELECT name, repo, regexp_extract(name, '[^.#:/]+$') AS tail FROM facts WHERE kind = 'symbol'),
 one AS (SELECT repo, tail, min(name) AS name FROM s GROUP BY ALL HAVING count(DISTINCT name) = 1),
 x AS (SELECT h.route, h.handler, coalesce(e.name, q.name, o.name) AS target FROM h LEFT JOIN s e ON e.repo = h.repo AND e.name = h.handler LEFT JOIN s q ON q.repo = h.repo AND q.repo || '.' || q.name = h.handler LEFT JOIN one o ON o.repo = h.repo AND o.tail = regexp_extract(h.handler, '[^.#:/]+$'))
 SELECT route, handler, target FROM x WHERE target IS NOT NULL"""))
def l14(t: Tables):
    routes = t.spark.sql(f"SELECT page_id AS route, repo, {HANDLER} AS handler FROM {SERVED}", pages=t.raw("pages"), region=t.raw("region"))
    s = t.facts.filter("kind = 'symbol'").select("name", "repo", F.concat("repo", F.lit("."), "name").alias("fqn"))
    return b.handled_by(routes, s)


@query("l30_import_aliases", sql("imports facts", """, t AS (SELECT DISTINCT 'example.org/' || dst AS target, 'module' AS via, dst AS key FROM imports UNION ALL SELECT 'pkg/' || p_brand || '/lib/' || p_partkey, 'package', p_brand FROM part
 UNION ALL SELECT 'org.' || repo || '.' || name || '.call', 'type', name FROM facts WHERE kind = 'symbol' AND starts_with(name, 'Supplier')) SELECT * FROM t"""))
def l30(t: Tables):
    part, sup = t.raw("part"), t.facts.filter("kind = 'symbol' and startswith(name, 'Supplier')")
    targets = t.imports.select(F.concat(F.lit("example.org/"), "dst").alias("target")).union(part.select(F.concat(F.lit("pkg/"), "p_brand", F.lit("/lib/"), F.col("p_partkey").cast("string"))))
    targets = targets.union(sup.select(F.concat(F.lit("org."), "repo", F.lit("."), "name", F.lit(".call")))).union(t.raw("nation").select(F.concat(F.lit("elsewhere/"), "n_name")))
    modules = t.part("nat").select(F.lit("example.org").alias("path"), F.col("module").alias("dir"), F.col("module").alias("key"))
    packages = part.select(F.concat(F.lit("pkg/"), "p_brand").alias("package"), F.col("p_brand").alias("key")).distinct()
    return b.import_aliases(targets, modules, packages, sup.select(F.concat(F.lit("org."), "repo", F.lit("."), "name").alias("fqn"), F.col("name").alias("key")))


# ---- findings ------------------------------------------------------------------------------------------------------

FOUND = """, sy AS (SELECT name, repo, file, line, cyclomatic, loop_depth, exported FROM facts WHERE kind = 'symbol'), th AS (SELECT avg(cyclomatic) + 2 * stddev_pop(cyclomatic) AS t FROM sy),
 u AS (SELECT DISTINCT dst FROM calls UNION SELECT DISTINCT dst FROM depends),
 fi AS (SELECT 'complexity' AS source, 'Complexity ' || cyclomatic || ' in ' || name AS title, round(least(0.95, 0.5 + cyclomatic / 200.0::DOUBLE), 6) AS confidence, false AS informational, file, line::BIGINT AS line, repo FROM sy, th WHERE cyclomatic >= 10 AND cyclomatic > t
  UNION ALL SELECT 'dead-code', 'Nothing uses ' || name, CASE WHEN exported THEN 0.5 ELSE 0.8 END, false, file, line, repo FROM sy WHERE name NOT IN (SELECT dst FROM u)
  UNION ALL SELECT 'loops', 'Depth ' || loop_depth || ' in ' || name, 0.9, true, file, line, repo FROM sy WHERE loop_depth >= 3)"""


def found(t: Tables):
    s = t.facts.filter("kind = 'symbol'").select("name", "repo", "file", "line", "cyclomatic", "loop_depth", "exported")
    say = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])
    place = (F.col("file"), F.col("line"), F.col("repo"))
    deep = a.with_outlier_threshold(s, "cyclomatic").filter("cyclomatic >= 10 and cyclomatic > threshold")
    used = t.edges.filter("rel in ('calls', 'depends_on')").select(F.col("dst").alias("name")).distinct()
    out = f.finding(deep, "complexity", say("Complexity ", "cyclomatic", " in ", "name"), F.least(F.lit(0.95), 0.5 + F.col("cyclomatic") / 200), *place)
    out = out.unionByName(f.finding(s.join(used, "name", "left_anti"), "dead-code", say("Nothing uses ", "name"), F.when(F.col("exported"), 0.5).otherwise(0.8), *place))
    return out.unionByName(f.finding(s.filter("loop_depth >= 3"), "loops", say("Depth ", "loop_depth", " in ", "name"), F.lit(0.9), *place, True))


@query("q16_findings", sql("facts calls depends", FOUND + " SELECT * FROM fi WHERE lower(source) = 'dead-code' AND contains(lower(repo), 'asi') AND confidence >= 0.6"))
def q16(t: Tables):
    return f.query_findings(found(t), "Dead-Code", "asi", 0.6)


@query("q16_sources", sql("facts calls depends", FOUND + " SELECT source, count(*) AS findings, max(confidence)::DOUBLE AS highest FROM fi GROUP BY source"))
def q16_sources(t: Tables):
    return f.by_source(found(t))


@query("k8_sarif", sql("facts calls depends", FOUND + """ SELECT source AS rule_id, dense_rank() OVER (ORDER BY source) - 1 AS rule_index, CASE WHEN informational THEN 'note' WHEN confidence >= 0.9 THEN 'error' ELSE 'warning' END AS level, title AS message, file AS uri, greatest(line, 1) AS start_line,
 left(sha256(source || chr(31) || regexp_replace(title, '[0-9]+', '#', 'g') || chr(31) || file), 16) AS fingerprint, confidence::DOUBLE AS confidence FROM fi"""))
def k8(t: Tables):
    return f.sarif_results(found(t)).withColumn("rule_index", F.col("rule_index").cast("long"))


# ---- pages that declare intent, folders of others' code, imports by name ----------------------------------------------


@query("s6_intent", """SELECT 'wiki/' || n_nationkey || '.md' AS page, x.section, x.entry, x.line FROM nation, LATERAL (SELECT unnest(['owns', 'forbids', 'forbids']) AS section, unnest(['nation/' || n_name, 'part/' || n_regionkey, 'region']) AS entry, unnest([4, 6, 7]) AS line) x WHERE n_nationkey % 3 <> 0""")
def s6(t: Tables):
    """A page of each nation; every third lacks the key, or has it in its prose only."""
    n = t.raw("nation")
    key = F.when(F.col("n_nationkey") % 3 == 0, "notes").otherwise("intent")
    body = F.concat(F.lit("---\n"), key, F.lit(":\n  owns:\n    - nation/"), "n_name", F.lit("\n  forbids:\n    - part/"), F.col("n_regionkey").cast("string"), F.lit("\n    - region\ntitle: page\nlist:\n  other:\n    - no entry\n---\n# Prose\nintent:\n  owns:\n    - nothing\n"))
    return formats.declared_intent(n.select(F.concat(F.lit("wiki/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("path"), body.alias("body")))


TREE = "CASE p_size % 4 WHEN 0 THEN 'third_party/' WHEN 1 THEN 'src/deps/group/' WHEN 2 THEN 'lib/' ELSE 'a/external/x/y/' END || p_brand"


@query("a20_vendored", f"""WITH f AS (SELECT {TREE} AS dir, CASE WHEN p_partkey % 5 = 0 THEN 'LICENSE.md' ELSE 'f' || p_partkey || '.c' END AS base FROM part), p AS (SELECT DISTINCT dir || '/' || base AS path, dir, base FROM f),
 l AS (SELECT dir, min(base) AS licence FROM p WHERE base = 'LICENSE.md' AND (starts_with(dir, 'third_party/') OR starts_with(dir, 'src/deps/')) GROUP BY dir) SELECT l.dir, licence, (SELECT count(*) FROM p WHERE p.dir = l.dir) AS files, l.dir || '/**' AS ignore FROM l""")
def a20(t: Tables):
    files = t.spark.sql(f"SELECT DISTINCT concat({TREE}, '/', CASE WHEN p_partkey % 5 = 0 THEN 'LICENSE.md' ELSE concat('f', p_partkey, '.c') END) AS path FROM {{part}}", part=t.raw("part"))
    return a.vendored_candidates(files)


@query("l2_imports", """WITH i AS (SELECT r_name AS consumer, CASE p_partkey % 3 WHEN 0 THEN '@' || lower(n_name) || '/lib' WHEN 1 THEN n_name || '/pkg/' || p_size ELSE 'none/' || n_name END AS target, CASE WHEN p_size % 2 = 0 THEN 'js' ELSE 'py' END AS family, n_name, n_nationkey, p_partkey
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON p_size % 5 = r_regionkey)
 SELECT DISTINCT consumer, p.r_name AS provider, target FROM i JOIN (SELECT n_name AS name, r_name, CASE WHEN n_nationkey % 2 = 0 THEN 'js' ELSE 'py' END AS fam FROM nation JOIN region ON n_regionkey = r_regionkey) p ON p.name = i.n_name AND p.fam = i.family WHERE p_partkey % 3 < 2 AND consumer <> p.r_name""")
def l2(t: Tables):
    text = """SELECT r_name AS consumer, CASE p_partkey % 3 WHEN 0 THEN concat('@', lower(n_name), '/lib') WHEN 1 THEN concat(n_name, '/pkg/', p_size) ELSE concat('none/', n_name) END AS target, CASE WHEN p_size % 2 = 0 THEN 'js' ELSE 'py' END AS family
     FROM {part} JOIN {nation} ON p_partkey % 25 = n_nationkey JOIN {region} ON p_size % 5 = r_regionkey"""
    imports = t.spark.sql(text, part=t.raw("part"), nation=t.raw("nation"), region=t.raw("region"))
    providers = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("repo"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "js").otherwise("py").alias("family"))
    return ln.import_links(imports, providers)


# ---- receipts, plans, required edges ----------------------------------------------------------------------------------

RECEIPT = "SELECT n_nationkey AS k, r_name AS repo, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE '1.' || (n_nationkey % 3) END AS version, CASE WHEN n_nationkey % 4 = 0 THEN {go} ELSE {goruby} END AS extractors, CASE WHEN n_nationkey % 2 = 0 THEN {x} ELSE {xy} END AS globs, CASE WHEN n_nationkey % 5 = 4 THEN {a} ELSE {ab} END AS members"
LISTS = {"go": ["go"], "goruby": ["go", "ruby"], "x": ["x"], "xy": ["x", "y"], "a": ["a"], "ab": ["a", "b"]}


@query("d7_comparability", "WITH r AS (" + RECEIPT.format(**{k: str(v) for k, v in LISTS.items()}) + """ FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT a.k || '-' || b.k AS pair, a AS w, b AS n FROM r a JOIN r b ON b.k IN (a.k + 1, a.k + 5))
 SELECT pair, 'repo' AS warning, true AS blocking FROM p WHERE w.repo <> n.repo UNION ALL SELECT pair, 'pre-receipt', false FROM p WHERE w.version IS NULL OR n.version IS NULL UNION ALL SELECT pair, 'version', false FROM p WHERE w.version <> n.version
 UNION ALL SELECT pair, 'extractor-lost', true FROM p WHERE len(w.extractors) > len(n.extractors) UNION ALL SELECT pair, 'extractor-new', false FROM p WHERE len(w.extractors) < len(n.extractors) UNION ALL SELECT pair, 'globs', false FROM p WHERE w.globs <> n.globs UNION ALL SELECT pair, 'members', true FROM p WHERE w.members <> n.members""")
def d7(t: Tables):
    lists = {k: "array(" + ", ".join(f"'{x}'" for x in v) + ")" for k, v in LISTS.items()}
    r = t.spark.sql(RECEIPT.format(**lists) + " FROM {nation} JOIN {region} ON n_regionkey = r_regionkey", nation=t.raw("nation"), region=t.raw("region"))
    fields = [x for x in r.columns if x != "k"]
    was, now = r.select(F.col("k").alias("i"), *[F.col(x).alias(f"was_{x}") for x in fields], F.explode(F.array(F.col("k") + 1, F.col("k") + 5)).alias("j")), r.select(F.col("k").alias("j"), *[F.col(x).alias(f"now_{x}") for x in fields])
    return sn.comparability(was.join(now, "j").withColumn("pair", F.concat_ws("-", F.col("i").cast("string"), F.col("j").cast("string"))))


@query("d17_conformance", sql("imports facts", """, p AS (SELECT DISTINCT dst AS name FROM imports WHERE src_repo = 'ASIA'), ch AS (SELECT DISTINCT regexp_replace(file, '/[a-z]+[.]src$', '') AS name FROM facts WHERE kind = 'symbol' AND starts_with(file, 'nation/') AND cyclomatic = 39)
 SELECT coalesce(p.name, ch.name) AS name, CASE WHEN p.name IS NULL THEN 'spilled' WHEN ch.name IS NULL THEN 'untouched' ELSE 'kept' END AS verdict FROM p FULL JOIN ch ON p.name = ch.name"""))
def d17(t: Tables):
    """Modules that ASIA's imports predict against those that hold a symbol of complexity 39."""
    changed = t.facts.filter("kind = 'symbol' and startswith(file, 'nation/') and cyclomatic = 39").select(F.regexp_replace("file", "/[a-z]+[.]src$", "").alias("name"))
    return sn.conformance(t.imports.filter("src_repo = 'ASIA'").select(F.col("dst").alias("name")), changed)


@query("c10_require_edge", sql("edges", """, m AS (SELECT name, repo, regexp_extract(file, '[^/]*$') AS cls FROM facts WHERE kind = 'symbol'), has AS (SELECT DISTINCT src FROM edges WHERE rel = 'calls' AND CAST(split_part(dst, '.', 2) AS BIGINT) % 997 = 0)
 SELECT name FROM m WHERE name NOT IN (SELECT src FROM has) AND (repo, cls) IN (SELECT (repo, cls) FROM m WHERE name IN (SELECT src FROM has))"""))
def c10(t: Tables):
    """Suppliers are the class of which some call a part that has a number divisible by 997; customers and parts call none, and are not judged."""
    e = t.edges.filter("rel = 'calls'").filter(F.split_part("dst", F.lit("."), F.lit(2)).cast("long") % 997 == 0)
    return c.require_edge(t.facts.filter("kind = 'symbol'"), e, "calls").select("name")


@query("c10_require_inbound", sql("edges", "SELECT name FROM facts WHERE kind = 'symbol' AND starts_with(file, 'nation/') AND name NOT IN (SELECT dst FROM edges WHERE rel = 'depends_on')"))
def c10_inbound(t: Tables):
    return c.require_edge(t.facts.filter("kind = 'symbol' and startswith(file, 'nation/')"), t.edges, "depends_on", True).select("name")


# ---- walks across interfaces, pruned rules ----------------------------------------------------------------------------

METHODS = """, cl AS (SELECT 'Customer.' || c_custkey AS src, 'Nation.' || c_nationkey || '.run' AS dst FROM customer UNION ALL SELECT 'Nation.' || n_nationkey || '.run', 'Region.' || n_regionkey FROM nation)"""


@query("g3_dispatch", sql("nat", METHODS + """, s AS (SELECT s_nationkey AS n FROM supplier WHERE s_suppkey = 1) SELECT 'Supplier.1.run' AS key, 0 AS depth, false AS through_interface UNION ALL SELECT 'Nation.' || n || '.run', 1, true FROM s
 UNION ALL SELECT DISTINCT src, 2, false FROM cl JOIN s ON cl.dst = 'Nation.' || n || '.run'"""))
def g3_dispatch(t: Tables):
    """Who may call Supplier.1.run: suppliers implement their nation's interface, and customers call that."""
    key = lambda name, col, more="": F.concat(F.lit(name), F.col(col).cast("string"), F.lit(more))
    n, s = t.raw("nation"), t.raw("supplier")
    edges = t.raw("customer").select(key("Customer.", "c_custkey").alias("src"), F.lit("calls").alias("rel"), key("Nation.", "c_nationkey", ".run").alias("dst"))
    edges = edges.unionByName(n.select(key("Nation.", "n_nationkey", ".run").alias("src"), F.lit("calls").alias("rel"), key("Region.", "n_regionkey").alias("dst")))
    members = n.select(key("Nation.", "n_nationkey").alias("owner"), key("Nation.", "n_nationkey", ".run").alias("member")).unionByName(s.select(key("Supplier.", "s_suppkey").alias("owner"), key("Supplier.", "s_suppkey", ".run").alias("member")))
    hops = g.dispatch_hops(s.select(key("Supplier.", "s_suppkey").alias("type"), key("Nation.", "s_nationkey").alias("interface")), members)
    return g.traverse_dispatching(edges, t.spark.createDataFrame([("Supplier.1.run",)], "key string"), hops, 5, True)


IMPLIED = "SELECT '{0}' AS if_prop, CAST({1} AS {s}) AS if_value, '{2}' AS then_prop, CAST({3} AS {s}) AS then_value, count(*) AS n, sum(count(*)) OVER (PARTITION BY {1}) AS support FROM {t} GROUP BY {1}, {3}"
PROPS = (("nation", "n_name", "region", "n_regionkey"), ("region", "n_regionkey", "nation", "n_name"), ("key", "n_nationkey", "nation", "n_name"), ("nation", "n_name", "key", "n_nationkey"), ("key", "n_nationkey", "region", "n_regionkey"), ("name", "n_name", "nation", "n_name"))


@query("m6_pruned", "WITH r AS (" + " UNION ALL ".join(IMPLIED.format(*p, s="VARCHAR", t="nation") for p in PROPS) + """), c AS (SELECT *, n / support AS confidence FROM r WHERE if_prop <> then_prop AND if_value <> then_value),
 k AS (SELECT *, row_number() OVER (PARTITION BY least(if_prop || chr(1) || if_value, then_prop || chr(1) || then_value), greatest(if_prop || chr(1) || if_value, then_prop || chr(1) || then_value) ORDER BY confidence < 1, support DESC, if_prop, if_value) AS o FROM c)
 SELECT if_prop, if_value, then_prop, then_value, support::BIGINT AS support, round(confidence, 6) AS confidence FROM k WHERE confidence < 1 OR o = 1""")
def m6(t: Tables):
    text = " UNION ALL ".join(IMPLIED.format(*p, s="STRING", t="{nation}") for p in PROPS)
    r = t.spark.sql(text, nation=t.raw("nation")).withColumn("confidence", F.round(F.col("n") / F.col("support"), 6))
    return sn.pruned_implications(r.drop("n"))


# ---- code: a file of each supplier, in one of three languages ---------------------------------------------------------

CODE = {
    0: ("go/s{k}.go", "package s\n\nimport (\n\t\"example.org/n{n}\"\n)\n\n// Fake() is no call\nfunc Supply{k}(x int) int {\n\tfor x > 0 {\n\t\tx = parts.Part{k}(x)\n\t}\n\treturn base(x)\n}\n\nfunc base(x int) int { return x }\n"),
    1: ("ts/s{k}.ts", "import {{ n }} from \"./n{n}\";\nexport class S{k} extends Base {{\n  run(x) {{ return this.load(x); }}\n  load(x) {{ return part{k}(\"call(me)\"); }}\n}}\n".replace("{{", "{").replace("}}", "}")),
    2: ("j/S{k}.java", "import org.n{n}.A;\npublic class S{k} implements B {\n  public int run(int x) { return Part.of(x); }\n}\n"),
}
CODE_EDGES = """SELECT file, name, rel, target FROM (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 3 AS l FROM supplier), LATERAL (
 SELECT unnest(CASE l WHEN 0 THEN ['go/s' || k || '.go'] WHEN 1 THEN ['ts/s' || k || '.ts'] ELSE ['j/S' || k || '.java'] END) AS file), LATERAL (SELECT unnest(CASE l
 WHEN 0 THEN [{'name': 'go', 'rel': 'imports', 'target': 'example.org/n' || n}, {'name': 'go.Supply' || k, 'rel': 'declares', 'target': 'go'}, {'name': 'go.Supply' || k, 'rel': 'calls', 'target': 'parts.Part' || k}, {'name': 'go.Supply' || k, 'rel': 'calls', 'target': 'go.base'}, {'name': 'go.base', 'rel': 'declares', 'target': 'go'}]
 WHEN 1 THEN [{'name': 'ts', 'rel': 'imports', 'target': './n' || n}, {'name': 'ts.S' || k, 'rel': 'declares', 'target': 'ts'}, {'name': 'ts.S' || k, 'rel': 'implements', 'target': 'Base'}, {'name': 'ts.S' || k || '.run', 'rel': 'declares', 'target': 'ts.S' || k},
  {'name': 'ts.S' || k || '.run', 'rel': 'calls', 'target': 'ts.S' || k || '.load'}, {'name': 'ts.S' || k || '.load', 'rel': 'declares', 'target': 'ts.S' || k}, {'name': 'ts.S' || k || '.load', 'rel': 'calls', 'target': 'part' || k}]
 ELSE [{'name': 'j', 'rel': 'imports', 'target': 'org.n' || n || '.A'}, {'name': 'j.S' || k, 'rel': 'declares', 'target': 'j'}, {'name': 'j.S' || k, 'rel': 'implements', 'target': 'B'}, {'name': 'j.S' || k || '.run', 'rel': 'declares', 'target': 'j.S' || k}, {'name': 'j.S' || k || '.run', 'rel': 'calls', 'target': 'Part.of'}] END, recursive := true))"""


@query("s1_code_edges", CODE_EDGES)
def s1(t: Tables):
    def filled(text):
        return F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{n}"), F.col("s_nationkey").cast("string"))

    pick = lambda i: F.when(F.col("s_suppkey") % 3 == 0, filled(CODE[0][i])).when(F.col("s_suppkey") % 3 == 1, filled(CODE[1][i])).otherwise(filled(CODE[2][i]))
    found = code.extract_code(t.raw("supplier").select(pick(0).alias("path"), pick(1).alias("body")))
    return found.select("file", "name", F.explode("relations").alias("r")).select("file", "name", F.col("r.kind").alias("rel"), F.col("r.target").alias("target"))
