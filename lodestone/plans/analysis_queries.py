"""A rows (analyses), C rows (constraint forms) and L rows (linking)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyses as a
from ..operators import binders
from ..operators import graph as g
from ..operators import links as ln
from ..operators import rules as c
from .adapter import Tables, sql
from .graph_queries import DEG, DEPTH, REACH
from .registry import query

CALLS_IN = "rel IN ('calls', 'depends_on')"
DEGREES = DEG.format(w=CALLS_IN)
SYMBOLS = ", y AS (SELECT f.name AS key, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM (SELECT DISTINCT name FROM facts WHERE kind = 'symbol') f LEFT JOIN d ON d.key = f.name)"


@query("a1_cycles", sql("imports", REACH + " SELECT component, count(*) AS modules, CASE WHEN count(*) > 8 THEN 'coupled cluster' ELSE 'cycle' END AS wording FROM c GROUP BY component", True))
def a1(t: Tables):
    s = g.strongly_connected(t.imports).groupBy("component").agg(F.count(F.lit(1)).alias("modules"))
    return s.withColumn("wording", F.when(F.col("modules") > 8, "coupled cluster").otherwise("cycle"))


@query("a2_layers", sql("imports", """, lv AS (SELECT module AS m, n_nationkey % 4 AS lv FROM nat) SELECT CASE WHEN a.lv < b.lv THEN 'violation' WHEN a.lv > b.lv THEN 'inward' ELSE 'same' END AS verdict, count(*) AS n FROM imports i JOIN lv a ON a.m = i.src JOIN lv b ON b.m = i.dst GROUP BY 1"""))
def a2(t: Tables):
    """Layers by declared level: an import from a lower to a higher level is a violation."""
    lv = t.part("nat").select(F.col("module").alias("m"), (F.col("n_nationkey") % 4).alias("lv"))
    x = t.imports.join(lv.toDF("src", "ls"), "src").join(lv.toDF("dst", "ld"), "dst")
    return x.groupBy(F.when(F.col("ls") < F.col("ld"), "violation").when(F.col("ls") > F.col("ld"), "inward").otherwise("same").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("a3_crossrepo", sql("imports", ", p AS (SELECT DISTINCT src_repo AS src, dst_repo AS dst FROM imports WHERE src_repo <> dst_repo) SELECT p.src, p.dst FROM p JOIN p q ON p.src = q.dst AND p.dst = q.src WHERE p.src < p.dst"))
def a3(t: Tables):
    return a.mutual_pairs(t.imports.filter("src_repo <> dst_repo").select(F.col("src_repo").alias("src"), F.col("dst_repo").alias("dst")))


@query("a4_coverage", sql("routes", """, k AS (SELECT c.repo, c.page_id, max(CASE WHEN s.page_id IS NULL THEN 0 ELSE 1 END) AS hit FROM routes c LEFT JOIN routes s ON s.role = 'server' AND s.path = c.path AND s.repo <> c.repo WHERE c.role = 'client' GROUP BY c.repo, c.page_id)
 SELECT repo, count(*) AS detected, sum(hit)::BIGINT AS resolved, count(*) - sum(hit)::BIGINT AS unresolved, CASE WHEN sum(hit) = count(*) THEN 'connected' WHEN sum(hit) = 0 THEN 'isolated' ELSE 'coverage-gap' END AS status FROM k GROUP BY repo"""))
def a4(t: Tables):
    return ln.coverage(t.part("routes"))


@query("a5_unused_routes", sql("routes", "SELECT s.repo, count(*) AS served, count(*) FILTER (c.path IS NULL) AS unused, round(count(*) FILTER (c.path IS NULL) / count(*), 3) AS share FROM routes s LEFT JOIN (SELECT DISTINCT path FROM routes WHERE role = 'client') c ON c.path = s.path WHERE s.role = 'server' GROUP BY s.repo"))
def a5(t: Tables):
    r = t.part("routes")
    s = r.filter("role = 'server'").join(r.filter("role = 'client'").select("path", F.lit(True).alias("hit")).distinct(), "path", "left")
    x = s.groupBy("repo").agg(F.count(F.lit(1)).alias("served"), F.count_if(F.col("hit").isNull()).alias("unused"))
    return x.withColumn("share", F.round(F.col("unused") / F.col("served"), 3))


@query("a6_hubs", sql("calls", ", i AS (SELECT dst AS key, count(*) AS n FROM calls GROUP BY dst) SELECT key, n FROM i WHERE n >= 10 AND n >= (SELECT avg(n) + 2 * stddev_pop(n) FROM i)"))
def a6(t: Tables):
    n = t.part("calls").groupBy(F.col("dst").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return a.with_outlier_threshold(n, "n").filter("n >= 10 and n >= threshold").select("key", "n")


@query("a7_query_loops", sql("edges", "SELECT f.name, count(*) AS queries FROM facts f JOIN edges e ON e.src = f.name AND e.rel = 'calls' WHERE f.loop_depth >= 2 GROUP BY f.name"))
def a7(t: Tables):
    """Calls to storage out of loops: looping symbols joined with their calls."""
    return t.facts.filter("loop_depth >= 2").join(t.edges_of("calls").select(F.col("src").alias("name")), "name").groupBy("name").agg(F.count(F.lit(1)).alias("queries"))


@query("a8_dead_methods", sql("edges", "SELECT name FROM facts m WHERE kind = 'symbol' AND symbol_kind = 'function' AND NOT EXISTS (SELECT 1 FROM edges e JOIN facts f ON f.name = e.src AND f.kind = 'symbol' WHERE e.rel = 'calls' AND f.repo = m.repo AND split_part(e.dst, '.', 2) = split_part(m.name, '.', 2))"))
def a8(t: Tables):
    """Methods whose bare name no call of their repository ends in."""
    bare = lambda x: F.split_part(F.col(x), F.lit("."), F.lit(2))
    s = t.facts.filter("kind = 'symbol'")
    calls = t.edges_of("calls")
    n = calls.count()
    held = g.spread(calls.select("src", bare("dst").alias("bare")), n, "src").join(s.select(F.col("name").alias("src"), "repo").hint("shuffle_hash"), "src")
    called = g.spread(held.select("repo", "bare"), n, "repo", "bare").distinct()
    return s.filter("symbol_kind = 'function'").select("name", "repo", bare("name").alias("bare")).join(called, ["repo", "bare"], "left_anti").select("name")


@query("a9_entry_points", sql("facts", "SELECT CASE WHEN contains(file, 'customer') THEN 'http' WHEN loop_depth = 0 THEN 'cli' ELSE 'job' END AS mechanism, count(*) AS n FROM facts WHERE kind = 'symbol' AND exported GROUP BY 1"))
def a9(t: Tables):
    m = F.when(F.col("file").contains("customer"), "http").when(F.col("loop_depth") == 0, "cli").otherwise("job")
    return t.facts.filter("kind = 'symbol' and exported").groupBy(m.alias("mechanism")).agg(F.count(F.lit(1)).alias("n"))


@query("a10_messaging", """SELECT event_type AS topic, CASE WHEN bool_or(user_id % 2 = 0) AND bool_or(user_id % 2 = 1) THEN 'ok' WHEN bool_or(user_id % 2 = 0) THEN 'unimplemented' ELSE 'undeclared' END AS verdict, CASE WHEN bool_or(user_id % 2 = 0) AND bool_or(user_id % 2 = 1) THEN 0.0 WHEN bool_or(user_id % 2 = 0) THEN 0.65 ELSE 0.9 END::DOUBLE AS confidence FROM events GROUP BY event_type""")
def a10(t: Tables):
    """Topics declared (even users) and implemented (odd users)."""
    e = t.raw("events").groupBy(F.col("event_type").alias("topic")).agg(F.bool_or(F.col("user_id") % 2 == 0).alias("d"), F.bool_or(F.col("user_id") % 2 == 1).alias("i"))
    return e.select("topic", F.when(F.col("d") & F.col("i"), "ok").when(F.col("d"), "unimplemented").otherwise("undeclared").alias("verdict"), F.when(F.col("d") & F.col("i"), 0.0).when(F.col("d"), 0.65).otherwise(0.9).alias("confidence"))


@query("a11_god_class", sql("edges", DEGREES + SYMBOLS + ", t AS (SELECT avg(fan_in) + 2 * stddev_pop(fan_in) AS threshold FROM y) SELECT key, fan_in, fan_out, round(greatest(0.5, least(0.5 + 0.5 * (fan_in / threshold - 1), 0.95)), 6) AS confidence FROM y, t WHERE fan_in >= 8 AND fan_in > threshold ORDER BY fan_in DESC, key LIMIT 25"))
def a11(t: Tables):
    return a.god_classes(a.population(t.facts.filter("kind = 'symbol'").select(F.col("name").alias("key")), g.degrees(t.edges_of("calls", "depends_on"))))


@query("a12_hotspots", sql("edges", DEGREES + SYMBOLS + ", s AS (SELECT *, fan_in * fan_out AS score FROM y) SELECT key, fan_in, fan_out, score FROM s WHERE fan_in >= 3 AND fan_out >= 3 AND score > (SELECT avg(score) + 2 * stddev_pop(score) FROM s) ORDER BY score DESC, key LIMIT 20"))
def a12(t: Tables):
    return a.hotspots(a.population(t.facts.filter("kind = 'symbol'").select(F.col("name").alias("key")), g.degrees(t.edges_of("calls", "depends_on"))))


@query("a13_depth", sql("imports", DEPTH + " HAVING max(length) >= 2", True))
def a13(t: Tables):
    return g.longest_chains(t.imports).filter("length >= 2")


MODULE = "regexp_replace(file, '/[a-z]+[.]src$', '')"


@query("a14_surface", sql("facts", f", m AS (SELECT {MODULE} AS module, count(*) AS symbols, count(*) FILTER (exported) AS exported FROM facts WHERE kind = 'symbol' GROUP BY 1) SELECT module, symbols, exported, round(exported / symbols, 3) AS ratio FROM m WHERE symbols >= 15 AND exported / symbols >= 0.85 ORDER BY exported DESC, ratio DESC, module LIMIT 20"))
def a14(t: Tables):
    return a.exported_surface(t.facts.filter("kind = 'symbol'").withColumn("module", F.expr(MODULE)))


@query("a15_complexity", sql("facts", ", s AS (SELECT name, cyclomatic FROM facts WHERE kind = 'symbol') SELECT * FROM s WHERE cyclomatic >= 10 AND cyclomatic > (SELECT avg(cyclomatic) + 2 * stddev_pop(cyclomatic) FROM s) ORDER BY cyclomatic DESC, name LIMIT 15"))
def a15(t: Tables):
    return a.complexity_outliers(t.facts.filter("kind = 'symbol'").select("name", "cyclomatic"))


@query("a16_intent", sql("imports", """, m AS (SELECT DISTINCT src_repo AS src, dst_repo AS dst FROM imports), dcl AS (SELECT x.r_name AS src, y.r_name AS dst FROM region x JOIN region y ON (x.r_regionkey + 1) % 5 = y.r_regionkey)
 SELECT coalesce(m.src, dcl.src) AS src, coalesce(m.dst, dcl.dst) AS dst, CASE WHEN m.src IS NULL THEN 'missing' WHEN dcl.src IS NULL THEN 'unexpected' ELSE 'declared' END AS verdict FROM m FULL JOIN dcl ON m.src = dcl.src AND m.dst = dcl.dst"""))
def a16(t: Tables):
    """Declared seams (each region to the next) against measured ones."""
    r = t.raw("region")
    d = r.select(F.col("r_name").alias("src"), ((F.col("r_regionkey") + 1) % 5).alias("k")).join(r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("dst")), "k").select("src", "dst", F.lit(1).alias("d"))
    m = t.imports.select(F.col("src_repo").alias("src"), F.col("dst_repo").alias("dst"), F.lit(1).alias("m")).distinct()
    return m.join(d, ["src", "dst"], "full").select("src", "dst", F.when(F.col("m").isNull(), "missing").when(F.col("d").isNull(), "unexpected").otherwise("declared").alias("verdict"))


@query("a17_dead_code", sql("edges", ", u AS (SELECT src, dst FROM edges WHERE rel IN ('calls', 'depends_on')) SELECT f.name, CASE WHEN f.name IN (SELECT src FROM u) THEN 'unreferenced' ELSE 'isolated' END AS class FROM facts f WHERE kind = 'symbol' AND f.name NOT IN (SELECT dst FROM u)"))
def a17(t: Tables):
    return a.dead_code(t.facts.filter("kind = 'symbol'").select("name"), t.edges_of("calls", "depends_on"))


@query("a18_performance", sql("edges", """, k AS (SELECT e.src AS name, max(CASE WHEN f.loop_depth > 0 THEN f.loop_depth ELSE 0 END) AS callee FROM edges e JOIN facts f ON f.name = e.dst WHERE e.rel = 'calls' GROUP BY e.src),
 s AS (SELECT f.name, f.loop_depth, f.loop_depth + coalesce(k.callee, 0) AS effective, f.exported FROM facts f LEFT JOIN k ON k.name = f.name WHERE f.kind = 'symbol' AND f.loop_depth >= 1)
 SELECT name, loop_depth, effective, round(effective * CASE WHEN effective >= 6 THEN 0.35::DOUBLE WHEN effective >= 4 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END * CASE WHEN exported THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END, 2)::DOUBLE AS risk FROM s WHERE effective >= 2"""))
def a18(t: Tables):
    """Effective loop depth over the (acyclic) call edges: own depth and the deepest callee's."""
    deep = t.edges_of("calls").join(t.facts.select(F.col("name").alias("dst"), "loop_depth"), "dst").groupBy(F.col("src").alias("name")).agg(F.max("loop_depth").alias("callee"))
    s = t.facts.filter("kind = 'symbol' and loop_depth >= 1").join(deep, "name", "left").withColumn("effective", F.col("loop_depth") + F.coalesce("callee", F.lit(0)))
    conf = F.when(F.col("effective") >= 6, 0.35).when(F.col("effective") >= 4, 0.5).otherwise(0.7)
    return s.filter("effective >= 2").select("name", "loop_depth", "effective", a.risk(F.col("effective"), conf, F.col("exported")).alias("risk"))


@query("a21_import_closure", sql("imports", ", r(src, dst) AS (SELECT src, dst FROM imports UNION SELECT r.src, i.dst FROM r JOIN imports i ON i.src = r.dst) SELECT src AS module, count(*) AS closure FROM r GROUP BY src HAVING count(*) >= 2", True))
def a21(t: Tables):
    return g.reachable_pairs(t.imports).groupBy(F.col("src").alias("module")).agg(F.count(F.lit(1)).alias("closure")).filter("closure >= 2")


METRICS = f""", n AS (SELECT {MODULE} AS package, count(*) AS classes, count(*) FILTER (NOT exported) AS abstract_n FROM facts WHERE kind = 'symbol' GROUP BY 1), ca AS (SELECT dst AS package, count(DISTINCT src) AS ca FROM imports GROUP BY dst), ce AS (SELECT src AS package, count(DISTINCT dst) AS ce FROM imports GROUP BY src),
 x AS (SELECT n.package, classes, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0.0 END AS i, abstract_n / classes AS a FROM n LEFT JOIN ca ON ca.package = n.package LEFT JOIN ce ON ce.package = n.package),
 y AS (SELECT *, abs(a + i - 1) AS d FROM x)"""


def metrics(t: Tables):
    types = t.facts.filter("kind = 'symbol'").select(F.expr(MODULE).alias("package"), (~F.col("exported")).alias("abstract"))
    return a.package_metrics(t.imports, types)


@query("a22_package_metrics", sql("edges", METRICS + " SELECT package, classes, ca, ce, round(i, 3) AS instability, round(a, 3) AS abstractness, round(d, 3) AS distance, CASE WHEN d > 0.7 AND classes >= 3 THEN CASE WHEN a + i < 1 THEN 'pain' ELSE 'useless' END WHEN d <= 0.3 THEN 'main' ELSE 'neutral' END AS zone FROM y"))
def a22(t: Tables):
    return metrics(t)


@query("a22_rigid_floor", sql("edges", METRICS + ", z AS (SELECT ca, row_number() OVER (ORDER BY ca, package) - 1 AS i, count(*) OVER () AS n FROM y) SELECT greatest(ca, 5) AS floor FROM z WHERE i = least((9 * n + 9) // 10, n - 1)"))
def a22_floor(t: Tables):
    return a.rigid_floor(metrics(t))


@query("a23_packwerk", sql("imports", ", u AS (SELECT DISTINCT src, dst_repo FROM imports WHERE src_repo <> dst_repo), dcl AS (SELECT module AS src, repo AS dst_repo FROM nat WHERE n_nationkey % 2 = 0) SELECT * FROM u EXCEPT SELECT * FROM dcl"))
def a23(t: Tables):
    used = t.imports.filter("src_repo <> dst_repo").select("src", "dst_repo").distinct()
    return used.subtract(t.part("nat").filter("n_nationkey % 2 = 0").select(F.col("module").alias("src"), F.col("repo").alias("dst_repo")))


@query("a24_final_inheritance", sql("edges", "SELECT DISTINCT a.name AS derived, b.name AS base FROM edges e JOIN facts a ON a.name = e.src JOIN facts b ON b.name = e.dst WHERE e.rel = 'calls' AND a.repo = b.repo AND b.symbol_kind = 'promo' AND a.name <> b.name"))
def a24(t: Tables):
    """Edges to a sealed target in the same repository (PROMO parts play final types)."""
    x, y = t.facts.select(F.col("name").alias("src"), F.col("repo")), t.facts.filter("symbol_kind = 'promo'").select(F.col("name").alias("dst"), "repo")
    return t.edges_of("calls").join(x, "src").join(y, ["dst", "repo"]).filter("src <> dst").select(F.col("src").alias("derived"), F.col("dst").alias("base")).distinct()


# ---- constraint forms ----------------------------------------------------------------------------------------------

COMP = "(SELECT name FROM facts WHERE kind = 'symbol' AND repo = 'ASIA' AND starts_with(name, 'Supplier'))"
TO = "(SELECT name FROM facts WHERE kind = 'symbol' AND cyclomatic >= 45)"


def comp(t: Tables):
    return t.facts.filter("kind = 'symbol' and repo = 'ASIA' and startswith(name, 'Supplier')")


def to(t: Tables):
    return t.facts.filter("kind = 'symbol' and cyclomatic >= 45")


E = "SELECT DISTINCT src, rel, dst FROM edges WHERE "
query("c1_forbid", sql("edges", E + f"src IN {COMP} AND dst IN {TO} AND rel = 'calls'"))(lambda t: c.forbid(t.edges, comp(t), to(t), "calls").distinct())
query("c2_forbid_reach", sql("edges", f", s AS (SELECT DISTINCT e.src, e.dst FROM edges e WHERE rel = 'depends_on' AND src IN (SELECT name FROM facts WHERE symbol_kind = 'function' AND repo = 'ASIA') AND dst IN {COMP}) SELECT dst AS key, 1 AS hops, min(src) || '>' || dst AS path FROM s GROUP BY dst"))(
    lambda t: c.forbid_reach(t.edges, t.facts.filter("symbol_kind = 'function' and repo = 'ASIA'"), comp(t), "depends_on", 1).withColumn("path", F.array_join("path", ">")))
query("c3_allow", sql("edges", E + f"src IN {COMP} AND rel = 'calls' AND dst IN (SELECT name FROM facts) AND dst NOT IN {COMP} AND dst NOT IN (SELECT name FROM facts WHERE cyclomatic < 45)"))(
    lambda t: c.allow(t.edges, comp(t), t.facts.filter("cyclomatic < 45"), t.facts, "calls").distinct())
query("c4_protect", sql("edges", E + f"dst IN {COMP} AND src NOT IN {COMP} AND src NOT IN (SELECT name FROM facts WHERE repo = 'ASIA')"))(lambda t: c.protect(t.edges, comp(t), t.facts.filter("repo = 'ASIA'")))
query("c5_private", sql("edges", E + "dst IN (SELECT name FROM facts WHERE kind = 'symbol' AND starts_with(name, 'Supplier') GROUP BY name HAVING NOT bool_or(exported)) AND src NOT IN (SELECT name FROM facts WHERE starts_with(name, 'Supplier'))"))(
    lambda t: c.private(t.edges, t.facts.filter("kind = 'symbol' and startswith(name, 'Supplier')")))
query("c6_forbid_fact", sql("facts", "SELECT name FROM facts WHERE kind = 'symbol' AND cyclomatic >= 45"))(lambda t: c.forbid_fact(to(t)).select("name"))
query("c7_cap_members", sql("facts", f", m AS (SELECT DISTINCT name FROM {TO}) SELECT count(*) AS members, (SELECT name FROM m ORDER BY name LIMIT 1 OFFSET 10) AS first_over FROM m HAVING count(*) > 10"))(lambda t: c.cap_members(to(t), 10))
query("c8_require", sql("edges", f"SELECT name FROM facts WHERE name IN {COMP} AND loop_depth >= 2 AND NOT exported AND name IN (SELECT src FROM edges WHERE rel = 'calls')"))(
    lambda t: c.require(comp(t), F.col("loop_depth") >= 2, F.col("exported"), t.edges_of("calls"), "calls").select("name"))
query("c9_require_defines", "SELECT DISTINCT 'T' || (user_id % 200) AS name FROM events WHERE user_id % 200 NOT IN (SELECT user_id % 200 FROM events WHERE event_type = 'purchase' AND value >= 150)")(
    lambda t: c.require_defines(t.raw("events").select(F.concat(F.lit("T"), (F.col("user_id") % 200).cast("string")).alias("name")).distinct(),
                                t.raw("events").filter("value >= 150").select(F.concat(F.lit("T"), (F.col("user_id") % 200).cast("string")).alias("owner"), F.col("event_type").alias("method")), "purchase"))
STEP = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END"
query("c11_protocol", f"WITH s AS (SELECT DISTINCT user_id || ':' || day(ts) AS name, {STEP} AS step FROM events), h AS (SELECT name, max(step) AS highest FROM s WHERE step > 0 GROUP BY name) SELECT h.name, h.highest, string_agg(r.i::VARCHAR, ',' ORDER BY r.i) AS missing FROM h, range(1, 4) r(i) WHERE r.i <= h.highest AND NOT EXISTS (SELECT 1 FROM s WHERE s.name = h.name AND s.step = r.i) GROUP BY h.name, h.highest")(
    lambda t: c.protocol(t.raw("events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string")).alias("name"), F.expr(STEP).alias("step")).filter("step > 0").distinct()))
query("c12_forbid_cycles", sql("imports", REACH + " SELECT key, component FROM c", True))(lambda t: c.forbid_cycles(t.imports))
query("c13_independent", sql("imports", ", r(src, dst) AS (SELECT src, dst FROM imports UNION SELECT r.src, i.dst FROM r JOIN imports i ON i.src = r.dst) SELECT src AS part, dst AS whole FROM r WHERE dst IN ('nation/NATION_9', 'nation/NATION_6')", True))(
    lambda t: c.independent(t.imports, t.part("nat").select(F.col("module").alias("part"), F.explode(F.array(F.lit("nation/NATION_9"), F.lit("nation/NATION_6"))).alias("whole"))))
query("c14_require_name", sql("facts", "SELECT name FROM facts WHERE kind = 'module' AND NOT regexp_matches(regexp_extract(name, '[^.#/]*$'), '^NATION_1')"))(lambda t: c.name_rule(t.facts.filter("kind = 'module'"), "^NATION_1").select("name"))
query("c15_forbid_name", sql("facts", "SELECT name FROM facts WHERE kind = 'module' AND regexp_matches(regexp_extract(name, '[^.#/]*$'), '^NATION_1')"))(lambda t: c.name_rule(t.facts.filter("kind = 'module'"), "^NATION_1", False).select("name"))
query("c16_guide", sql("facts", "SELECT DISTINCT file, 'keep symbols small' AS advice FROM facts WHERE cyclomatic >= 45"))(lambda t: to(t).select("file", F.lit("keep symbols small").alias("advice")).distinct())
query("c17_storage_stays_home", sql("edges", E + f"dst IN {TO} AND src NOT IN {COMP} AND rel = 'calls'"))(lambda t: c.storage_stays_home(t.edges_of("calls"), to(t), comp(t)))
query("c18_cap_runtime", "SELECT event_id, value FROM events WHERE value > 90")(lambda t: c.cap_runtime(t.raw("events"), 90).select("event_id", "value"))
query("c19_require_consumer", sql("routes", "SELECT page_id FROM routes WHERE role = 'server' AND path NOT IN (SELECT path FROM routes WHERE role = 'client')"))(
    lambda t: (lambda r: r.filter("role = 'server'").join(r.filter("role = 'client'").select("path").distinct(), "path", "left_anti").select("page_id"))(t.part("routes")))
query("c20_unique_across", sql("facts", "SELECT name AS value, count(DISTINCT repo) AS repos FROM facts WHERE kind = 'module' GROUP BY name HAVING count(DISTINCT repo) > 1"))(lambda t: c.unique_across(t.facts.filter("kind = 'module'"), "name"))
query("c21_require_governed", sql("facts", "SELECT DISTINCT file AS path FROM facts WHERE kind = 'symbol' AND NOT starts_with(file, 'part/Brand#1')"))(
    lambda t: c.require_governed(t.facts.filter("kind = 'symbol'"), t.facts.filter("kind = 'module' and startswith(name, 'part/Brand#1')").select(F.col("name").alias("module"))))
query("c22_contract", sql("edges", "SELECT x.rel, x.side, x.name, f.kind FROM (SELECT rel, 'out' AS side, dst AS name FROM edges WHERE src = 'Supplier.9' UNION ALL SELECT rel, 'in', src FROM edges WHERE dst = 'Supplier.9') x JOIN facts f ON f.name = x.name"))(
    lambda t: c.contract_for("Supplier.9", t.edges, t.facts).select("rel", "side", "name", "kind"))
query("c23_near_misses", "SELECT p.b AS word, q.b AS near, levenshtein(p.b, q.b) AS distance FROM (SELECT DISTINCT p_brand || 'x' AS b FROM part) p, (SELECT DISTINCT p_brand AS b FROM part) q WHERE levenshtein(p.b, q.b) <= 1")(
    lambda t: c.near_misses(t.raw("part").select(F.concat("p_brand", F.lit("x")).alias("word")).distinct(), t.raw("part").select(F.col("p_brand").alias("near")).distinct(), 1).withColumn("distance", F.col("distance").cast("long")))


# ---- linking -------------------------------------------------------------------------------------------------------

L1A = """list_transform(list_concat(list_slice(seg, 1, -2), [regexp_replace(seg[-1], '^(.+)[.](json|xml)$', '\\1')]), lambda s: CASE WHEN starts_with(s, ':') OR (starts_with(s, '{') AND ends_with(s, '}') AND length(s) > 1)
 OR (starts_with(s, '<') AND ends_with(s, '>') AND length(s) > 1) OR (starts_with(s, '[') AND ends_with(s, ']') AND length(s) > 1) THEN '{}' ELSE s END)"""
SEGMENTS = "(SELECT *, string_split(CASE WHEN length(trim(path)) > 1 THEN rtrim(trim(path), '/') ELSE trim(path) END, '/') AS seg FROM routes)"
NORM = f", n AS (SELECT page_id, repo, role, method, array_to_string({L1A}, '/') AS norm FROM {SEGMENTS})"
query("l1a_normalise_path", sql("routes", NORM + " SELECT page_id, norm FROM n"))(lambda t: t.part("routes").select("page_id", ln.normalise_path(F.col("path")).alias("norm")))
HTTP = NORM + """, c AS (SELECT * FROM n WHERE role = 'client'), s AS (SELECT * FROM n WHERE role = 'server'),
 x AS (SELECT DISTINCT page_id, repo, method, array_to_string(list_slice(p, i::INT, len(p)), '/') AS suf, len(p) - i + 1 AS segs FROM (SELECT *, string_split(ltrim(norm, '/'), '/') AS p FROM c), range(1, 12) r(i) WHERE i <= len(p)),
 y AS (SELECT DISTINCT page_id AS sid, repo AS srepo, method AS smethod, array_to_string(list_slice(p, i::INT, len(p)), '/') AS suf FROM (SELECT *, string_split(ltrim(norm, '/'), '/') AS p FROM s), range(1, 12) r(i) WHERE i <= len(p)),
 m AS (SELECT x.page_id, y.sid, max(x.segs) AS segs FROM x JOIN y ON x.suf = y.suf AND x.repo <> y.srepo AND (x.method = y.smethod OR x.method = '*' OR y.smethod = '*') GROUP BY ALL),
 k AS (SELECT *, max(segs) OVER (PARTITION BY page_id) AS top FROM m WHERE segs >= 2),
 mm AS (SELECT page_id, sid AS server_id, segs::BIGINT AS segments, count(*) OVER (PARTITION BY page_id) AS candidates FROM k WHERE segs = top)"""
query("l1_http", sql("routes", HTTP + " SELECT * FROM mm"))(lambda t: ln.http_links(t.part("routes")))
query("l1b_picked", sql("routes", HTTP + """, h AS (SELECT page_id, 'repo' || (page_id % 3) AS hint FROM routes WHERE role = 'client' AND page_id % 4 = 0), v AS (SELECT mm.*, coalesce(h.hint = r.repo, false) AS hinted FROM mm JOIN routes r ON r.page_id = mm.server_id LEFT JOIN h ON h.page_id = mm.page_id),
 z AS (SELECT *, count(*) FILTER (hinted) OVER (PARTITION BY page_id) AS named FROM v) SELECT page_id, server_id, segments, CASE WHEN segments >= 3 THEN 'verified' ELSE 'probable' END AS confidence FROM z WHERE candidates = 1 OR (hinted AND named = 1)"""))(
    lambda t: binders.picked_providers(t.part("routes"), t.part("routes").filter("role = 'client' and page_id % 4 = 0").select("page_id", F.concat(F.lit("repo"), (F.col("page_id") % 3).cast("string")).alias("repo"))))
query("l1c_inverse", sql("routes", "SELECT page_id, role FROM routes a WHERE NOT EXISTS (SELECT 1 FROM routes b WHERE b.path = a.path AND b.role <> a.role)"))(lambda t: ln.unmatched(t.part("routes")))
query("l3_topics", "WITH e AS (SELECT DISTINCT event_type AS topic, user_id % 10 AS repo, user_id % 2 AS consumes FROM events) SELECT DISTINCT c.topic, c.repo AS consumer, p.repo AS producer FROM e c JOIN e p ON c.topic = p.topic AND p.consumes = 0 AND c.repo <> p.repo WHERE c.consumes = 1")(
    lambda t: ln.topics(t.raw("events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 10).alias("repo"), (F.col("user_id") % 2).alias("consumes")).distinct()))
query("l4_unambiguous", "WITH s AS (SELECT p_name || p_brand || p_size AS field, min(p_partkey) AS owner FROM part GROUP BY 1 HAVING count(*) = 1) SELECT field, owner FROM s")(
    lambda t: ln.unambiguous(t.raw("part").select(F.concat("p_name", "p_brand", F.col("p_size").cast("string")).alias("field"), F.col("p_partkey").alias("owner"))))
query("l6_shared_code", """WITH l AS (SELECT DISTINCT source, unnest(string_split(text, chr(10))) AS ident FROM documents), d AS (SELECT * FROM l WHERE length(ident) >= 20),
 s AS (SELECT (SELECT count(DISTINCT source) FROM d) AS n), k AS (SELECT ident, count(*) AS c FROM d GROUP BY ident), u AS (SELECT d.* FROM d JOIN k ON k.ident = d.ident, s WHERE c >= 2 AND NOT (n >= 4 AND c > 0.5 * n)),
 z AS (SELECT source, count(*) AS size FROM d GROUP BY source), p AS (SELECT a.source AS a, b.source AS b, count(*) AS shared FROM u a JOIN u b ON a.ident = b.ident AND a.source < b.source GROUP BY ALL HAVING count(*) >= 3)
 SELECT p.a, p.b, shared, round(shared / (x.size + y.size - shared), 6) AS jaccard FROM p JOIN z x ON x.source = p.a JOIN z y ON y.source = p.b""")(
    lambda t: ln.shared_identities(t.raw("documents").select(F.col("source").alias("repo"), F.explode(F.split("text", "\n", -1)).alias("ident")).filter("length(ident) >= 20").distinct()))
query("l7_materialise", sql("imports", "SELECT src_repo AS consumer, dst_repo AS provider, count(*) AS edges, array_to_string(list_slice(list_sort(list(DISTINCT src || '->' || dst)), 1, 25), ',') AS via FROM imports WHERE src_repo <> dst_repo GROUP BY ALL"))(lambda t: ln.materialise(t.imports))
query("l8_coverage_tally", sql("routes", "SELECT repo, count(*) AS detected, count(*) FILTER (method = '*') AS external, count(*) FILTER (method = 'POST') AS declared, count(*) FILTER (method = 'GET') AS open FROM routes WHERE role = 'client' GROUP BY repo"))(
    lambda t: t.part("routes").filter("role = 'client'").groupBy("repo").agg(F.count(F.lit(1)).alias("detected"), F.count_if(F.col("method") == "*").alias("external"), F.count_if(F.col("method") == "POST").alias("declared")).withColumn("open", F.col("detected") - F.col("external") - F.col("declared")))


def l16(t: Tables):
    """Part n derives from part n // 3, and each fifth part declares the member; part 0 stands for the root of all."""
    part = t.raw("part").select(F.col("p_partkey").alias("child"))
    parents = part.filter("child > 0").select("child", F.floor(F.col("child") / 3).alias("parent"))
    declaring = part.filter("child % 5 = 0").select(F.col("child").alias("name")).union(t.spark.range(1).select(F.col("id").alias("name")))
    return ln.inherited(part, parents, declaring)


query("l16_inherited_calls", "WITH RECURSIVE a(child, anc) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT child, anc // 3 FROM a WHERE anc > 0) SELECT child, max(anc) AS owner FROM a WHERE anc % 5 = 0 GROUP BY child")(
    l16)
query("l20_module_edges", sql("edges", f", o AS (SELECT DISTINCT name, {MODULE} AS m FROM facts WHERE kind = 'symbol') SELECT x.m AS src, y.m AS dst, e.rel, count(*) AS n FROM edges e JOIN o x ON x.name = e.src JOIN o y ON y.name = e.dst WHERE x.m <> y.m GROUP BY ALL"))(
    lambda t: ln.roll_up(t.edges, t.facts.filter("kind = 'symbol'").select("name", F.expr(MODULE).alias("m")).distinct()))
query("l28_unmatched_routes", sql("routes", "SELECT CASE WHEN s.path IN (SELECT path FROM routes WHERE role = 'client') THEN 'matched' WHEN method = '*' THEN 'unjudged' ELSE 'unmatched' END AS verdict, count(*) AS n FROM routes s WHERE role = 'server' GROUP BY 1"))(lambda t: ln.verdicts(t.part("routes")))
