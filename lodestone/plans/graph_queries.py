"""G rows: walks, paths, components, degrees."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import links as ln
from .adapter import Tables, sql
from .registry import query


def keys(t: Tables, *names: str):
    return t.spark.createDataFrame([(n,) for n in names], "key string")


WALK = """, w(key, depth) AS (SELECT '{seed}', 0 UNION SELECT e.{to}, w.depth + 1 FROM w JOIN {edges} e ON e.{of} = w.key WHERE w.depth < {depth})"""


def walk(seed: str, depth: int, edges: str = "(SELECT * FROM edges)", reverse: bool = False) -> str:
    return WALK.format(seed=seed, depth=depth, edges=edges, of="dst" if reverse else "src", to="src" if reverse else "dst")


@query("g1_build_edges", sql("edges", "SELECT rel, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM (SELECT DISTINCT * FROM edges) GROUP BY rel"))
def g1(t: Tables):
    """Edges rebuilt from relations nested in facts, then counted by kind."""
    held = g.spread(t.edges, t.edges.count(), "src").groupBy("src").agg(F.collect_list(F.struct(F.col("rel").alias("kind"), F.col("dst").alias("target"))).alias("relations"))
    facts = held.select(F.col("src").alias("name"), F.lit("symbol").alias("kind"), F.lit("r").alias("repo"), "relations")
    return g.build_edges(facts).groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("g1a_module_of_file", sql("facts", """, f AS (SELECT DISTINCT file AS path FROM facts WHERE kind = 'symbol'), m AS (SELECT DISTINCT name AS module FROM facts WHERE kind = 'module')
 SELECT path, module FROM (SELECT path, module, row_number() OVER (PARTITION BY path ORDER BY length(module) DESC) AS rk FROM f JOIN m ON path = module OR starts_with(path, module || '/')) WHERE rk = 1"""))
def g1a(t: Tables):
    return g.nearest_ancestor(t.facts.filter("kind = 'symbol'").select(F.col("file").alias("path")).distinct(), t.facts.filter("kind = 'module'").select(F.col("name").alias("module")))


@query("g1b_has_method", """SELECT split_part(name, '.', 1) AS owner, name AS member FROM (SELECT 'T' || (user_id % 50) || '.' || event_type AS name FROM events GROUP BY 1) WHERE name <> 'T7.click'""")
def g1b(t: Tables):
    names = t.raw("events").select(F.concat(F.lit("T"), (F.col("user_id") % 50).cast("string"), F.lit("."), "event_type").alias("name")).distinct().filter("name <> 'T7.click'")
    return g.owners_of_methods(names, t.spark.range(50).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("name")))


@query("g1c_dropped_edges", sql("edges", "SELECT e.rel, count(*) AS n FROM edges e JOIN (SELECT DISTINCT name FROM facts WHERE kind = 'module') m ON m.name = e.dst WHERE NOT (e.rel = 'declares' AND starts_with(e.dst, 'part/')) GROUP BY e.rel"))
def g1c(t: Tables):
    """Edges into modules less those that a rule drops."""
    into = t.edges.join(t.facts.filter("kind = 'module'").select(F.col("name").alias("dst")).distinct(), "dst", "left_semi")
    return into.join(into.filter("rel = 'declares' and startswith(dst, 'part/')"), ["src", "rel", "dst"], "left_anti").groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("g2_traverse", sql("imports", walk("nation/NATION_10", 4, "imports") + " SELECT key, min(depth) AS depth FROM w GROUP BY key", True))
def g2(t: Tables):
    return g.traverse(t.imports.withColumn("rel", F.lit("imports")), keys(t, "nation/NATION_10"), 4)


@query("g3_traverse_seeds", sql("edges", ", s AS (SELECT src AS key, 0 AS depth FROM edges WHERE dst = 'nation/NATION_3' AND rel = 'declares' AND starts_with(src, 'Supplier')), h AS (SELECT DISTINCT e.dst AS key, 1 AS depth FROM s JOIN edges e ON e.src = s.key AND e.rel = 'calls') SELECT * FROM s UNION SELECT * FROM h"))
def g3(t: Tables):
    seeds = t.edges.filter("dst = 'nation/NATION_3' and rel = 'declares' and startswith(src, 'Supplier')").select(F.col("src").alias("key"))
    return g.traverse(t.edges, seeds, 1, rels=["calls"])


PATHS = """, p(key, path, hops) AS (SELECT src, [src], 0 FROM (SELECT DISTINCT src FROM imports WHERE src {src}) UNION ALL
 SELECT i.dst, list_append(p.path, i.dst), hops + 1 FROM p JOIN (SELECT DISTINCT src, dst FROM imports) i ON i.src = p.key WHERE hops < {depth} AND NOT list_contains(p.path, i.dst)),
 b AS (SELECT key, hops, path, row_number() OVER (PARTITION BY key ORDER BY hops, path) AS rk FROM p)
 SELECT key, hops, array_to_string(path, '>') AS path FROM b WHERE rk = 1 AND {dst}"""


@query("g4_find_path", sql("imports", PATHS.format(src="= 'nation/NATION_10'", depth=4, dst="hops > 0"), True))
def g4(t: Tables):
    e = t.imports.withColumn("rel", F.lit("imports"))
    start = keys(t, "nation/NATION_10")
    return g.shortest_paths(e, start, e.select(F.col("dst").alias("key")), 4).filter("hops > 0").withColumn("path", F.array_join("path", ">"))


@query("g5_path_between_sets", sql("imports", PATHS.format(src="< 'nation/NATION_13'", depth=3, dst="key > 'nation/NATION_6'"), True))
def g5(t: Tables):
    e = t.imports.withColumn("rel", F.lit("imports"))
    return g.shortest_paths(e, e.filter("src < 'nation/NATION_13'").select(F.col("src").alias("key")), e.filter("dst > 'nation/NATION_6'").select(F.col("dst").alias("key")), 3).withColumn("path", F.array_join("path", ">"))


@query("g6_rollup_seeds", """SELECT DISTINCT 'T7.' || event_type AS key FROM events WHERE user_id % 50 = 7 UNION SELECT 'T7' UNION SELECT 'pkg.NewT7'""")
def g6(t: Tables):
    names = t.raw("events").select(F.concat(F.lit("T"), (F.col("user_id") % 50).cast("string"), F.lit("."), "event_type").alias("name")).distinct()
    facts = t.spark.createDataFrame([("T7",), ("pkg.NewT7",), ("T8",)], "name string")
    return g.rollup_seeds(g.owners_of_methods(names, facts), facts, "T7")


@query("g7_impact", sql("edges", walk("Part.5", 2, "(SELECT * FROM edges WHERE rel IN ('calls', 'depends_on'))", True) + """, m AS (SELECT key, min(depth) AS depth FROM w GROUP BY key)
 SELECT m.depth, f.kind, f.repo, count(*) AS dependents FROM m JOIN facts f ON f.name = m.key WHERE m.depth > 0 GROUP BY ALL""", True))
def g7(t: Tables):
    got = g.impact(t.edges, t.facts, keys(t, "Part.5"), 2, ["calls", "depends_on"])
    return got.groupBy("depth", "kind", "repo").agg(F.count(F.lit(1)).alias("dependents"))


@query("g8_impact_of_file", sql("edges", ", s AS (SELECT name FROM facts WHERE file = 'nation/NATION_3/supplier.src') SELECT f.repo, count(DISTINCT e.src) AS dependents FROM s JOIN edges e ON e.dst = s.name AND e.rel = 'depends_on' JOIN facts f ON f.name = e.src GROUP BY f.repo"))
def g8(t: Tables):
    seeds = t.facts.filter("file = 'nation/NATION_3/supplier.src'").select(F.col("name").alias("key"))
    return g.impact(t.edges, t.facts, seeds, 1, ["depends_on"]).groupBy("repo").agg(F.countDistinct("key").alias("dependents"))


@query("g9_affected_endpoints", sql("edges", walk("Supplier.2", 1, "(SELECT * FROM edges WHERE rel = 'depends_on')", True) + " SELECT DISTINCT key, CAST(substr(key, 10) AS BIGINT) % 250 AS page_id FROM w JOIN pages p ON p.page_id = CAST(substr(key, 10) AS BIGINT) % 250 WHERE depth = 1", True))
def g9(t: Tables):
    """Endpoints whose handlers reach a seed; a customer handles the page of its number."""
    reach = g.traverse(t.edges, keys(t, "Supplier.2"), 1, True, ["depends_on"]).filter("depth = 1")
    return reach.select("key", (F.substring("key", 10, 20).cast("long") % 250).alias("page_id")).join(t.raw("pages").select("page_id"), "page_id", "left_semi")


@query("g10_endpoint_impact", sql("routes", "SELECT c.path, count(DISTINCT c.page_id) AS callers, count(DISTINCT s.page_id) AS servers FROM routes c JOIN routes s ON s.path = c.path AND s.role = 'server' WHERE c.role = 'client' GROUP BY c.path"))
def g10(t: Tables):
    r = t.part("routes")
    c, s = r.filter("role = 'client'").select("path", "page_id"), r.filter("role = 'server'").select("path", F.col("page_id").alias("sid"))
    return c.join(s, "path").groupBy("path").agg(F.countDistinct("page_id").alias("callers"), F.countDistinct("sid").alias("servers"))


@query("g11_reverse_reach", sql("imports", walk("nation/NATION_9", 6, "imports", True) + " SELECT key, min(depth) AS depth FROM w GROUP BY key", True))
def g11(t: Tables):
    return g.traverse(t.imports.withColumn("rel", F.lit("imports")), keys(t, "nation/NATION_9"), 6, True)


ARCH = "rel NOT IN ('declares')"
DEG = ", i AS (SELECT dst AS key, count(*) AS fan_in FROM edges WHERE {w} GROUP BY dst), o AS (SELECT src AS key, count(*) AS fan_out FROM edges WHERE {w} GROUP BY src), d AS (SELECT coalesce(i.key, o.key) AS key, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM i FULL JOIN o ON i.key = o.key)"


@query("g12_degrees", sql("edges", DEG.format(w=ARCH) + " SELECT * FROM d"))
def g12(t: Tables):
    return g.degrees(t.edges_of("calls", "depends_on", "imports"))


@query("g13_adjacency", sql("edges", "SELECT rel, dst FROM edges WHERE src = 'Customer.7'"))
def g13(t: Tables):
    return t.edges.filter("src = 'Customer.7'").select("rel", "dst")


@query("g14_node_choice", sql("facts", "SELECT name, kind, repo FROM (SELECT name, kind, repo, row_number() OVER (PARTITION BY name ORDER BY CASE kind WHEN 'service' THEN 0 WHEN 'module' THEN 1 ELSE 2 END, repo, file, line) AS rk FROM facts) WHERE rk = 1"))
def g14(t: Tables):
    """One declaration for each name, by kind and then place."""
    rank = F.when(F.col("kind") == "service", 0).when(F.col("kind") == "module", 1).otherwise(2)
    return t.facts.groupBy("name").agg(F.min_by(F.struct("kind", "repo"), F.struct(rank, F.col("repo"), F.col("file"), F.col("line"))).alias("x")).select("name", "x.kind", "x.repo")


REACH = ", r(src, dst) AS (SELECT src, dst FROM imports UNION SELECT r.src, i.dst FROM r JOIN imports i ON i.src = r.dst), c AS (SELECT a.src AS key, least(min(a.dst), a.src) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)"


@query("g15_scc", sql("imports", REACH + " SELECT key, component FROM c", True))
def g15(t: Tables):
    return g.strongly_connected(t.imports)


@query("g16_module_graph", sql("edges", """, f AS (SELECT DISTINCT name, regexp_replace(file, '/[a-z]+[.]src$', '') AS m FROM facts WHERE kind = 'symbol') SELECT a.m AS src, b.m AS dst, count(*) AS n FROM edges e JOIN f a ON a.name = e.src JOIN f b ON b.name = e.dst WHERE e.rel = 'calls' AND a.m <> b.m GROUP BY ALL"""))
def g16(t: Tables):
    """Symbol edges as edges of the modules that declare their ends."""
    own = t.facts.filter("kind = 'symbol'").select("name", F.regexp_replace("file", "/[a-z]+[.]src$", "").alias("m")).distinct()
    return ln.roll_up(t.edges_of("calls"), own).select("src", "dst", "n")


DEPTH = REACH + """, z AS (SELECT DISTINCT key FROM (SELECT src AS key FROM imports UNION SELECT dst FROM imports)), k AS (SELECT z.key, coalesce(c.component, z.key) AS component FROM z LEFT JOIN c ON c.key = z.key),
 wt AS (SELECT component, CASE WHEN count(*) > 8 THEN 0 ELSE count(*) END AS weight FROM k GROUP BY component),
 dag AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM imports i JOIN k a ON a.key = i.src JOIN k b ON b.key = i.dst JOIN wt ON wt.component = a.component WHERE a.component <> b.component AND wt.weight > 0),
 ch(component, tip, length) AS (SELECT component, component, weight FROM wt UNION SELECT ch.component, dag.dst, ch.length + wt.weight FROM ch JOIN dag ON dag.src = ch.tip JOIN wt ON wt.component = dag.dst)
 SELECT component, max(length) AS length FROM ch GROUP BY component"""


@query("g17_longest_path", sql("imports", DEPTH, True))
def g17(t: Tables):
    return g.longest_chains(t.imports)


@query("g18_shortest_cycle", sql("imports", """, p(start, tip, hops) AS (SELECT src, dst, 1 FROM imports UNION SELECT p.start, i.dst, p.hops + 1 FROM p JOIN imports i ON i.src = p.tip WHERE p.hops < 30 AND p.tip <> p.start) SELECT start AS key, min(hops) AS cycle FROM p WHERE start = tip GROUP BY start""", True))
def g18(t: Tables):
    """Hops of the shortest cycle through each module."""
    return g.shortest_cycles(t.imports)


@query("g19_governing", sql("facts", """, a AS (SELECT 'page' || n_nationkey AS page, 'nation/' || n_name AS anchor FROM nation WHERE n_nationkey % 3 = 0) SELECT DISTINCT f.file, a.page FROM facts f JOIN a ON f.file = a.anchor OR starts_with(f.file, a.anchor || '/')"""))
def g19(t: Tables):
    """Pages whose anchor is the file or a directory above it."""
    pages = t.raw("nation").filter("n_nationkey % 3 = 0").select(F.concat(F.lit("page"), F.col("n_nationkey").cast("string")).alias("page"), F.concat(F.lit("nation/"), "n_name").alias("module"))
    parts = F.split("file", "/")
    pre = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return t.facts.select("file").distinct().select("file", F.explode(pre).alias("module")).join(pages, "module").select("file", "page").distinct()


@query("g20_areas", sql("facts", "SELECT repo || '/' || split_part(file, '/', 1) AS area, count(*) AS n FROM facts GROUP BY 1"))
def g20(t: Tables):
    return t.facts.groupBy(F.concat_ws("/", "repo", F.split("file", "/")[0]).alias("area")).agg(F.count(F.lit(1)).alias("n"))


@query("g21_hierarchy", """WITH RECURSIVE h(child, parent) AS (SELECT p_partkey, p_partkey // 7 FROM part WHERE p_partkey > 0), a(child, anc, depth) AS (SELECT child, parent, 1 FROM h UNION ALL SELECT a.child, h.parent, depth + 1 FROM a JOIN h ON h.child = a.anc)
 SELECT child, min(anc) AS top, max(depth) AS levels FROM a GROUP BY child""")
def g21(t: Tables):
    """A type tree (each part extends the one of a seventh of its number): every type's root and level."""
    h = t.raw("part").filter("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 7).alias("parent"))
    front = g.checkpointed(h.select("child", F.col("parent").alias("anc"), F.lit(1).alias("depth")))
    done = front
    while not front.isEmpty():
        front = g.checkpointed(front.join(h.select(F.col("child").alias("anc"), "parent"), "anc").select("child", F.col("parent").alias("anc"), (F.col("depth") + 1).alias("depth")))
        done = done.unionByName(front)
    return done.groupBy("child").agg(F.min("anc").alias("top"), F.max("depth").alias("levels"))


@query("g22_node_keys", sql("facts", """, o AS (SELECT DISTINCT name, repo FROM facts), n AS (SELECT name, count(*) AS n FROM o GROUP BY name) SELECT o.name, o.repo, CASE WHEN n > 1 THEN 'repo:' || o.repo || ' ' || o.name ELSE o.name END AS key FROM o JOIN n ON n.name = o.name"""))
def g22(t: Tables):
    return g.node_keys(t.facts)


@query("g22_keyed_edges", sql("edges", """, o AS (SELECT DISTINCT name, repo FROM facts), n AS (SELECT name, count(*) AS n FROM o GROUP BY name), k AS (SELECT o.name, o.repo, CASE WHEN n > 1 THEN 'repo:' || o.repo || ' ' || o.name ELSE o.name END AS key FROM o JOIN n ON n.name = o.name),
 x AS (SELECT s.key AS src_key, e.rel, d.key AS dst_key, s.repo AS sr, d.repo AS dr, bool_or(s.repo = d.repo) OVER (PARTITION BY s.key, e.rel, e.dst) AS own FROM edges e JOIN k s ON s.name = e.src JOIN k d ON d.name = e.dst) SELECT DISTINCT src_key, rel, dst_key FROM x WHERE NOT own OR sr = dr"""))
def g22_edges(t: Tables):
    return g.keyed_edges(t.edges, t.facts)
