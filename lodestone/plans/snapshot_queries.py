"""D (snapshots), H (history), M (mining), F (flows), S (sources) and K (sinks) rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import graph as g
from ..operators import snapshots as s
from ..sources import text as src
from .adapter import Tables, sql
from .registry import query

OLD, NEW = "day(ts) <= 20", "day(ts) >= 5"
SNAP = f"o AS (SELECT event_type || '/' || (user_id % 20) AS name, event_type AS kind, value::INT AS v FROM events WHERE {OLD}), w AS (SELECT event_type || '/' || (user_id % 20) AS name, event_type AS kind, value::INT AS v FROM events WHERE {NEW})"


def snap(t: Tables, where: str):
    return t.raw("events").filter(where).select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 20).cast("string")).alias("name"), F.col("event_type").alias("kind"), F.rint("value").cast("int").alias("v"))


@query("d1_locate", """WITH sp AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) + 1 AS b FROM conversations WHERE length(text) > 0),
 p AS (SELECT DISTINCT conv_id, (turn * 97 + 1)::BIGINT AS line FROM conversations),
 x AS (SELECT p.conv_id, p.line, sp.turn, row_number() OVER (PARTITION BY p.conv_id, p.line ORDER BY e - b, -b, turn::VARCHAR) AS rk FROM p JOIN sp ON sp.conv_id = p.conv_id AND p.line BETWEEN b AND e) SELECT conv_id, line, turn FROM x WHERE rk = 1""")
def d1(t: Tables):
    """Innermost span of a line; turns of a conversation play spans."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.raw("conversations")
    sp = c.filter("length(text) > 0").withColumn("end_line", F.sum(F.length("text")).over(w)).select(F.col("conv_id").cast("string").alias("file"), (F.col("end_line") - F.length("text") + 1).alias("start_line"), "end_line", F.col("turn").cast("string").alias("name"))
    p = c.select(F.col("conv_id").cast("string").alias("file"), (F.col("turn") * 97 + 1).alias("line")).distinct()
    return g.nested_spans(p, sp).select(F.col("file").cast("long").alias("conv_id"), "line", F.col("name").cast("long").alias("turn"))


@query("d1_nearest_above", "SELECT p.conv_id, p.line, max(c.turn * 100) AS decl FROM (SELECT DISTINCT conv_id, turn * 97 + 50 AS line FROM conversations) p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn * 100 <= p.line GROUP BY ALL")
def d1_nearest(t: Tables):
    """The nearest declaration above: one ordered pass over declarations and points of a file."""
    from pyspark.sql import Window

    c = t.raw("conversations")
    d = c.select("conv_id", (F.col("turn") * 100).alias("line"), (F.col("turn") * 100).alias("decl"), F.lit(0).alias("point"))
    p = c.select("conv_id", (F.col("turn") * 97 + 50).alias("line")).distinct().withColumn("decl", F.lit(None).cast("long")).withColumn("point", F.lit(1))
    w = Window.partitionBy("conv_id").orderBy("line", "point").rowsBetween(Window.unboundedPreceding, 0)
    x = d.unionByName(p).withColumn("decl", F.last("decl", True).over(w))
    return x.filter("point = 1 and decl is not null").select("conv_id", "line", "decl")


@query("d3_stamps", "SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN b.doc_id IS NULL THEN 'gone' WHEN a.doc_id IS NULL THEN 'present' WHEN a.h = b.h THEN 'current' ELSE 'rewritten' END AS stamp FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id")
def d3(t: Tables):
    d = t.raw("documents")
    a = d.filter("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("ha"))
    b = d.filter("doc_id % 5 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hb"))
    return a.join(b, "doc_id", "full").select(F.col("doc_id").alias("id"), F.when(F.col("hb").isNull(), "gone").when(F.col("ha").isNull(), "present").when(F.col("ha") == F.col("hb"), "current").otherwise("rewritten").alias("stamp"))


@query("d4_snapshot_diff", f"WITH {SNAP}, a AS (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY v) AS i FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY v) AS i FROM w), x AS (SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.name, b.name) AS name, CASE WHEN a.i IS NULL THEN 'added' WHEN b.i IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' END AS change FROM a FULL JOIN b ON a.kind = b.kind AND a.name = b.name AND a.i = b.i) SELECT kind, name, change, count(*) AS n FROM x WHERE change IS NOT NULL GROUP BY ALL")
def d4(t: Tables):
    return s.diff_facts(snap(t, OLD), snap(t, NEW), ["kind", "name"], ["v"]).groupBy("kind", "name", "change").agg(F.count(F.lit(1)).alias("n"))


@query("d5_finding_diff", f"WITH {SNAP}, a AS (SELECT DISTINCT kind || '|' || regexp_replace(name, '[0-9]+', '#', 'g') || (v % 9) AS key FROM o WHERE v > 90), b AS (SELECT DISTINCT kind || '|' || regexp_replace(name, '[0-9]+', '#', 'g') || (v % 9) AS key FROM w WHERE v > 92) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'new' WHEN b.key IS NULL THEN 'resolved' ELSE 'kept' END AS bucket FROM a FULL JOIN b ON a.key = b.key")
def d5(t: Tables):
    key = lambda d, least: d.filter(F.col("v") > least).select(F.concat(s.finding_key(F.col("kind"), F.col("name")), (F.col("v") % 9).cast("string")).alias("key")).distinct()
    a, b = key(snap(t, OLD), 90).withColumn("a", F.lit(1)), key(snap(t, NEW), 92).withColumn("b", F.lit(1))
    return a.join(b, "key", "full").select("key", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "resolved").otherwise("kept").alias("bucket"))


@query("d6_counts", f"WITH {SNAP} SELECT kind, count(*) AS facts, count(DISTINCT name) AS names FROM w GROUP BY kind")
def d6(t: Tables):
    return snap(t, NEW).groupBy("kind").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("name").alias("names"))


@query("d8_gate", "WITH f AS (SELECT event_type AS source, value / 100 AS confidence, event_id % 2 = 0 AS informational FROM events), n AS (SELECT count(*) FILTER (source = 'purchase' AND confidence >= 0.99 AND NOT informational) AS failing FROM f) SELECT failing, CASE WHEN failing > 0 THEN 1 ELSE 0 END AS exit_code, CASE WHEN failing > 0 THEN 'regression' ELSE 'clean' END AS status FROM n")
def d8(t: Tables):
    f = t.raw("events").select(F.col("event_type").alias("source"), (F.col("value") / 100).alias("confidence"), (F.col("event_id") % 2 == 0).alias("informational"))
    return s.gate(f, ["purchase"], 0.99)


@query("d9_intersection", f"WITH {SNAP} SELECT kind, name, v FROM o WHERE name NOT IN (SELECT name FROM w WHERE v = 50) EXCEPT ALL SELECT kind, name, v FROM w WHERE name NOT IN (SELECT name FROM w WHERE v = 50)")
def d9(t: Tables):
    """Disputed producers out of both sides, then what only the first holds."""
    new = snap(t, NEW)
    bad = new.filter("v = 50").select("name").distinct()
    keep = lambda d: d.join(bad, "name", "left_anti").select("kind", "name", "v")
    return keep(snap(t, OLD)).exceptAll(keep(new))


@query("d10_ownership", "SELECT event_type AS module, user_id AS author, count(*) AS lines, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share, CASE WHEN count(*) / sum(count(*)) OVER (PARTITION BY event_type) >= 0.01 THEN 'major' ELSE 'minor' END AS role FROM events GROUP BY event_type, user_id")
def d10(t: Tables):
    n = t.raw("events").groupBy(F.col("event_type").alias("module"), F.col("user_id").alias("author")).agg(F.count(F.lit(1)).alias("lines"))
    x = n.join(n.groupBy("module").agg(F.sum("lines").alias("all_lines")), "module").withColumn("s", F.col("lines") / F.col("all_lines"))
    return x.select("module", "author", "lines", F.round("s", 6).alias("share"), F.when(F.col("s") >= 0.01, "major").otherwise("minor").alias("role"))


@query("d11_metric_delta", f"WITH {SNAP}, a AS (SELECT name, count(*) AS n FROM o GROUP BY name), b AS (SELECT name, count(*) AS n FROM w GROUP BY name) SELECT coalesce(a.name, b.name) AS name, coalesce(a.n, 0) AS was, coalesce(b.n, 0) AS now, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.name = b.name")
def d11(t: Tables):
    n = lambda d, c: d.groupBy("name").agg(F.count(F.lit(1)).alias(c))
    return n(snap(t, OLD), "was").join(n(snap(t, NEW), "now"), "name", "full").fillna(0).withColumn("delta", F.col("now") - F.col("was"))


@query("d12_plan_fanin", sql("edges", "SELECT f.file, count(DISTINCT e.src) AS fan_in FROM facts f JOIN edges e ON e.dst = f.name AND e.rel <> 'declares' WHERE f.kind = 'symbol' GROUP BY f.file"))
def d12(t: Tables):
    e = t.edges_of("calls", "depends_on", "imports").select("src", "dst")
    n = e.count()
    x = g.spread(e, n, "dst").join(t.facts.filter("kind = 'symbol'").select("file", F.col("name").alias("dst")).hint("shuffle_hash"), "dst")
    return g.spread(x.select("file", "src"), n, "file", "src").distinct().groupBy("file").agg(F.count("src").alias("fan_in"))


@query("d14_drift", "SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.page_id IS NULL THEN 'removed' WHEN a.page_id IS NULL THEN 'added' ELSE 'changed' END AS drift FROM (SELECT page_id, md5(html) AS h FROM pages WHERE page_id % 7 <> 0) a FULL JOIN (SELECT page_id, md5(CASE WHEN page_id % 6 = 0 THEN url ELSE html END) AS h FROM pages WHERE page_id % 11 <> 0) b ON a.page_id = b.page_id WHERE a.h IS DISTINCT FROM b.h")
def d14(t: Tables):
    p = t.raw("pages")
    old = p.filter("page_id % 7 <> 0").select("page_id", F.col("html").alias("body"))
    new = p.filter("page_id % 11 <> 0").select("page_id", F.when(F.col("page_id") % 6 == 0, F.col("url")).otherwise(F.col("html")).alias("body"))
    return src.drift(old, new, "page_id")


@query("d15_touched", "SELECT user_id % 30 AS symbol, count(DISTINCT ts::DATE) AS commits FROM events GROUP BY 1 ORDER BY commits DESC, symbol LIMIT 10")
def d15(t: Tables):
    return t.raw("events").groupBy((F.col("user_id") % 30).alias("symbol")).agg(F.countDistinct(F.to_date("ts")).alias("commits")).orderBy(F.desc("commits"), "symbol").limit(10)


@query("d16_status", sql("edges", "SELECT 'facts' AS what, count(*) AS n FROM facts UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'unresolved', count(*) FROM edges WHERE dst NOT IN (SELECT name FROM facts)"))
def d16(t: Tables):
    one = lambda d, name: d.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    lost = t.edges.join(t.facts.select(F.col("name").alias("dst")).distinct(), "dst", "left_anti")
    return one(t.facts, "facts").unionByName(one(t.edges, "edges")).unionByName(one(lost, "unresolved"))


def lines(t: Tables, where: str):
    return t.raw("events").filter(where).select(F.concat("event_type", F.lit(":"), (F.col("user_id") % 40).cast("string")).alias("line"))


LINES = "a AS (SELECT event_type || ':' || (user_id % 40) AS line FROM events WHERE {o}), b AS (SELECT event_type || ':' || (user_id % 40) AS line FROM events WHERE {n})".format(o=OLD, n=NEW)


@query("h1_patch", f"WITH {LINES}, d AS (SELECT line, sum(s) AS d FROM (SELECT line, -1 AS s FROM a UNION ALL SELECT line, 1 FROM b) GROUP BY line) SELECT line, CASE WHEN d > 0 THEN '+' ELSE '-' END AS sign, abs(d)::BIGINT AS n FROM d WHERE d <> 0")
def h1(t: Tables):
    return s.patch(lines(t, OLD), lines(t, NEW))


@query("h1_apply", f"WITH {LINES} SELECT line, count(*) AS n FROM b GROUP BY line")
def h1_apply(t: Tables):
    old = lines(t, OLD)
    return s.apply_patch(old, s.patch(old, lines(t, NEW)))


@query("h2_log", "SELECT day(ts)::BIGINT AS rev, count(*) AS lines, sum(count(*)) OVER (ORDER BY day(ts))::BIGINT AS total FROM events GROUP BY day(ts)")
def h2(t: Tables):
    """The revision log with running totals; one row per revision."""
    from pyspark.sql import Window

    n = t.raw("events").groupBy(F.dayofmonth("ts").cast("long").alias("rev")).agg(F.count(F.lit(1)).alias("lines"))
    return n.withColumn("total", F.sum("lines").over(Window.orderBy("rev")))


@query("h3_blame", "WITH r AS (SELECT DISTINCT day(ts)::BIGINT AS rev, event_type || user_id AS line FROM events) SELECT line, min(rev) AS first, max(rev) AS last, CASE WHEN max(rev) < (SELECT max(rev) FROM r) THEN max(rev) + 1 END AS gone FROM r GROUP BY line")
def h3(t: Tables):
    return s.blame(t.raw("events").select(F.dayofmonth("ts").cast("long").alias("rev"), F.concat("event_type", F.col("user_id").cast("string")).alias("line")).distinct())


@query("h5_hash_chain", "WITH RECURSIVE r AS (SELECT day(ts)::BIGINT AS rev, count(*) AS n FROM events GROUP BY 1), c(rev, digest) AS (SELECT rev, sha256(n::VARCHAR) FROM r WHERE rev = 1 UNION ALL SELECT r.rev, sha256(c.digest || r.n::VARCHAR) FROM c JOIN r ON r.rev = c.rev + 1) SELECT rev, digest FROM c")
def h5(t: Tables):
    """Hash-chained records: a fold over the ordered log. The log has one entry per revision."""
    n = t.raw("events").groupBy(F.dayofmonth("ts").cast("long").alias("rev")).agg(F.count(F.lit(1)).alias("n"))
    log = n.agg(F.sort_array(F.collect_list(F.struct("rev", "n"))).alias("log"))
    link = lambda acc, r: F.concat(acc, F.array(F.struct(r["rev"].alias("rev"), F.sha2(F.concat(F.coalesce(F.element_at(acc, -1)["digest"], F.lit("")), r["n"].cast("string")), 256).alias("digest"))))
    start = F.array(F.struct(F.lit(0).cast("long").alias("rev"), F.lit("").alias("digest")))
    return log.select(F.explode(F.aggregate("log", start, link)).alias("x")).select("x.rev", "x.digest").filter("rev > 0")


@query("h6_union", "SELECT event_id, min(side) AS side FROM (SELECT event_id, 'local' AS side FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'shared' FROM events WHERE event_id % 2 = 0) GROUP BY event_id")
def h6(t: Tables):
    e = t.raw("events")
    return e.filter("event_id % 3 <> 0").select("event_id", F.lit("local").alias("side")).unionByName(e.filter("event_id % 2 = 0").select("event_id", F.lit("shared").alias("side"))).groupBy("event_id").agg(F.min("side").alias("side"))


RULE = "WITH p AS (SELECT *, '{x}' FROM part), t AS (SELECT count(*) AS total FROM part), l AS (SELECT {a} AS a, count(*) AS support FROM part GROUP BY 1), r AS (SELECT {b} AS b, count(*) AS base FROM part GROUP BY 1), x AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM part GROUP BY 1, 2) SELECT x.a::VARCHAR AS if_value, x.b::VARCHAR AS then_value, support, n, round(n / support, 6) AS confidence FROM x JOIN l ON l.a = x.a JOIN r ON r.b = x.b, t WHERE support >= 10 AND n / support >= {c} AND support - n <= 20000 AND n / support > base / total"


@query("m1_rules", RULE.format(x="", a="p_brand", b="p_size > 10", c=0.8))
def m1(t: Tables):
    return s.mined_rules(t.raw("part").select("p_brand", (F.col("p_size") > 10).alias("big")), "p_brand", "big", confidence=0.8, exceptions=20000)


@query("m2_implications", RULE.format(x="", a="p_type", b="p_brand", c=0.04))
def m2(t: Tables):
    return s.mined_rules(t.raw("part"), "p_type", "p_brand", confidence=0.04, exceptions=20000)


@query("m3_naming", sql("facts", ", n AS (SELECT kind AS cluster, count(*) AS size FROM facts GROUP BY 1), p AS (SELECT kind AS cluster, regexp_extract(name, '^[^.#/ ]+') || '*' AS pattern, count(*) AS n FROM facts GROUP BY ALL) SELECT p.cluster, pattern, n, size FROM p JOIN n ON n.cluster = p.cluster WHERE size >= 10 AND n / size >= 0.5"))
def m3(t: Tables):
    return s.naming_patterns(t.facts.select(F.col("kind").alias("cluster"), "name"), 10, 0.5)


@query("m4_edge_rates", sql("edges", "SELECT regexp_extract(src, '^[A-Za-z]+') AS a, regexp_extract(dst, '^[A-Za-z]+') AS b, rel, count(*) AS n FROM edges GROUP BY ALL"))
def m4(t: Tables):
    w = lambda c: F.regexp_extract(c, "^[A-Za-z]+", 0)
    return t.edges.groupBy(w("src").alias("a"), w("dst").alias("b"), "rel").agg(F.count(F.lit(1)).alias("n"))


@query("m5_method_presence", "SELECT event_type AS method, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS rate FROM events GROUP BY event_type")
def m5(t: Tables):
    e = t.raw("events")
    return e.groupBy(F.col("event_type").alias("method")).agg(F.countDistinct("user_id").alias("n")).join(F.broadcast(e.agg(F.countDistinct("user_id").alias("all_users")))).select("method", F.round(F.col("n") / F.col("all_users"), 6).alias("rate"))


FLOW = ", r AS (SELECT s.src AS root, c.dst AS key FROM edges s JOIN edges c ON c.src = s.dst AND c.rel = 'calls' WHERE s.rel = 'depends_on' UNION SELECT src, dst FROM edges WHERE rel = 'depends_on')"


def reach(t: Tables):
    """(root, key): what each root reaches in two hops over the vias."""
    e = t.edges_of("depends_on").select(F.col("src").alias("root"), F.col("dst").alias("key")).distinct()
    calls = t.edges_of("calls").select(F.col("src").alias("key"), F.col("dst").alias("next"))
    return e.join(calls, "key").select("root", F.col("next").alias("key")).unionByName(e).distinct()


def flows(t: Tables):
    """What each root reaches in two hops, counted."""
    e = t.edges_of("depends_on").select(F.col("src").alias("root"), F.col("dst").alias("key"))
    return s.flow_reach(e, t.edges_of("calls").select("src", "dst").distinct(), lambda c: F.regexp_extract(c, "^[A-Za-z]+", 0))


@query("f1_flows", sql("edges", FLOW + " SELECT root, count(*) AS reach FROM r GROUP BY root"))
def f1(t: Tables):
    return flows(t).select(F.col("name").alias("root"), "reach")


@query("f2_rank", sql("edges", FLOW + ", f AS (SELECT root AS name, count(*) AS reach, count(DISTINCT regexp_extract(key, '^[A-Za-z]+')) AS modules FROM r GROUP BY root) SELECT name, reach, modules, row_number() OVER (ORDER BY reach DESC, modules DESC, name) AS rank FROM f"))
def f2(t: Tables):
    return s.flow_rank(flows(t).withColumn("side", F.lit(False)).withColumn("kind", F.lit("route"))).select("name", "reach", "modules", "rank")


@query("f3_same_reach", sql("depends", ", z AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS sig FROM depends GROUP BY src) SELECT min(src) AS first, count(*) AS roots FROM z GROUP BY sig"))
def f3(t: Tables):
    return s.same_reach(t.part("depends").select(F.col("src").alias("root"), F.col("dst").alias("key")))


@query("f5_external", sql("edges", "SELECT rel, count(*) FILTER (dst NOT IN (SELECT name FROM facts)) AS unresolved, count(*) AS detected FROM edges GROUP BY rel"))
def f5(t: Tables):
    known = t.facts.select(F.col("name").alias("dst"), F.lit(True).alias("known")).distinct()
    return t.edges.join(known, "dst", "left").groupBy("rel").agg(F.count_if(F.col("known").isNull()).alias("unresolved"), F.count(F.lit(1)).alias("detected"))


@query("f6_through", sql("edges", FLOW + " SELECT root FROM r WHERE key = 'Part.5'"))
def f6(t: Tables):
    return reach(t).filter("key = 'Part.5'").select("root")


@query("s30_manifest", "SELECT page_id, sha256(html) AS digest FROM pages")
def s30(t: Tables):
    return src.manifest(t.raw("pages").select("page_id", F.col("html").alias("body")), "page_id")


@query("k1_total_order", sql("facts", """, f AS (SELECT repo, file, md5(string_agg(kind || '|' || name || '|' || line, ';' ORDER BY kind, line, name)) AS d FROM facts GROUP BY ALL), r AS (SELECT repo, md5(string_agg(file || ':' || d, ';' ORDER BY file)) AS d FROM f GROUP BY repo)
 SELECT md5(string_agg(repo || ':' || d, ';' ORDER BY repo)) AS digest FROM r"""))
def k1(t: Tables):
    """The digest that names a snapshot: of all facts in one total order, file by file, repository by repository, so no list holds more
    than a file's facts or a repository's files."""

    def fold(df, by, row, text):
        rows = F.sort_array(F.collect_list(F.struct(*row)))
        return df.groupBy(*by).agg(F.md5(F.array_join(F.transform(rows, text), ";")).alias("d"))

    f = fold(t.facts, ["repo", "file"], ["kind", "line", "name"], lambda v: F.concat_ws("|", v["kind"], v["name"], v["line"].cast("string")))
    r = fold(f, ["repo"], ["file", "d"], lambda v: F.concat_ws(":", v["file"], v["d"]))
    return fold(r, [], ["repo", "d"], lambda v: F.concat_ws(":", v["repo"], v["d"])).select(F.col("d").alias("digest"))


@query("fn_identity", sql("facts", "SELECT name, file, substr(sha256(repo || chr(1) || kind || chr(1) || name || chr(1) || file), 1, 32) AS id FROM facts"))
def fn_identity(t: Tables):
    return t.facts.select("name", "file", fn.fact_id(F.col("repo"), F.col("kind"), F.col("name"), F.col("file"), sep="\x01").alias("id"))


@query("fn_short_name", sql("facts", "SELECT DISTINCT name, regexp_extract(name, '[^.#/]*$') AS short FROM facts"))
def fn_short(t: Tables):
    return t.facts.select("name", fn.short_name(F.col("name")).alias("short")).distinct()
