"""Q rows: queries over facts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import query as q
from .adapter import Tables, sql
from .registry import query

COLS = ("repo", "kind", "name", "file", "line")


def simple(name: str, opts: q.QueryOpts, where: str) -> None:
    query(name, sql("facts", f"SELECT repo, kind, name, file, line FROM facts WHERE {where}"))(lambda t, o=opts: q.matches(t.facts, o).select(*COLS))


simple("q2_kinds", q.QueryOpts(kinds=["module", "service"]), "kind IN ('module', 'service')")
simple("q3_repo", q.QueryOpts(repo="ASIA"), "repo = 'ASIA'")
simple("q4_files", q.QueryOpts(files=["nation/NATION_3"], file_prefix="part/Brand#1"), "file = 'nation/NATION_3' OR starts_with(file, 'part/Brand#1')")
simple("q5_names", q.QueryOpts(name="SUPPLIER.1", names=["Part.7", "Part.8"]), "name IN ('Part.7', 'Part.8') OR contains(lower(name), 'supplier.1')")
simple("q6_prop_number", q.QueryOpts(kinds=["symbol"], prop="cyclomatic", prop_value="30", prop_op="ge"), "kind = 'symbol' AND cyclomatic >= 30")
simple("q6_prop_prefix", q.QueryOpts(prop="symbol_kind", prop_value="s", prop_op="prefix"), "starts_with(symbol_kind, 's')")
simple("q6_prop_contains", q.QueryOpts(prop="symbol_kind", prop_value="la", prop_op="contains"), "contains(symbol_kind, 'la')")
simple("q6_prop_ne", q.QueryOpts(prop="symbol_kind", prop_value="function", prop_op="ne"), "symbol_kind <> 'function'")
simple("q6_prop_version", q.QueryOpts(prop="version", prop_value="1.9", prop_op="gt"),
       "list_transform(string_split(version, '.'), lambda x: x::INT) > [1, 9]")
simple("q9_each", q.QueryOpts(kinds=["symbol"], prop="exported", prop_value="false"), "kind = 'symbol' AND NOT exported")
simple("q10_exact", q.QueryOpts(names=["Supplier.3"]), "name = 'Supplier.3'")
simple("q12_by_key", q.QueryOpts(kinds=["module"], repo="EUROPE"), "kind = 'module' AND repo = 'EUROPE'")


@query("q1_query_facts", sql("facts", ", m AS (SELECT * FROM facts WHERE kind = 'symbol' AND repo = 'ASIA' AND contains(lower(name), 'part.1')) SELECT repo, kind, name, file, line, (SELECT count(*) FROM m) AS total FROM m ORDER BY repo, kind, file, line, name LIMIT 500 OFFSET 5"))
def q1(t: Tables):
    found = q.matches(t.facts, q.QueryOpts(kinds=["symbol"], repo="ASIA", name="Part.1"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return q.page(found, 5, 10_000).select(*COLS).join(F.broadcast(total))  # one row


@query("q8_page", sql("facts", "SELECT repo, kind, name, file, line FROM facts ORDER BY repo, kind, file, line, name LIMIT 100 OFFSET 40"))
def q8(t: Tables):
    return q.page(t.facts, 40).select(*COLS)


@query("q11_reverse_lookup", sql("edges", "SELECT src, rel, dst FROM edges WHERE dst = 'Part.11' AND rel = 'calls'"))
def q11(t: Tables):
    return q.reverse_lookup(t.edges, "Part.11", "calls").select("src", "rel", "dst")


@query("q13_counts", sql("facts", "SELECT repo, count(*) AS facts, count(DISTINCT file) AS files, count(DISTINCT kind) AS kinds FROM facts GROUP BY repo"))
def q13(t: Tables):
    return t.facts.groupBy("repo").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("file").alias("files"), F.countDistinct("kind").alias("kinds"))


@query("q14_summary", sql("facts", "SELECT symbol_kind, count(*) AS n FROM facts GROUP BY symbol_kind"))
def q14(t: Tables):
    return q.summary(t.facts, "symbol_kind")


@query("q14_flags", sql("facts", "SELECT 'exported' AS flag, count(*) FILTER (exported) AS yes, count(*) FILTER (NOT exported) AS no, count(*) FILTER (exported IS NULL) AS absent FROM facts"))
def q14_flags(t: Tables):
    return q.flags(t.facts, ["exported"])


@query("q15_include_related", sql("edges", """, f AS (SELECT * FROM facts WHERE kind = 'symbol' AND repo = 'ASIA' AND contains(lower(name), 'supplier')),
 h AS (SELECT f.name AS from_name, e.dst AS target, row_number() OVER (PARTITION BY e.dst ORDER BY f.repo, f.kind, f.file, f.line, f.name, e.rel) AS rk FROM f JOIN edges e ON e.src = f.name)
 SELECT h.from_name, h.target, g.kind AS target_kind, g.repo AS target_repo FROM h JOIN facts g ON g.name = h.target WHERE rk = 1"""))
def q15(t: Tables):
    return q.include_related(q.matches(t.facts, q.QueryOpts(kinds=["symbol"], repo="ASIA", name="supplier")), t.edges, t.facts)


@query("q17_explore_module", sql("edges", """SELECT e.src, e.rel, f.kind, f.repo FROM edges e JOIN facts f ON f.name = e.src WHERE e.dst = 'nation/NATION_3'"""))
def q17(t: Tables):
    """Focus on a module: what declares itself in it or imports it."""
    return t.edges.filter(F.col("dst") == "nation/NATION_3").join(t.facts.select(F.col("name").alias("src"), "kind", "repo"), "src").select("src", "rel", "kind", "repo")


@query("q18_show_symbol", """SELECT doc_id, list_aggregate(list_slice(string_split(coalesce(text, ''), chr(10)), 2, 4), 'string_agg', chr(10)) AS src_window FROM documents WHERE len(string_split(text, chr(10))) >= 2""")
def q18(t: Tables):
    """A window of source lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return t.raw("documents").filter(F.size(F.split("text", "\n", -1)) >= 2).select("doc_id", F.array_join(F.slice(lines, 2, 3), "\n").alias("src_window"))


@query("q19_resolve", sql("facts", """, s AS (SELECT name, kind, repo, CASE WHEN lower(name) = 'part/brand#11' THEN 2.0 WHEN regexp_extract(lower(name), '[^.#/]*$') = 'part/brand#11' OR ends_with(lower(name), '.part/brand#11') OR ends_with(lower(name), '#part/brand#11') OR ends_with(lower(name), '/part/brand#11') THEN 1.0 WHEN contains(lower(name), 'part/brand#11') THEN 0.0 END
 + CASE WHEN contains(name, 'part/Brand#11') THEN 0.3 ELSE 0.0 END AS score FROM facts) SELECT name, kind, repo, round(score, 2)::DOUBLE AS score FROM s WHERE score IS NOT NULL"""))
def q19(t: Tables):
    return q.resolve(t.facts, "part/Brand#11").withColumn("score", F.round("score", 2))


@query("q20_mutate", sql("facts", "SELECT CASE WHEN repo = 'ASIA' THEN 'APAC' ELSE repo END AS repo, count(*) AS n, count(*) FILTER (repo = 'ASIA' AND exported) AS tagged FROM facts WHERE NOT (kind = 'symbol' AND line < 50) GROUP BY 1"))
def q20(t: Tables):
    """Remove where, set the repository of a range, tag where: each a projection or filter of an immutable table."""
    f = t.facts.filter(~((F.col("kind") == "symbol") & (F.col("line") < 50)))
    f = f.withColumn("tag", (F.col("repo") == "ASIA") & F.col("exported")).withColumn("repo", F.when(F.col("repo") == "ASIA", "APAC").otherwise(F.col("repo")))
    return f.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if("tag").alias("tagged"))
