"""Constraint forms (C rows): components are predicates over facts, verdicts are joins, anti joins and counts.

members: (name, ...) of a component. edges: (src, rel, dst). A breach is a row of the result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def ends(members: DataFrame, column: str) -> DataFrame:
    return members.select(F.col("name").alias(column)).distinct()


def edges_from(edges: DataFrame, members: DataFrame, via: str | None = None) -> DataFrame:
    e = edges.filter(F.col("rel") == via) if via else edges
    return e.join(ends(members, "src"), "src", "left_semi")


def forbid(edges, component, to, via=None):
    return edges_from(edges, component, via).join(ends(to, "dst"), "dst", "left_semi").select("src", "rel", "dst")


def forbid_reach(edges, component, to, via=None, depth: int = 5):
    """Shortest witness for each pair's target: (key, hops, path)."""
    e = edges.filter(F.col("rel") == via) if via else edges
    return graph.shortest_paths(e, component.select(F.col("name").alias("key")), to.select(F.col("name").alias("key")), depth).filter("hops > 0")


def allow(edges, component, only, measured, via=None):
    """Edges whose target is measured and in neither the component nor `only`."""
    e = edges_from(edges, component, via).join(ends(measured, "dst"), "dst", "left_semi")
    return e.join(ends(component, "dst"), "dst", "left_anti").join(ends(only, "dst"), "dst", "left_anti").select("src", "rel", "dst")


def protect(edges, component, owners, via=None):
    e = (edges.filter(F.col("rel") == via) if via else edges).join(ends(component, "dst"), "dst", "left_semi")
    return e.join(ends(component, "src"), "src", "left_anti").join(ends(owners, "src"), "src", "left_anti").select("src", "rel", "dst").distinct()


def private(edges, component):
    """Uses of a member that isn't exported anywhere, from outside the component."""
    shown = component.filter("exported").select("name")
    return protect(edges, component.filter("not exported").join(shown, "name", "left_anti"), component)


def forbid_fact(component):
    return component


def cap_members(component, most: int):
    """(members, first_over): the number of members if there are more than `most`, and the first name beyond them; no list is gathered."""
    names = component.select("name").distinct()
    over = names.orderBy("name").limit(most + 1).orderBy(F.desc("name")).limit(1).select(F.col("name").alias("first_over"))
    return names.agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > most).join(F.broadcast(over))


def require(component, when, must, edges=None, via=None):
    """Members that meet `when` (and have an edge `via`, if asked) and miss `must`."""
    m = component.filter(when)
    if via:
        m = m.join(edges.filter(F.col("rel") == via).select(F.col("src").alias("name")).distinct(), "name", "left_semi")
    return m.filter(~F.coalesce(must, F.lit(False)))


def require_defines(types, methods, name: str):
    """Types (name) without a method (owner, method) of that name."""
    return types.join(methods.filter(F.col("method") == name).select(F.col("owner").alias("name")).distinct(), "name", "left_anti")


def require_edge(component, edges, via: str, inbound: bool = False):
    """Members without the edge. Outbound: only members of classes (file suffix) of which some member has it are judged."""
    e = edges.filter(F.col("rel") == via)
    if inbound:
        return component.join(e.select(F.col("dst").alias("name")).distinct(), "name", "left_anti")
    has = e.select(F.col("src").alias("name")).distinct()
    kind = component.withColumn("cls", F.regexp_extract("file", r"[^/]*$", 0))
    able = kind.join(has, "name", "left_semi").select("cls", "repo").distinct()
    return kind.join(able, ["cls", "repo"], "left_semi").join(has, "name", "left_anti")


def protocol(steps: DataFrame):
    """(name, highest, missing): members that reach a step without a lower one. steps: (name, step) reached, steps counted from 1."""
    g = steps.groupBy("name").agg(F.max("step").alias("highest"), F.collect_set("step").alias("got"))
    missing = F.array_except(F.sequence(F.lit(1), F.col("highest")), "got")
    return g.withColumn("missing", F.sort_array(missing)).filter(F.size("missing") > 0).select("name", "highest", F.array_join("missing", ",").alias("missing"))


def forbid_cycles(edges):
    return graph.strongly_connected(edges)


def independent(edges, pairs):
    """(part, whole): parts that reach the whole that includes them."""
    r = graph.reached(edges, pairs.select(F.col("part").alias("src")))
    return pairs.join(r.select(F.col("src").alias("part"), F.col("dst").alias("whole")), ["part", "whole"], "left_semi")


def name_rule(component, pattern: str, require_: bool = True):
    ok = F.regexp_extract("name", r"[^.#/]*$", 0).rlike(pattern)
    return component.filter(~ok if require_ else ok)


def storage_stays_home(edges, storage, component):
    return edges.join(ends(storage, "dst"), "dst", "left_semi").join(ends(component, "src"), "src", "left_anti").select("src", "rel", "dst")


def cap_runtime(frames, most: float):
    return frames.filter(F.col("value") > most)


def unique_across(component, by: str):
    """Values that two or more repositories own."""
    return component.groupBy(F.col(by).alias("value")).agg(F.countDistinct("repo").alias("repos")).filter("repos > 1")


def require_governed(component, anchors):
    """Files of members that no anchor (module) covers."""
    files = component.select(F.col("file").alias("path")).distinct()
    return files.join(graph.nearest_ancestor(files, anchors), "path", "left_anti")


def contract_for(target: str, edges, facts):
    """What a change of the target touches: its edges both ways with the other end's kind."""
    out = edges.filter(F.col("src") == target).select("rel", F.lit("out").alias("side"), F.col("dst").alias("name"))
    into = edges.filter(F.col("dst") == target).select("rel", F.lit("in").alias("side"), F.col("src").alias("name"))
    return out.unionByName(into).join(facts.select("name", "kind"), "name")


def near_misses(words, vocabulary, most: int = 2, grams: int = 2):
    """(word, near, distance): vocabulary entries within `most` edits of an unknown word, candidates by shared letter pairs."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - grams + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(grams))))
    unknown = words.join(vocabulary.select(F.col("near").alias("word")), "word", "left_anti")
    a, b = unknown.select("word", F.explode(pairs(F.col("word"))).alias("g")), vocabulary.select("near", F.explode(pairs(F.col("near"))).alias("g"))
    c = a.join(b, "g").select("word", "near").distinct().withColumn("distance", F.levenshtein("word", "near"))
    return c.filter(F.col("distance") <= most)
