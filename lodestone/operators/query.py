"""Fact queries: filters compiled to one predicate, paging, output modes, lookups and name resolution (Q1-Q20)."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import spread

ORDER = ("repo", "kind", "file", "line", "name")
DEFAULT_LIMIT, MAX_LIMIT = 100, 500
ORDERED = {"lt": -1, "le": -1, "gt": 1, "ge": 1}


@dataclass
class QueryOpts:
    kinds: list[str] = field(default_factory=list)
    repo: str | None = None
    files: list[str] = field(default_factory=list)
    file_prefix: str | None = None
    name: str | None = None
    names: list[str] = field(default_factory=list)
    relation: str | None = None
    prop: str | None = None
    prop_value: str | None = None
    prop_op: str = "eq"
    offset: int = 0
    limit: int = DEFAULT_LIMIT


def version_key(c: Column) -> Column:
    """Dotted version as an array of numbers, null where the text isn't one."""
    return F.when(c.rlike(r"^v?[0-9]+(\.[0-9]+)+$"), F.transform(F.split(F.regexp_replace(c, "^v", ""), r"\."), lambda x: x.cast("long")))


def ordering(a: Column, b: Column) -> Column:
    """-1, 0 or 1. Two versions go by their numbers, a shorter one filled up with zeros; two numbers by value; anything else by text."""
    va, vb = version_key(a), version_key(b)
    n = F.greatest(F.size(va), F.size(vb))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0).cast("long"), (n - F.size(v)).cast("int")))
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    number = r"^[+-]?[0-9]+(\.[0-9]+)?$"
    fa, fb = F.when(a.rlike(number), a).try_cast("double"), F.when(b.rlike(number), b).try_cast("double")
    return F.when(va.isNotNull() & vb.isNotNull(), sign(pad(va), pad(vb))).when(fa.isNotNull() & fb.isNotNull(), sign(fa, fb)).otherwise(sign(a, b))


#: What each operator asks of a value and the wanted text.
TESTS = {
    "eq": lambda v, w: v == w,
    "ne": lambda v, w: v != w,
    "prefix": lambda v, w: v.startswith(w),
    "contains": lambda v, w: v.contains(w),
    "lt": lambda v, w: ordering(v, w) < 0,
    "le": lambda v, w: ordering(v, w) <= 0,
    "gt": lambda v, w: ordering(v, w) > 0,
    "ge": lambda v, w: ordering(v, w) >= 0,
}


def holds(value: Column, op: str, want: str, of_list: bool = False) -> Column:
    """The predicate `value op want`, false for null. Of a list one element is enough, and `eq` also takes the whole list, written [a b]."""
    test, w = TESTS[op or "eq"], F.lit(want)
    if not of_list:
        return F.coalesce(test(value, w), F.lit(False))
    some = F.exists(value, lambda x: test(x, w))
    whole = F.concat(F.lit("["), F.array_join(value, " "), F.lit("]")) == w if (op or "eq") == "eq" else F.lit(False)
    return F.coalesce(some, F.lit(False)) | F.coalesce(whole, F.lit(False))


def predicate(o: QueryOpts, columns: list[str]) -> Column:
    """All that o asks for in one predicate, so the scan gets as much of it as it can push down. A fact must meet each field that is set, by
    any of its values."""
    out = F.lit(True)
    if o.kinds:
        out &= F.col("kind").isin(o.kinds)
    if o.repo is not None:
        out &= F.col("repo") == o.repo
    if o.files or o.file_prefix:
        one = F.col("file").isin(o.files) if o.files else F.lit(False)
        out &= (one | F.col("file").startswith(o.file_prefix)) if o.file_prefix else one
    if o.name or o.names:
        one = F.col("name").isin(o.names) if o.names else F.lit(False)
        out &= (one | F.lower("name").contains(o.name.lower())) if o.name else one
    if o.relation:
        out &= F.exists("relations", lambda r: r["kind"] == o.relation)
    if o.prop:
        value = F.col(o.prop).cast("string") if o.prop in columns else F.col("props")[o.prop]
        out &= holds(value, o.prop_op, o.prop_value) if o.prop_value is not None else value.isNotNull()
    return out


def matches(facts: DataFrame, o: QueryOpts) -> DataFrame:
    return facts.filter(predicate(o, facts.columns))


def page(found: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A page in the total order; a limit of 0 or less is the default, and none is above MAX_LIMIT."""
    n = min(limit if limit > 0 else DEFAULT_LIMIT, MAX_LIMIT)
    return found.orderBy(*ORDER).offset(offset).limit(n)


def summary(found: DataFrame, by: str) -> DataFrame:
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def flags(found: DataFrame, names: list[str]) -> DataFrame:
    """For boolean props: how many facts report true, false, and don't report."""
    cols = []
    for n in names:
        cols += [F.struct(F.lit(n).alias("flag"), F.col(n).cast("boolean").alias("v"))]
    x = found.select(F.explode(F.array(*cols)).alias("x"))
    return x.groupBy("x.flag").agg(F.count_if(F.col("x.v")).alias("yes"), F.count_if(~F.col("x.v")).alias("no"), F.count_if(F.col("x.v").isNull()).alias("absent"))


def reverse_lookup(edges: DataFrame, target: str, rel: str | None = None) -> DataFrame:
    e = edges.filter(F.col("dst") == target)
    return e.filter(F.col("rel") == rel) if rel else e


def include_related(found: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that the found ones name, each attached once, to the first in the total order."""
    w = Window.partitionBy("target").orderBy(*ORDER, "rel")
    hits = found.join(edges.select(F.col("src").alias("name"), "rel", F.col("dst").alias("target")), "name")
    hits = spread(hits.select(*ORDER, "rel", "target"), edges.count(), "target")
    first = hits.withColumn("rk", F.row_number().over(w)).filter("rk = 1").select(F.col("name").alias("from_name"), "target")
    return first.join(facts.select(F.col("name").alias("target"), F.col("kind").alias("target_kind"), F.col("repo").alias("target_repo")), "target")


def resolve(facts: DataFrame, text: str) -> DataFrame:
    """Names that may be meant by text, scored: 2 whole name, 1 short name or qualified suffix, 0 substring; 0.3 more for equal case."""
    low, name = text.lower(), F.lower("name")
    short = F.regexp_extract(name, r"[^.#/]*$", 0)
    tier = F.when(name == low, 2.0).when((short == low) | name.endswith("." + low) | name.endswith("#" + low) | name.endswith("/" + low), 1.0).when(name.contains(low), 0.0)
    return facts.select("name", "kind", "repo", (tier + F.when(F.col("name").contains(text), 0.3).otherwise(0.0)).alias("score")).filter("score is not null")
