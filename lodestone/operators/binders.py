"""Binders (L rows): joins that resolve what a fact names to the fact it means. A name that two facts claim resolves to nothing."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import http_links


def sole(claims: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value) of claims that one value makes alone."""
    return claims.groupBy(*by).agg(F.min(value).alias(value), F.max(value).alias("_other")).filter(F.col(value) == F.col("_other")).drop("_other")


def handled_by(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(route, handler, target): each server route's handler expression resolved to a symbol of its repository.

    routes: route, repo, handler; symbols: name, repo, fqn (may be null). A handler that is a symbol's name, or its qualified name,
    means it; otherwise its last segment does, if one symbol of the repository ends in it. The raw handler stays beside the target.
    """
    tail = lambda c: F.regexp_extract(c, r"([^.#:/]+)$", 1)
    s = symbols.select("name", "repo", "fqn").distinct()
    exact = s.select("repo", F.col("name").alias("handler"), F.lit(0).alias("rank"), F.col("name").alias("target"))
    named = sole(s.filter("fqn is not null").select("repo", F.col("fqn").alias("handler"), "name"), ["repo", "handler"], "name")
    named = named.select("repo", "handler", F.lit(1).alias("rank"), F.col("name").alias("target"))
    short = sole(s.select("repo", tail("name").alias("tail"), "name"), ["repo", "tail"], "name")
    r = routes.select("route", "repo", "handler").filter("handler is not null and handler <> ''").withColumn("tail", tail(F.col("handler")))
    whole = r.join(exact.unionByName(named), ["repo", "handler"]).select("route", "repo", "handler", "rank", "target")
    part = r.join(short, ["repo", "tail"]).select("route", "repo", "handler", F.lit(2).alias("rank"), F.col("name").alias("target"))
    return whole.unionByName(part).groupBy("route", "handler").agg(F.min_by("target", F.struct("rank", "target")).alias("target"))


def import_aliases(imports: DataFrame, modules: DataFrame, packages: DataFrame, types: DataFrame) -> DataFrame:
    """(target, via, key): import targets resolved to declaring facts.

    imports: target. modules: path, dir, key (a module path and the folders it declares): a target is the path, then '/' and the folder.
    packages: package, key: a target is the package or lies beneath it, the longest one wins. types: fqn, key: a target is a qualified name or a member of it.
    Prefixes of targets are exploded and joined by equality, so each way is an equi join.
    """
    t = imports.select("target").filter("target is not null").distinct()
    own = sole(modules.select(F.when(F.col("dir") == "", F.col("path")).otherwise(F.concat_ws("/", "path", "dir")).alias("target"), "key"), ["target"], "key")
    by_module = t.join(own, "target").select("target", F.lit("module").alias("via"), "key")
    cut = lambda sep: F.transform(F.sequence(F.lit(1), F.size(F.split("target", sep))), lambda i: F.array_join(F.slice(F.split("target", sep), F.lit(1), i), sep.replace("[.]", ".")))
    heads = t.select("target", F.explode(cut("/")).alias("package"))
    by_package = heads.join(sole(packages, ["package"], "key"), "package").groupBy("target").agg(F.max_by("key", F.length("package")).alias("key")).select("target", F.lit("package").alias("via"), "key")
    names = t.filter("contains(target, '.')").select("target", F.explode(cut("[.]")).alias("fqn"))
    by_type = names.join(sole(types, ["fqn"], "key"), "fqn").groupBy("target").agg(F.max_by("key", F.length("fqn")).alias("key")).select("target", F.lit("type").alias("via"), "key")
    order = F.array_position(F.array(F.lit("module"), F.lit("package"), F.lit("type")), F.col("via"))
    return by_module.unionByName(by_package).unionByName(by_type).withColumn("o", order).groupBy("target").agg(F.min_by(F.struct("via", "key"), "o").alias("b")).select("target", "b.via", "b.key")


def picked_providers(routes: DataFrame, hints: DataFrame) -> DataFrame:
    """(page_id, server_id, segments, confidence): one provider for a client call, where the evidence names one.

    Of several equally long matches (see http_links) the one whose repository the caller's hint (page_id, repo) names is taken; without a
    hint several stay ambiguous and give no link. A sole or hinted match of three segments or more is 'verified', else 'probable'.
    """
    m = http_links(routes).join(routes.select(F.col("page_id").alias("server_id"), F.col("repo").alias("server_repo")), "server_id")
    h = hints.select("page_id", F.col("repo").alias("hint")).distinct()
    x = m.join(h, "page_id", "left").withColumn("hinted", F.coalesce(F.col("hint") == F.col("server_repo"), F.lit(False)))
    n = x.groupBy("page_id").agg(F.count_if("hinted").alias("named"))
    x = x.join(n, "page_id").filter((F.col("candidates") == 1) | (F.col("hinted") & (F.col("named") == 1)))
    sure = (F.col("segments") >= 3) & (F.col("hinted") | (F.col("candidates") == 1))
    return x.select("page_id", "server_id", "segments", F.when(sure, "verified").otherwise("probable").alias("confidence"))
