"""Linking operators (L rows): joins that add edges between facts. A target that can't be named is counted, never guessed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, spread

FORMATS = ("json", "xml")


def normalise_path(path: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A route's path for matching: outer spaces and trailing slashes go, then a response format at the end of the last segment, and then
    a segment that is a parameter, in any of four notations, becomes {}. Numbers and dotted names stay."""
    text = F.trim(path)
    text = F.when(F.length(text) > 1, F.regexp_replace(text, "/+$", "")).otherwise(text)
    segments = F.split(text, "/", -1)
    last = F.regexp_replace(F.element_at(segments, -1), rf"^(.+)[.]({'|'.join(formats)})$", "$1")
    whole = F.concat(F.slice(segments, F.lit(1), F.size(segments) - 1), F.array(last))
    return F.array_join(F.transform(whole, lambda s: F.when(s.rlike(r"^(:.*|[{].*[}]|<.*>|\[.*\])$"), "{}").otherwise(s)), "/")


def suffixes(path: Column) -> Column:
    """(text, segments) of each suffix of whole segments."""
    p = F.split(F.ltrim(path, F.lit("/")), "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.struct(F.array_join(F.slice(p, i, F.size(p) - i + 1), "/").alias("suf"), (F.size(p) - i + 1).alias("segs")))


def http_links(routes: DataFrame) -> DataFrame:
    """Client routes to server routes of other repositories: the longest common suffix of two segments or more, methods equal or '*'.
    candidates is the number of equally long matches; only 1 is a sure link."""
    n = routes.withColumn("norm", normalise_path(F.col("path"))).select("page_id", "repo", "role", "method", F.explode(suffixes(F.col("norm"))).alias("x")).select("page_id", "repo", "role", "method", "x.suf", "x.segs").distinct()
    # Methods meet on tokens: a method by itself, and wildcards by what the other side carries for them.
    tokens = lambda other: F.explode(F.when(F.col("method") == "*", F.array(F.lit("any-client"), F.lit("any-server"))).otherwise(F.array("method", F.lit(other)))).alias("verb")
    c = n.filter("role = 'client' and segs >= 2").select("page_id", "repo", "suf", "segs", tokens("any-server"))
    s = n.filter("role = 'server' and segs >= 2").select(F.col("page_id").alias("server_id"), F.col("repo").alias("server_repo"), "suf", tokens("any-client"))
    m = c.join(s, ["suf", "verb"]).filter("repo <> server_repo").groupBy("page_id", "server_id").agg(F.max("segs").alias("segs"))
    top = m.groupBy("page_id").agg(F.max("segs").alias("segs"))
    best = m.join(top, ["page_id", "segs"])
    return best.join(best.groupBy("page_id").agg(F.count(F.lit(1)).alias("candidates")), "page_id").select("page_id", "server_id", F.col("segs").cast("long").alias("segments"), "candidates")


def unmatched(routes: DataFrame) -> DataFrame:
    """Routes of either role whose path the other role lacks."""
    other = routes.select("path", F.when(F.col("role") == "client", "server").otherwise("client").alias("role")).distinct()
    return routes.join(other, ["path", "role"], "left_anti").select("page_id", "role")


def verdicts(routes: DataFrame) -> DataFrame:
    called = routes.filter("role = 'client'").select("path", F.lit(True).alias("hit")).distinct()
    s = routes.filter("role = 'server'").join(called, "path", "left")
    return s.groupBy(F.when(F.col("hit"), "matched").when(F.col("method") == "*", "unjudged").otherwise("unmatched").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def coverage(routes: DataFrame) -> DataFrame:
    """Each service's client calls that another repository serves, and its class."""
    served = routes.filter("role = 'server'").select("path", F.col("repo").alias("by")).distinct()
    k = routes.filter("role = 'client'").join(served, "path", "left").groupBy("repo", "page_id").agg(F.max(F.coalesce((F.col("by") != F.col("repo")).cast("int"), F.lit(0))).alias("hit"))
    x = k.groupBy("repo").agg(F.count(F.lit(1)).alias("detected"), F.sum("hit").alias("resolved"))
    status = F.when(F.col("resolved") == F.col("detected"), "connected").when(F.col("resolved") == 0, "isolated").otherwise("coverage-gap")
    return x.withColumn("unresolved", F.col("detected") - F.col("resolved")).withColumn("status", status)


def import_links(imports: DataFrame, providers: DataFrame) -> DataFrame:
    """(consumer, provider, target): imports that name another repository, by the scope of '@scope/package' or else the leading path
    segment, case apart. imports: consumer, target, family; providers: repo, name, family. Languages that can't import each other (other
    families) don't link, nor does a repository with itself, nor a name that several repositories of a family claim."""
    named = F.lower(F.when(F.col("target").startswith("@"), F.regexp_extract("target", "^@([^/]+)/", 1)).otherwise(F.substring_index("target", "/", 1)))
    own = providers.select("repo", F.lower("name").alias("segment"), "family").distinct()
    own = own.groupBy("segment", "family").agg(F.min("repo").alias("provider"), F.countDistinct("repo").alias("n")).filter("n = 1").drop("n")
    x = imports.withColumn("segment", named).filter("segment <> ''").join(own, ["segment", "family"])
    return x.filter("consumer <> provider").select("consumer", "provider", "target").distinct()


def topics(uses: DataFrame) -> DataFrame:
    """Consumers joined with the producers of their topic in other repositories."""
    p = uses.filter("consumes = 0").select("topic", F.col("repo").alias("producer"))
    return uses.filter("consumes = 1").select("topic", F.col("repo").alias("consumer")).join(p, "topic").filter("consumer <> producer").distinct()


def unambiguous(owners: DataFrame) -> DataFrame:
    """Keys that exactly one owner declares."""
    return owners.groupBy("field").agg(F.min("owner").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


def shared_identities(idents: DataFrame, least: int = 3, ubiquitous: float = 0.5) -> DataFrame:
    """Pairs of repositories that share `least` identities or more, with Jaccard similarity; identities that more than half of four or
    more repositories hold don't count. Pairs come from lists of holders, which the ubiquity rule keeps short."""
    repos = idents.select("repo").distinct().count()
    held = idents.groupBy("ident").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("repo")).alias("in"))
    held = held.filter((F.col("n") >= 2) & ~((F.lit(repos) >= 4) & (F.col("n") > ubiquitous * repos)))
    first = held.select("in", F.posexplode("in").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("in", F.col("i") + 2, F.size("in"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    size = idents.groupBy("repo").agg(F.count(F.lit(1)).alias("size"))
    x = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return x.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def materialise(imports: DataFrame, samples: int = 25) -> DataFrame:
    """Edges between repositories as one dependency row each, with sorted samples."""
    x = imports.filter("src_repo <> dst_repo").groupBy(F.col("src_repo").alias("consumer"), F.col("dst_repo").alias("provider"))
    return x.agg(F.count(F.lit(1)).alias("edges"), F.array_join(F.slice(F.sort_array(F.collect_set(F.concat("src", F.lit("->"), "dst"))), 1, samples), ",").alias("via"))


def inherited(children: DataFrame, parents: DataFrame, declaring: DataFrame, depth: int = 20) -> DataFrame:
    """(child, owner): the nearest of the child (itself first) and its ancestors that declares the member. parents: (child, parent)
    edges of the hierarchy, one parent each; declaring: (name). Each step up is a join with the edges of those not yet settled."""
    up, own = checkpointed(parents.select(F.col("child").alias("anc"), "parent").distinct()), checkpointed(declaring.select(F.col("name").alias("anc")).distinct())
    front, done = checkpointed(children.select("child", F.col("child").alias("anc"))), None
    for _ in range(depth + 1):
        hit = front.join(own, "anc", "left_semi").select("child", F.col("anc").alias("owner"))
        done = hit if done is None else done.unionByName(hit)
        front = checkpointed(front.join(own, "anc", "left_anti").join(up, "anc").select("child", F.col("parent").alias("anc")))
        if front.isEmpty():
            break
    return done


def roll_up(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Symbol edges as counted edges between the modules (name, m) that declare their ends. Edges meet the targets' owners, are counted
    by source and target module, and only these counts meet the sources' owners."""
    into = spread(edges.select("src", "rel", "dst"), edges.count(), "dst").join(owner.toDF("dst", "md").hint("shuffle_hash"), "dst")
    some = into.groupBy("src", "rel", "md").agg(F.count(F.lit(1)).alias("n"))
    e = some.join(owner.toDF("src", "ms"), "src").filter("ms <> md")
    return e.groupBy(F.col("ms").alias("src"), F.col("md").alias("dst"), "rel").agg(F.sum("n").alias("n"))
