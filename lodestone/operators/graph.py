"""Graph operators (G rows) as frontier joins over an edge table (src, rel, dst).

Loops run at most `depth` times. Each hop joins the frontier with the edges, drops what was seen by an anti join, and is written to
the shared checkpoint folder, so plans stay short and a lost executor costs a re-read.
"""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_DEPTH = 20
TASK_ROWS = 250_000  # rows of a table that one task of spread() takes, about


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session in one JVM gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as `rows` rows need, so that what a task sorts or holds doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written out, with dense numbers from 0 in the order of its rows. Only the sizes of its partitions reach the driver."""
    out = checkpointed(df.withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(out.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = [(int(r["part"]), sum(x["n"] for x in sizes[:k])) for k, r in enumerate(sizes)]
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))  # a row per partition
    return out.join(starts, part == F.col("_part")).select(*df.columns, (F.col("_start") + at).alias(name))


def stored(df: DataFrame) -> DataFrame:
    """df as it is if it only reads files, through filters and columns; else without repeats, written out: what each hop of a walk reads."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"\b(Relation|LogicalRelation)\b", plan) and not re.search(r"\b(Join|Aggregate|Union|Window|Generate|Distinct|Deduplicate|Sort|LogicalRDD|LocalRelation|Repartition\w*)\b", plan):
        return df
    return checkpointed(df.distinct())


def build_edges(facts: DataFrame) -> DataFrame:
    """(src, rel, dst, src_repo) from facts with relations array<struct<kind, target>>; documents take no edges, repeats count once."""
    return (facts.filter(F.col("kind") != "document").select(F.col("name").alias("src"), F.col("repo").alias("src_repo"), F.explode("relations").alias("r"))
            .select("src", F.col("r.kind").alias("rel"), F.col("r.target").alias("dst"), "src_repo").dropDuplicates(["src", "rel", "dst", "src_repo"]))


def node_keys(facts: DataFrame) -> DataFrame:
    """(name, repo, key): a name that several repositories declare is one node for each."""
    owners = facts.select("name", "repo").distinct()
    many = owners.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return owners.join(many, "name").select("name", "repo", F.when(F.col("n") > 1, F.concat(F.lit("repo:"), "repo", F.lit(" "), "name")).otherwise(F.col("name")).alias("key"))


def keyed_edges(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges between node keys: a target its source's repository declares resolves there, else to every declaring node."""
    keys = node_keys(facts)
    rows = edges.count()
    e = spread(edges, rows, "src").join(keys.select(F.col("name").alias("src"), F.col("repo").alias("src_repo"), F.col("key").alias("src_key")).hint("shuffle_hash"), "src")
    t = spread(e, rows, "dst").join(keys.select(F.col("name").alias("dst"), F.col("repo").alias("dst_repo"), F.col("key").alias("dst_key")).hint("shuffle_hash"), "dst")
    own = F.max(F.col("dst_repo") == F.col("src_repo")).over(Window.partitionBy("src_key", "rel", "dst"))
    kept = spread(t, rows, "src_key", "rel", "dst").withColumn("own", own).filter(~F.col("own") | (F.col("dst_repo") == F.col("src_repo"))).select("src_key", "rel", "dst_key")
    return spread(kept, rows, "src_key", "rel", "dst_key").distinct()


def nearest_ancestor(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module): the longest module that is a directory prefix of the path: prefixes are exploded and joined by equality."""
    parts = F.split("path", "/")
    pre = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hits = paths.select("path", F.explode(pre).alias("module")).join(modules.select("module").distinct(), "module")
    return hits.groupBy("path").agg(F.max_by("module", F.length("module")).alias("module"))


def owners_of_methods(names: DataFrame, types: DataFrame) -> DataFrame:
    """(owner, member): the longest known type that is a prefix of the name before a '.' or '#'."""
    cut = F.regexp_extract("name", r"^(.*)[.#][^.#]+$", 1)
    return names.select("name", cut.alias("owner")).filter("owner <> ''").join(types.select(F.col("name").alias("owner")).distinct(), "owner").select("owner", F.col("name").alias("member"))


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 5, reverse: bool = False, rels: list[str] | None = None) -> DataFrame:
    """(key, depth): the least number of hops from the seeds (key), seeds at 0. Depth is capped at 20."""
    e = edges.filter(F.col("rel").isin(rels)) if rels else edges
    e = e.select(F.col("dst").alias("key"), F.col("src").alias("next")) if reverse else e.select(F.col("src").alias("key"), F.col("dst").alias("next"))
    e = stored(e)
    front = checkpointed(seeds.select("key").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        front = checkpointed(front.join(e, "key").select(F.col("next").alias("key")).distinct().join(seen, "key", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def dispatch_hops(implements: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst): from each method of a type to the method of the same short name of what the type implements. implements: (type, interface);
    members: (owner, member). A call of the interface's method may run any of them."""
    short = F.regexp_extract("member", r"[^.#]+$", 0).alias("short")
    own, above = members.select(F.col("owner").alias("type"), F.col("member").alias("src"), short), members.select(F.col("owner").alias("interface"), F.col("member").alias("dst"), short)
    return implements.join(own, "type").join(above, ["interface", "short"]).select("src", "dst").distinct()


def traverse_dispatching(edges: DataFrame, seeds: DataFrame, hops: DataFrame, depth: int = 5, reverse: bool = False, rels: list[str] | None = None) -> DataFrame:
    """traverse that also crosses interfaces: in reverse from an implementing method to the interface's, whose callers may reach it;
    forward the other way. Adds through_interface: whether the node's shortest walk ends with such a hop (one of them). Hops count as `implements`
    edges and are taken only if rels is empty or admits calls or implements."""
    if rels and not {"calls", "implements"} & set(rels):
        return traverse(edges, seeds, depth, reverse, rels).withColumn("through_interface", F.lit(False))
    own = (edges.filter(F.col("rel").isin(rels)) if rels else edges).select("src", "dst").distinct()
    ways = own.select(F.col("dst").alias("key"), F.col("src").alias("next")) if reverse else own.select(F.col("src").alias("key"), F.col("dst").alias("next"))
    cross = hops.select(F.col("src").alias("key"), F.col("dst").alias("next")) if reverse else hops.select(F.col("dst").alias("key"), F.col("src").alias("next"))
    ways = checkpointed(ways.withColumn("hop", F.lit(False)).unionByName(cross.distinct().withColumn("hop", F.lit(True))))
    front = checkpointed(seeds.select("key").distinct().withColumns({"depth": F.lit(0), "through_interface": F.lit(False)}))
    seen = front
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        step = front.select("key").join(ways, "key").groupBy(F.col("next").alias("key")).agg(F.bool_and("hop").alias("through_interface"))
        front = checkpointed(step.join(seen, "key", "left_anti").select("key", F.lit(d).alias("depth"), "through_interface"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int = 10, rels: list[str] | None = None) -> DataFrame:
    """(key, hops, path): for each target reached its shortest path from any source; of equals the least by node names."""
    e = stored((edges.filter(F.col("rel").isin(rels)) if rels else edges).select(F.col("src").alias("key"), F.col("dst").alias("next")))
    front = checkpointed(sources.select("key").distinct().select("key", F.array("key").alias("path")))
    seen = front
    for _ in range(min(depth, MAX_DEPTH)):
        step = front.join(e, "key").select(F.col("next").alias("key"), F.concat("path", F.array("next")).alias("path")).groupBy("key").agg(F.min("path").alias("path"))
        front = checkpointed(step.join(seen, "key", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(targets.select("key").distinct(), "key").select("key", (F.size("path") - 1).alias("hops"), "path")


def rollup_seeds(members: DataFrame, facts: DataFrame, type_name: str) -> DataFrame:
    """A type, its members and its constructor New<Type>, as seeds."""
    short = type_name.rsplit(".", 1)[-1]
    own = facts.filter((F.col("name") == type_name) | F.col("name").endswith("New" + short)).select(F.col("name").alias("key"))
    return own.unionByName(members.filter(F.col("owner") == type_name).select(F.col("member").alias("key"))).distinct()


def impact(edges: DataFrame, facts: DataFrame, seeds: DataFrame, depth: int = 3, rels: list[str] | None = None) -> DataFrame:
    """Dependents by reverse walk, with the tallies' columns: key, depth, kind, repo, area, symbol_kind. Nothing is capped."""
    reach = traverse(edges, seeds, depth, True, rels).filter("depth > 0")
    area = F.concat_ws("/", F.col("repo"), F.split("file", "/")[0])
    return reach.join(facts.select(F.col("name").alias("key"), "kind", "repo", "symbol_kind", area.alias("area")), "key")


def degrees(edges: DataFrame) -> DataFrame:
    """(key, fan_in, fan_out) over distinct edges, in one aggregate. Unnamed sources and targets are not the same node."""
    end = lambda c, i, o: edges.select(F.col(c).alias("key"), F.lit(i).cast("long").alias("fan_in"), F.lit(o).cast("long").alias("fan_out"))
    ends = end("dst", 1, 0).unionByName(end("src", 0, 1))
    return ends.groupBy("key", F.when(F.col("key").isNull(), F.col("fan_in"))).agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out")).select("key", "fan_in", "fan_out")


def reachable_pairs(edges: DataFrame, most: int = 64) -> DataFrame:
    """(src, dst) of the transitive closure, by doubling path lengths; for module graphs, whose closure is small."""
    have = checkpointed(edges.select("src", "dst").distinct())
    size = have.count()
    for _ in range(most):
        step = have.select("src", F.col("dst").alias("mid")).join(have.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        have = checkpointed(have.unionByName(step).distinct())
        now = have.count()
        if now == size:
            break
        size = now
    return have


def reached(edges: DataFrame, seeds: DataFrame, most: int = 10_000) -> DataFrame:
    """(src, dst): what each seed (src) reaches by one edge or more. The frontier carries its seed, so only seeds' walks are made."""
    e = checkpointed(edges.select(F.col("src").alias("mid"), "dst").distinct())
    front = checkpointed(seeds.select("src").distinct().join(e.withColumnRenamed("mid", "src"), "src").distinct())
    seen = front
    for _ in range(most):
        front = checkpointed(front.withColumnRenamed("dst", "mid").join(e, "mid").select("src", "dst").distinct().join(seen, ["src", "dst"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both incoming and outgoing edges: the others lie on no cycle. Repeated until nothing goes."""
    left = edges.count()
    while left:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = checkpointed(kept.select("src", "dst"))
        now = edges.count()
        if now == left:
            break
        left = now
    return edges


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(key, component): component is the least member; only components of two or more nodes.

    After trimming, each node takes the least name that reaches it (its colour), passed on along edges until nothing changes. A
    colour's own node and the nodes of that colour that reach it are one component; they leave, and the rest goes on. Every
    step is a join of edges with nodes, so the work grows with the edges, not with pairs of nodes.
    """
    left, found = trimmed(checkpointed(edges.select("src", "dst").filter("src <> dst").distinct())), None
    while not left.isEmpty():
        colour = checkpointed(left.select(F.col("src").alias("key")).union(left.select("dst")).distinct().withColumn("colour", F.col("key")))
        while True:
            offer = left.join(colour.withColumnRenamed("key", "src"), "src").groupBy(F.col("dst").alias("key")).agg(F.min("colour").alias("offer"))
            new = checkpointed(colour.join(offer, "key", "left").select("key", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") < F.col("colour")).alias("moved")))
            colour = new.select("key", "colour")
            if new.filter("moved").isEmpty():
                break
        # Backward from each colour's own node, within the colour.
        inner = left.join(colour.select(F.col("key").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("key").alias("dst"), F.col("colour").alias("cd")), "dst").filter("cs = cd")
        inner = checkpointed(inner.select("src", "dst"))
        front = checkpointed(colour.filter("key = colour").select("key"))
        held = front
        while True:
            front = checkpointed(inner.join(front.withColumnRenamed("key", "dst"), "dst").select(F.col("src").alias("key")).distinct().join(held, "key", "left_anti"))
            if front.isEmpty():
                break
            held = held.unionByName(front)
        part = checkpointed(colour.join(held, "key", "left_semi").select("key", F.col("colour").alias("component")))
        found = part if found is None else found.unionByName(part)
        rest = left.join(part.select(F.col("key").alias("src")), "src", "left_anti").join(part.select(F.col("key").alias("dst")), "dst", "left_anti")
        left = trimmed(checkpointed(rest.select("src", "dst")))
    if found is None:
        return edges.select(F.col("src").alias("key"), F.col("src").alias("component")).limit(0)
    many = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return found.join(many, "component").select("key", "component")


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """(key, cycle): the number of edges of the shortest cycle through each node that is on one; an edge to itself is a cycle of one.

    Walks start from nodes of trimmed edges, never visit a node twice, and end when their start is met again or nothing new is."""
    own = edges.select("src", "dst").distinct()
    e = trimmed(checkpointed(own.filter("src <> dst")))
    found = checkpointed(own.filter("src = dst").select(F.col("src").alias("key"), F.lit(1).alias("cycle")))
    front = checkpointed(e.select(F.col("src").alias("key"), F.col("dst").alias("tip")).join(found, "key", "left_anti"))
    seen, hops = front, 1
    while not front.isEmpty():
        hops += 1
        step = checkpointed(front.join(e.withColumnRenamed("src", "tip"), "tip").select("key", F.col("dst").alias("tip")).distinct().join(seen, ["key", "tip"], "left_anti"))
        home = checkpointed(step.filter("key = tip").select("key", F.lit(hops).alias("cycle")))
        found = found.unionByName(home)
        front = checkpointed(step.join(home, "key", "left_anti"))
        seen = seen.unionByName(front)
    return found


def condensed(edges: DataFrame, oversized: int = 8) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, component, weight) and edges between components; a component above `oversized` weighs 0 and has no outgoing edges."""
    nodes = edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct()
    comp = nodes.join(strongly_connected(edges), "key", "left").select("key", F.coalesce("component", "key").alias("component"))
    comp = checkpointed(comp.join(comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select(
        "key", "component", F.when(F.col("size") > oversized, 0).otherwise(F.col("size")).alias("weight")))
    a, b = comp.select(F.col("key").alias("src"), F.col("component").alias("ca"), F.col("weight").alias("wa")), comp.select(F.col("key").alias("dst"), F.col("component").alias("cb"))
    return comp, checkpointed(edges.join(a, "src").join(b, "dst").filter("ca <> cb and wa > 0").select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct())


def longest_chains(edges: DataFrame, most: int = 200) -> DataFrame:
    """(component, length): the weight of the heaviest chain that starts at each component of the condensation."""
    comp, dag = condensed(edges)
    weight = comp.select("component", "weight").distinct()
    best = checkpointed(weight.select("component", F.col("weight").alias("length")))
    for _ in range(most):
        over = dag.join(best.select(F.col("component").alias("dst"), "length"), "dst").groupBy(F.col("src").alias("component")).agg(F.max("length").alias("below"))
        new = checkpointed(weight.join(over, "component", "left").select("component", (F.col("weight") + F.coalesce("below", F.lit(0))).alias("length")))
        if new.exceptAll(best).isEmpty():
            break
        best = new
    return best


def nested_spans(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """(file, line, name): the innermost span that holds the line, a later start first among equals. Spans and points meet in
    blocks of `width` lines, an equality join, so that a large file isn't one task's work."""
    s = spans.filter("end_line >= start_line").withColumn("block", F.explode(F.sequence((F.col("start_line") / width).cast("long"), (F.col("end_line") / width).cast("long"))))
    p = points.withColumn("block", (F.col("line") / width).cast("long"))
    hit = p.join(s, ["file", "block"]).filter("line between start_line and end_line")
    return hit.groupBy("file", "line").agg(F.min_by("name", F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("name"))).alias("name"))
