"""Snapshot algebra, history, mining and flows (D, H, M and F rows)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, numbered

STRIPES = 8  # stripes of roots in union_sizes()
HELD = 1 << 24  # values of sets that a task of union_sizes() holds, about
CHUNK = 1 << 20  # values from which on a set is sent there in several rows

def diff_facts(old: DataFrame, new: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Multiset pairing: rows with equal key pair in order of their values; (key..., change) for added, removed and changed rows."""
    w = Window.partitionBy(*key).orderBy(*value)
    number = lambda d, side: d.withColumn("i", F.row_number().over(w)).select(*key, "i", F.struct(*value).alias(side))
    x = number(old, "was").join(number(new, "now"), [*key, "i"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return x.withColumn("change", change).filter("change is not null").select(*key, "change")


def finding_key(source: Column, title: Column) -> Column:
    """A finding's identity: its source and its title with every number as #."""
    return F.concat(source, F.lit("|"), F.regexp_replace(title, "[0-9]+", "#"))


def gate(findings: DataFrame, fail_on: list[str], least: float) -> DataFrame:
    """One row: the number of findings that fail, and the exit code: 1 if there are any."""
    n = findings.agg(F.count_if(F.col("source").isin(fail_on) & (F.col("confidence") >= least) & ~F.col("informational")).alias("failing"))
    return n.withColumn("exit_code", F.when(F.col("failing") > 0, 1).otherwise(0)).withColumn("status", F.when(F.col("failing") > 0, "regression").otherwise("clean"))


def patch(old: DataFrame, new: DataFrame) -> DataFrame:
    """(line, sign, n): what turns the multiset of lines old into new."""
    count = lambda d, sign: d.groupBy("line").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.col("n") * sign)
    x = count(old, -1).unionByName(count(new, 1)).groupBy("line").agg(F.sum("n").alias("d")).filter("d <> 0")
    return x.select("line", F.when(F.col("d") > 0, "+").otherwise("-").alias("sign"), F.abs("d").alias("n"))


def apply_patch(old: DataFrame, p: DataFrame) -> DataFrame:
    """(line, n): old's lines, counted, with the patch applied; a negative count means that the patch has another parent."""
    have = old.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    signed = p.select("line", F.when(F.col("sign") == "+", F.col("n")).otherwise(-F.col("n")).alias("n"))
    x = have.unionByName(signed).groupBy("line").agg(F.sum("n").alias("n"))
    return x.withColumn("n", F.when(F.col("n") < 0, F.raise_error(F.lit("wrong parent"))).otherwise(F.col("n"))).filter("n > 0")


def blame(revisions: DataFrame) -> DataFrame:
    """(line, first, last, gone): the first and last revision that hold a line, and the one after the last, where there is one."""
    last = revisions.agg(F.max("rev").alias("head"))
    x = revisions.groupBy("line").agg(F.min("rev").alias("first"), F.max("rev").alias("last")).join(F.broadcast(last))  # one row
    return x.select("line", "first", "last", F.when(F.col("last") < F.col("head"), F.col("last") + 1).alias("gone"))


def mined_rules(rows: DataFrame, a: str, b: str, support: int = 10, confidence: float = 0.9, exceptions: int = 20) -> DataFrame:
    """a=x implies b=y where enough rows have x, nearly all of them have y, and y is likelier than without x."""
    pair = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    left = rows.groupBy(a).agg(F.count(F.lit(1)).alias("support"))
    right = rows.groupBy(b).agg(F.count(F.lit(1)).alias("base"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    x = pair.join(left, a).join(right, b).join(F.broadcast(total))  # one row
    conf = F.col("n") / F.col("support")
    x = x.filter((F.col("support") >= support) & (conf >= confidence) & (F.col("support") - F.col("n") <= exceptions) & (conf > F.col("base") / F.col("total")))
    return x.select(F.col(a).cast("string").alias("if_value"), F.col(b).cast("string").alias("then_value"), "support", "n", F.round(conf, 6).alias("confidence"))


def pruned_implications(rules: DataFrame) -> DataFrame:
    """rules (if_prop, if_value, then_prop, then_value, support, confidence) without those that say nothing: a property implying itself, a value
    implying the same value, and of two certain rules that are each other's reverse the one with less support (of equals, the later name)."""
    said = rules.filter((F.col("if_prop") != F.col("then_prop")) & (F.col("if_value") != F.col("then_value")))
    one, two = F.struct(F.col("if_prop").alias("p"), F.col("if_value").alias("v")), F.struct(F.col("then_prop").alias("p"), F.col("then_value").alias("v"))
    said = said.withColumns({"pair": F.struct(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")), "rank": F.struct((-F.col("support")).alias("s"), one.alias("one"))})
    best = said.filter("confidence = 1").groupBy("pair").agg(F.min("rank").alias("best"))
    return said.join(best, "pair", "left").filter((F.col("confidence") < 1) | F.col("best").isNull() | (F.col("rank") == F.col("best"))).drop("pair", "rank", "best")


def naming_patterns(names: DataFrame, support: int = 10, confidence: float = 0.9) -> DataFrame:
    """(cluster, pattern): prefixes (up to a separator) that nearly all names of a cluster share."""
    n = names.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    p = names.select("cluster", F.concat(F.regexp_extract("name", r"^[^.#/ ]+", 0), F.lit("*")).alias("pattern")).groupBy("cluster", "pattern").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, "cluster").filter((F.col("size") >= support) & (F.col("n") / F.col("size") >= confidence)).select("cluster", "pattern", "n", "size")


def union_sizes(groups: DataFrame, sets: DataFrame, blocks: list[int], width: int) -> DataFrame:
    """(root, kind, n): the size of the union of the sets that each root names. groups: (root, keys array<int>), each key once; sets: (key, kind, value), each row
    once, values of a kind counted from 0. Kind k is cut into blocks[k] blocks of `width` values.

    Roots are dealt into STRIPES stripes. In the cell of a stripe and a block a task holds the block's share of the sets, HELD values or about so many, and
    passes the stripe's roots by: of a root's values those count whose place in a table of the block still holds their own position after all were put
    there. So no row stands for a path, and what is shuffled is the sets STRIPES times and the groups once a block."""
    first = [sum(blocks[:k]) for k in range(len(blocks))]
    block = F.element_at(F.array(*[F.lit(x) for x in first]), F.col("kind") + 1) + F.floor(F.col("value") / width).cast("int")
    lists = sets.groupBy("key", block.alias("block"), F.floor(F.col("value") / CHUNK).alias("chunk")).agg(F.collect_list((F.col("value") % width).cast("int")).alias("held"))
    lists = lists.select(F.col("block"), F.explode(F.sequence(F.lit(0), F.lit(STRIPES - 1))).alias("stripe"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("root"), "key", "held")
    stripe = F.pmod(F.xxhash64("root"), F.lit(STRIPES)).cast("int")
    walks = groups.select(F.explode(F.sequence(F.lit(0), F.lit(sum(blocks) - 1))).alias("block"), stripe.alias("stripe"), F.lit(1).alias("side"), "root", F.lit(None).cast("int").alias("key"), F.col("keys").alias("held"))
    rows = lists.unionByName(walks).withColumn("cell", F.col("block") * STRIPES + F.col("stripe"))
    rows = rows.repartitionById(sum(blocks) * STRIPES, F.col("cell")).sortWithinPartitions("side")

    def run(batches):
        keys, sizes, values, table, ready = [], [], [], np.empty(width, np.int32), None
        for batch in batches:
            held = batch.column("held")
            flat, offsets = np.asarray(held.flatten()), np.asarray(held.offsets)
            offsets = offsets - offsets[0]
            cut = int(np.searchsorted(np.asarray(batch.column("side")), 1))
            if cut:
                keys.append(np.asarray(batch.column("key").slice(0, cut)))
                sizes.append(np.diff(offsets[: cut + 1]))
                values.append(flat[: offsets[cut]])
            if cut == len(batch):
                continue
            if ready is None:
                key, size, value = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (keys, sizes, values))
                order = np.argsort(key, kind="stable")
                start = (np.cumsum(size) - size)[order]
                ready, end, values = key[order], start + size[order], []
            low, high = np.searchsorted(ready, flat, "left"), np.searchsorted(ready, flat, "right")
            n = np.zeros(len(batch) - cut, np.int64)
            for k in range(cut, len(batch)):
                mine = [value[start[j] : end[j]] for a, b in zip(low[offsets[k] : offsets[k + 1]].tolist(), high[offsets[k] : offsets[k + 1]].tolist(), strict=True) for j in range(a, b)]
                if mine:
                    mine = np.concatenate(mine)
                    at = np.arange(len(mine), dtype=np.int32)
                    table[mine] = at
                    n[k - cut] = np.count_nonzero(table[mine] == at)
            some = np.flatnonzero(n)
            roots = batch.column("root").slice(cut).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([roots, batch.column("block").slice(cut).take(pa.array(some)), pa.array(n[some])], ["root", "block", "n"])

    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 4 << 20)):  # lowered only
        now = str(groups.sparkSession.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not (now.isdigit() and 0 < int(now) <= most):
            groups.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    out = rows.select("block", "side", "root", "key", "held").mapInArrow(run, "root string, block int, n long")
    kind = sum(((F.col("block") >= x).cast("int") for x in first[1:]), F.lit(0))
    return out.groupBy("root", kind.alias("kind")).agg(F.sum("n").alias("n"))


def flow_reach(direct: DataFrame, calls: DataFrame, module) -> DataFrame:
    """(name, reach, modules): how many nodes each root reaches in one hop (direct: root, key) or two (calls: src, dst), and of how many
    modules, `module` being a function of a node's column.

    A node's set is itself and what it calls; a root's reach is the union of its direct nodes' sets, whose size `union_sizes` counts. So the
    joins have a row per edge, not one per path."""
    nodes = direct.select("key").union(calls.select("dst")).distinct().withColumn("module", F.coalesce(module(F.col("key")), F.lit("")))
    nodes = checkpointed(numbered(nodes, "id"))
    names = checkpointed(numbered(nodes.select("module").distinct(), "module_id"))
    nodes = checkpointed(nodes.join(names, "module").select("key", F.col("id").cast("int").alias("id"), F.col("module_id").cast("int").alias("module")))
    to = nodes.select(F.col("key").alias("dst"), F.col("id").alias("value"), "module")
    own = checkpointed(direct.distinct().join(nodes, "key").groupBy("root").agg(F.collect_list("id").alias("keys")))
    pairs = calls.distinct().join(to, "dst").join(nodes.select(F.col("key").alias("src"), F.col("id").alias("key")), "src").select("key", "value", "module")
    # What calls itself is in its set once.
    pairs = checkpointed(pairs.filter("key <> value").unionByName(nodes.select(F.col("id").alias("key"), F.col("id").alias("value"), "module")))
    sets = pairs.select("key", F.lit(0).alias("kind"), "value").unionByName(pairs.select("key", F.lit(1).alias("kind"), F.col("module").alias("value")).distinct())
    count, size, most = nodes.count(), pairs.count(), names.count()
    width = max(1, -(-count // max(1, -(-size // HELD))))
    n = union_sizes(own, sets, [max(1, -(-count // width)), max(1, -(-most // width))], width)
    return n.groupBy(F.col("root").alias("name")).agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("reach"), F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("modules"))


def flow_rank(flows: DataFrame) -> DataFrame:
    """Rank of entry points: side roots last, commands behind routes, then reach, modules and name."""
    order = [F.col("side"), (F.col("kind") == "command").cast("int"), F.desc("reach"), F.desc("modules"), F.asc("name")]
    ranked = numbered(flows.orderBy(*order), "rank")  # ranks are global, and no task sorts more than its range
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int"))


def same_reach(reach: DataFrame) -> DataFrame:
    """(signature, roots, first): roots that reach the same set fold into one."""
    s = reach.groupBy("root").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("key")), ","), 256).alias("signature"))
    return s.groupBy("signature").agg(F.count(F.lit(1)).alias("roots"), F.min("root").alias("first")).select("first", "roots")


def comparability(pairs: DataFrame) -> DataFrame:
    """(pair, warning, blocking): what makes a comparison of two receipts doubtful. pairs: pair and, with the prefixes was_ and now_, repo,
    version, extractors, globs, members (the last three arrays). A blocking warning means that the difference says nothing."""
    gone = F.array_except("was_extractors", "now_extractors")
    new = F.array_except("now_extractors", "was_extractors")
    other = lambda c: F.size(F.array_except(f"was_{c}", f"now_{c}")) + F.size(F.array_except(f"now_{c}", f"was_{c}")) > 0
    missing = F.col("was_version").isNull() | F.col("now_version").isNull()
    said = [
        (F.col("was_repo") != F.col("now_repo"), "repo", True), (missing, "pre-receipt", False), (~missing & (F.col("was_version") != F.col("now_version")), "version", False),
        (F.size(gone) > 0, "extractor-lost", True), (F.size(new) > 0, "extractor-new", False), (other("globs"), "globs", False), (other("members"), "members", True)]
    warnings = F.filter(F.array(*[F.when(when, F.struct(F.lit(name).alias("warning"), F.lit(block).alias("blocking"))) for when, name, block in said]), lambda x: x.isNotNull())
    return pairs.select("pair", F.explode(warnings).alias("w")).select("pair", "w.warning", "w.blocking")


def conformance(predicted: DataFrame, changed: DataFrame) -> DataFrame:
    """(name, verdict): what a plan said would change against what did: 'kept', 'untouched', or 'spilled' outside the plan."""
    p, c = predicted.select("name", F.lit(True).alias("p")).distinct(), changed.select("name", F.lit(True).alias("c")).distinct()
    return p.join(c, "name", "full").select("name", F.when(F.col("p").isNull(), "spilled").when(F.col("c").isNull(), "untouched").otherwise("kept").alias("verdict"))
