"""From bucket rows to connected groups: hubs first, then what they leave, screened by signatures. Used by operator 7."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, in_arrow, lookup, materialize, small, utf8

SLICE = 512
FEW = 12
HUB_ROUNDS = 6
WIDE = SLICE * SLICE * 16  # pairs of a bucket above which another hub is tried before all of them are compared


def shared_buckets(rows: DataFrame, tag: str) -> DataFrame:
    """Of rows (bucket, id), those whose bucket holds two rows or more, with n, the bucket's rows, and hub, its smallest id."""
    size = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).filter("n > 1"), tag)
    out = materialize(lookup(rows, size, "bucket", "n").select("bucket", "id", "n", "hub"), tag)
    discard(size)
    return out


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows (id, hub, ...) with comp and hub_comp, the components of both."""
    own = rows.drop("comp", "hub_comp").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    hubs = comps.select(F.col("id").alias("hub"), F.col("comp").alias("hub_comp"))
    return own.join(hubs, "hub", "left").withColumn("hub_comp", F.coalesce("hub_comp", "hub"))


def unsettled(rows: DataFrame, tag: str) -> DataFrame:
    """Of labelled rows, those of buckets in which a pair that isn't a hub's may still link two components; n_rest counts the rows
    outside the hub's component."""
    held = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("comp") != F.col("hub_comp")).cast("long")).alias("n_rest")).filter("n_rest > 0 and n > 2")
    held = materialize(held, tag)
    out = materialize(lookup(rows.drop("n", "n_rest"), held, "bucket", "n"), tag)
    discard(held)
    return out


def dealt(rows: DataFrame) -> DataFrame:
    """rows with side (0: in the hub's component) and the cells (i, j) in which they meet others.

    A bucket of up to SLICE rows is one cell. In a larger one the rows of either side are cut into slices of about SLICE; slice i of the rest
    meets each slice of the hub's component in a cell of its own, and each slice of the rest from i on. No cell gets more than
    two slices, and rows that the hub has joined already never meet each other.
    """
    side = (F.col("comp") != F.col("hub_comp")).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.when(side == 1, F.col("s_rest")).otherwise(F.col("s_hub"))).cast("int")
    rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("s_hub") - 1), lambda j: F.struct(F.col("mine").alias("i"), (-1 - j).alias("j"))),
        F.transform(F.sequence(F.lit(0), F.col("s_rest") - 1), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"))))
    hub = F.transform(F.sequence(F.lit(0), F.col("s_rest") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("mine")).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    count = lambda n: F.greatest(F.ceil(n / SLICE).cast("int"), F.lit(1))
    out = rows.withColumns({"side": side, "s_rest": count(F.col("n_rest")), "s_hub": count(F.col("n") - F.col("n_rest"))}).withColumn("mine", mine)
    cells = F.when(F.col("n") <= SLICE, one).when(F.col("side") == 1, rest).otherwise(hub)
    return out.withColumn("cell", F.explode(cells)).select("bucket", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "id", "comp", "sig")


def every_pair(bucket: int, comps: np.ndarray, sigs: np.ndarray, marks: np.ndarray, least: float):
    """Pairs of rows (i, j) of different components whose signatures agree in `least` of their places, and for which this bucket is
    the first that both are in: marks holds 32 bits of the name of each row's buckets, in an order that all rows share."""
    need, here = int(np.ceil(least * sigs.shape[1])), np.uint32(bucket & 0xFFFFFFFF)
    for k in range(len(comps) - 1):
        other = np.flatnonzero(comps[k + 1 :] != comps[k]) + k + 1
        near = other[(sigs[other] == sigs[k]).sum(axis=1) >= need]
        near = near[marks[k][(marks[near] == marks[k]).argmax(axis=1)] == here] if len(near) else near
        if len(near):
            yield np.full(len(near), k), near


def leader_pairs(bucket: int, comps: np.ndarray, sigs: np.ndarray, marks: np.ndarray, least: float):
    """Pairs of a leader with the rows that agree with it in `need` places. Leaders come in the order of their agreement with the cell's
    commonest values, so the text that others are copies of comes early; who has a leader leads none."""
    need = int(np.ceil(least * sigs.shape[1]))
    usual = np.array([np.bincount(c, minlength=256).argmax() for c in sigs.T], np.uint8)
    left = np.argsort(-(sigs == usual).sum(axis=1), kind="stable")
    while len(left) > 1:
        head, left = left[0], left[1:]
        near = (sigs[left] == sigs[head]).sum(axis=1) >= need
        found = left[near & (comps[left] != comps[head])]
        if len(found):
            yield np.full(len(found), head), found
        left = left[~near]


def alike(rows: DataFrame, least: float, choose: Callable, marked: int = 0) -> DataFrame:
    """Distinct pairs (a, b), of different components, whose signatures agree in `least` of their bytes: in each cell those that `choose` names. A
    signature's last `marked` numbers of 32 bits are no part of the estimate."""

    def pairs(bucket, ids, comps, sigs):
        order = np.argsort(ids, kind="stable")
        ids, comps, sigs = ids[order], comps[order], sigs[order]
        size = sigs.shape[1] - 4 * marked
        for a, b in choose(int(bucket), comps, sigs[:, :size], np.ascontiguousarray(sigs[:, size:]).view(np.uint32), least):
            yield ids[a], ids[b]

    def run(batches):
        held, key = [], None

        def flush():
            got = list(pairs(key[0], np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in got])) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.column_stack([np.asarray(batch.column(k), np.int64) for k in range(3)])
            ids, comps = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            sigs = utf8(batch.column(5))[0].reshape(len(batch), -1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
                if held and key != tuple(keys[a]):
                    yield from flush()
                    held = []
                key = tuple(keys[a])
                held.append((ids[a:b], comps[a:b], sigs[a:b]))
        if held:
            yield from flush()

    cells = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ordered(in_arrow(cells, run, "a long, b long"))


def groups_of(buckets: DataFrame, sigs: DataFrame, verify: Callable[[DataFrame], DataFrame], least: float, tag: str, given: DataFrame | None = None, marked: int = 0) -> DataFrame:
    """(id, comp) for the ids that verified links, or the links `given` as (a, b), connect to others.

    buckets has rows (bucket, id): ids of one bucket may match. sigs has (id, sig): fixed-length bytes whose share of equal places
    estimates a pair's similarity, and after them `marked` little-endian numbers of 32 bits, the low bits of the id's buckets' names. Each bucket's smallest id, its hub, is verified against all others of the bucket; as
    neighbours share low ids, one pair serves many buckets. Buckets that still hold several components, and many rows, try other hubs. Then
    rows that their signatures show near a leader of the bucket are verified with it, and at last the pairs of what is still apart,
    as far as signatures agree in `least` of their places. A tight group of m members so costs a few pairs a member. Each pair that shares a bucket is
    judged by its hub, by its signatures or by `verify`, unless its ends are connected. All tables are written to the shared
    folder; none is gathered.
    """
    rows = shared_buckets(buckets, tag)
    links, judged, comps, hubs_of = given, None, None if given is None else components(given, tag), rows

    def judge(pairs: DataFrame) -> None:
        nonlocal links, judged, comps
        pairs = materialize(pairs if judged is None else pairs.join(judged, ["a", "b"], "left_anti"), tag)
        links = verify(pairs) if links is None else links.unionByName(verify(pairs))
        before, comps = comps, components(links, tag)
        links = comps.select(F.col("comp").alias("a"), F.col("id").alias("b"))
        old, judged = judged, pairs if judged is None else materialize(judged.unionByName(pairs), tag)
        for done in (before, old, pairs if old is not None else None):
            discard(done)

    for turn in range(HUB_ROUNDS):
        judge(ordered(hubs_of.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))))
        rows = unsettled(materialize(labelled(rows, comps), tag), tag)
        wide = rows.filter(F.col("n") * F.col("n_rest") > WIDE)
        if wide.isEmpty():
            break
        again = materialize(wide.filter("comp <> hub_comp").groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("new_hub")), tag)
        rows = materialize(rows.join(again, "bucket", "left").withColumn("hub", F.coalesce("new_hub", "hub")).drop("new_hub"), tag)
        hubs_of = rows.join(again, "bucket", "left_semi")
    ids = materialize(rows.select("id").distinct(), tag)
    sigs = materialize(sigs.join(small(ids), "id", "left_semi"), tag)
    for choose in (leader_pairs, every_pair):
        if choose is leader_pairs:  # few rows need no leader, and no marks either
            met = dealt(rows.filter(F.col("n") > FEW).join(sigs.withColumn("sig", F.expr(f"substring(sig, 1, length(sig) - {4 * marked})")), "id"))
        else:
            met = dealt(rows.join(sigs, "id"))
        judge(materialize(alike(met, least, choose, marked if choose is every_pair else 0), tag))
        if choose is leader_pairs:
            rows = unsettled(materialize(labelled(rows, comps), tag), tag)
    for done in (judged, ids, sigs, rows):
        discard(done)
    return comps
