"""Operator 7: near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and components."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import C1, C2, C3, U64, discard, groups, hash_spans, in_arrow, lookup, lower_bytes, materialize, mix, small, spans_of_words, table, utf8
from .linking import groups_of

BANDS, ROWS = 40, 8
MARGIN = 4.0  # standard errors below the threshold at which a pair's estimate rules it out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct k-word shingles, sorted within a row, and the row offsets. A row of fewer words has
    one shingle, its whole sequence; a row without words has none."""
    raw = lower_bytes(raw)
    starts, ends, rows = spans_of_words(raw, offsets)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    words = hash_spans(raw, starts, ends)
    first = np.concatenate(([0], np.cumsum(count)))
    with np.errstate(over="ignore"):
        full = np.zeros(max(len(words) - k + 1, 0), U64)
        for i in range(k):
            full = mix(full * C1 + words[i : i + len(full)] + C3)
        place = np.arange(len(full))
        full, owner = full[ok := place + k <= first[rows[: len(full)] + 1]], rows[: len(full)][ok]
        short = np.flatnonzero((count > 0) & (count < k))
        few = np.zeros(len(short), U64)
        for j, r in enumerate(short):
            acc = U64(count[r])
            for w in words[first[r] : first[r + 1]]:
                acc = mix(np.array([acc * C2 + w], U64))[0]
            few[j] = acc
    owner, hashes = np.concatenate((owner, short)), np.concatenate((full, few))
    order = np.argsort(owner, kind="stable")
    hashes, bounds = hashes[order], np.searchsorted(owner[order], np.arange(n + 1))
    out, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        h = np.sort(hashes[bounds[i] : bounds[i + 1]])
        if len(h) > 1:
            h = h[np.concatenate(([True], h[1:] != h[:-1]))]
        out.append(h)
        sizes[i] = len(h)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(sizes)))


def super_minhash(elements: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m values per set; all ones where the set is empty.

    Element x goes through positions p_0, p_1, ... of a random permutation of its own and offers step + r at each; a
    position keeps the least offer. Steps run for all sets at once. A set stops as soon as each of its positions has an
    offer: later steps offer more than that, so they could change nothing. Large sets stop after a step or two.
    """
    n = len(offsets) - 1
    none = U64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * m, none, U64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    x, perm = elements, None
    for step in range(m):
        if not len(x):
            break
        with np.errstate(over="ignore"):
            r = mix(x + U64(step + 1) * C3)
        pick = step + (r & U64(0xFFFFFFFF)).astype(np.int64) % (m - step)
        if perm is None:
            pos = pick
        else:
            at = np.arange(len(x))
            pos = perm[at, pick].astype(np.int64)
            perm[at, pick] = perm[:, step]
            perm[:, step] = pos
        np.minimum.at(sig, owner * m + pos, (U64(step) << U64(32)) | (r >> U64(32)))
        unfilled = (sig.reshape(n, m) == none).any(axis=1)
        keep = unfilled[owner]
        if perm is None:
            x, owner, pos = x[keep], owner[keep], pos[keep]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(x), 1))
            perm[np.arange(len(x)), pos] = 0
            perm[:, 0] = pos
        elif not keep.all():
            x, owner, perm = x[keep], owner[keep], perm[keep]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(bands, dtype=U64), (len(sig), bands)) * C2
        for i in range(rows):
            acc = mix(acc * C1 + sig[:, i::rows][:, :bands])
    return acc.astype(np.int64)


def fingerprints(docs: DataFrame, k: int, bands: int, rows: int, text: str, ident: str) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sig): the set's size and digest, its band keys, a byte of each signature value and then four of
    each band key; empty sets have no digest."""

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in groups(offsets):
                part = offsets[i : j + 1] - offsets[i]
                h, o = shingle_sets(raw[offsets[i] : offsets[j]], part, k)
                size = np.diff(o)
                sig = super_minhash(h, o, bands * rows)
                keys = band_keys(sig, bands, rows)
                digest = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(o[:-1], o[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
                short = np.column_stack(((mix(sig) >> U64(56)).astype(np.uint8), keys.astype("<i8").view(np.uint8).reshape(len(keys), bands, 8)[:, :, :4].reshape(len(keys), -1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), pa.array(digest, pa.binary()), lists, pa.array([r.tobytes() for r in short], pa.binary())],
                                                 ["doc_id", "n_shingles", "digest", "bands", "sig"])

    return in_arrow(docs.select(F.col(ident).cast("long"), F.col(text)), run, "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, items): the sorted shingle hashes as little-endian 64-bit words."""

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in groups(offsets):
                h, o = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                items = [h[a:b].tobytes() for a, b in zip(o[:-1], o[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(o)), pa.array(items, pa.binary())], ["id", "n", "items"])

    return in_arrow(docs, run, "id long, n long, items binary")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, tag: str) -> DataFrame:
    """Of pairs (a, b), those with den * |intersection| >= num * |union| on the full sets.

    A set goes to the pairs of its second end by an ordinary join; a hub's set is copied once per 256 of its pairs and joined
    with a salt, so that no task gets more than that of one hub.
    """
    degree = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("salts")), tag)
    sized = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    left = pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts").join(sized, "b")
    right = sets.join(degree.withColumnRenamed("a", "id"), "id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = right.select(F.col("id").alias("a"), "salt", F.col("n").alias("na"), F.col("items").alias("ia"))
    both = left.join(right, ["a", "salt"]).filter(den * F.least("na", "nb") >= num * F.greatest("na", "nb")).select("a", "b", "ia", "ib")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum()) if len(x) else 0
                keep.append(den * common >= num * (len(x) + len(y) - common) and common > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return in_arrow(both, run, "a long, b long")


def near_groups(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100, bands: int = BANDS, rows: int = ROWS, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with equal sets form a class and only its smallest doc_id goes on, so a group of copies counts once. With 40 bands of 8
    rows a pair at similarity 0.85 shares a band but for 3 in 10**6 (at 0.8: 6 in 10**4; at 0.5 one in seven shares one). A pair
    whose signatures agree in fewer places than MARGIN standard errors below the threshold is ruled out unless it is a hub's (3 in
    10**5 of the pairs at the threshold). Links are confirmed on full sets.

    Null and empty texts and texts without words are alone, whatever their number. doc_id names a document: rows that repeat it with
    different texts are linked by either text and share a component. Rows with a null doc_id come back with a null
    component_id and kept = true. Very long texts are one set like any other. Other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, k, bands, rows, text, ident), "op7-prints")
    named = prints.filter("doc_id is not null and digest is not null")
    cls = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "op7-classes")
    member = materialize(lookup(named.select("doc_id", "n_shingles", "digest"), cls, "digest", "size").select("doc_id", "n_shingles", "rep"), "op7-members")
    reps = named.join(cls.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    reps = materialize(reps.select(F.col("doc_id").alias("id"), "bands", "sig"), "op7-reps", "none")
    buckets = reps.select(F.explode("bands").alias("bucket"), "id")
    several = materialize(member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("doc_id", "a"), "op7-several")
    given = None if several.isEmpty() else materialize(member.join(several, "doc_id").select("a", F.col("rep").alias("b")).distinct(), "op7-given")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "op7-ids")
        texts = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("_text")).join(small(ids), "id", "left_semi")
        sets = materialize(sets_of(texts, k), "op7-sets", "none")
        found = materialize(verified(pairs, sets, num, den, "op7-degree"), "op7-links")
        discard(sets)
        discard(ids)
        return found

    t = num / den
    least = max(0.0, t - MARGIN * (t * (1 - t) / (bands * rows)) ** 0.5)
    comps = groups_of(buckets, reps.select("id", "sig"), verify, least, "op7-links", given, bands)
    size = member.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    known = materialize(size.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "size", F.coalesce("comp", "rep").alias("component_id")), "op7-known")
    linked = lookup(member, known, "rep", "size").select("doc_id", "n_shingles", "component_id")
    alone = prints.filter("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if not alone.join(member, "doc_id", "left_semi").isEmpty():  # a row without words whose doc_id has a row with some
        worded = materialize(linked.select("doc_id", F.col("component_id").alias("c")).distinct(), "op7-worded")
        alone = alone.join(worded, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "component_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, ident: str = "doc_id") -> DataFrame:
    """The documents with one of each group, the smallest doc_id, left; rows with a null doc_id stay."""
    drop = near_groups(docs, k, num, den, ident=ident).filter(~F.col("kept")).select(F.col("doc_id").alias(ident)).distinct()
    return docs.join(materialize(drop, "op7-drop"), ident, "left_anti").select(*docs.columns)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS sh
      FROM d, unnest(range(1, greatest(len(w) - 1, 2))) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id, r.doc_id = min(seen) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
