"""Operator 5: byte-bounded shards by extendible hashing. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SHARD_BYTES = 1 << 20
BITS, LEAF = 60, 20


def hash_bits(c) -> F.Column:
    """60 bits of MD5 as a string of 0 and 1, most significant first."""
    return F.lpad(F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 2), BITS, "0")


def directory(leaves: DataFrame, limit: int) -> DataFrame:
    """(shard, depth, shard_bytes, shard_docs) from (bits, bytes, docs): buckets over the limit split on one more bit, the others stay.

    Level d holds the sums of the buckets that were over the limit at level d-1. One histogram of 2**20 prefixes serves
    the first 20 levels; only prefixes that are too large even there go on with all 60 bits, and a bucket whose documents
    share all 60 bits can split no more (`shard_bytes` then shows the excess).
    """
    done, part = [], leaves
    for low, high in ((0, LEAF), (LEAF, BITS)):
        hist = materialize(part.groupBy(F.substring("bits", 1, high).alias("bits")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")), "op5-hist")
        depth, open_ = low, hist
        while depth <= high:
            level = open_.withColumn("shard", F.substring("bits", 1, depth))
            sums = materialize(level.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")), "op5-level")
            fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") <= 1)) if depth < BITS else sums
            done.append(fits.select("shard", F.lit(depth).alias("depth"), "shard_bytes", "shard_docs"))
            over = sums.filter((F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)).select("shard")
            if depth == BITS or over.isEmpty():
                over = None
                break
            open_ = materialize(level.join(over, "shard", "left_semi").drop("shard"), "op5-open")  # so that no level's plan holds those before it
            depth += 1
        if over is None:
            break
        part = leaves.withColumn("shard", F.substring("bits", 1, LEAF)).join(over, "shard", "left_semi").drop("shard")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return materialize(out, "op5-directory")


def assign(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Add shard, depth, shard_bytes and shard_docs to rows with a `bits` column. A row tries only the depths in use, which
    are few under a uniform hash, and exactly one of its prefixes is a shard."""
    depths = sorted(r.depth for r in shards.select("depth").distinct().collect())  # 61 values at most
    tries = F.array(*[F.substring("bits", 1, d) for d in depths or [0]])
    return rows.withColumn("shard", F.explode(tries)).join(shards, "shard")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, bytes, shard, depth, shard_bytes, shard_docs.

    A document's size is the UTF-8 length of its text; null and empty texts have none. A document larger than the limit
    has a shard to itself. A null doc_id hashes as the word 'null'; rows that repeat a doc_id go to the same shard even
    where they exceed the limit, which is reported, not dropped. An empty table gives an empty result.
    """
    rows = materialize(
        docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
                    hash_bits(F.coalesce(F.col(ident).cast("string"), F.lit("null"))).alias("bits")), "op5-rows")
    shards = directory(rows.select("bits", "bytes", F.lit(1).cast("long").alias("docs")), limit)
    return assign(rows, shards).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, ident: str = "doc_id") -> DataFrame:
    """Write docs as one Parquet folder per shard; returns the directory. Ids must be unique."""
    where = shard(docs, limit, ident=ident)
    docs.join(where.select(F.col("doc_id").alias(ident), "shard"), ident).repartition("shard").write.partitionBy("shard").parquet(path)
    return where.groupBy("shard", "depth", "shard_bytes", "shard_docs").count().drop("count")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
                  lpad(format('{{:b}}', ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT), {BITS}, '0') AS bits FROM documents),
     x AS (SELECT doc_id, bytes, depth::INTEGER AS depth, left(bits, depth::INTEGER) AS shard FROM d, range(0, {BITS + 1}) r(depth)),
     s AS (SELECT shard, depth, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM x GROUP BY shard, depth),
     f AS (SELECT doc_id, min(depth) AS depth FROM x JOIN s USING (shard, depth)
           WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs <= 1 OR depth = {BITS} GROUP BY doc_id)
SELECT x.doc_id, x.bytes, x.shard, x.depth, s.shard_bytes, s.shard_docs
FROM x JOIN f USING (doc_id, depth) JOIN s USING (shard, depth)
"""
