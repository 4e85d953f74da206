"""Operator 3: exact dedup by skew-safe combining. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, lookup, materialize, table

SALTS = 16


def classes_of(docs: DataFrame, text: str = "text", ident: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """(digest, content, keep_id, group_size): one row per distinct normalised text.

    Stage 1 is local: Spark's partial aggregate merges copies within a task. Stage 2 merges them per (digest, salt),
    stage 3 merges the salts' winners. Each stage groups by the full text beside its digest, so equal digests of
    different texts stay apart; `content` tells the number of distinct texts that share the digest (1 unless SHA-256
    collides). A group of copies reaches one reducer as one row per map task and salt at most.
    """
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(ident).alias("_id"), norm.alias("_t")).select(
        "_id", "_t", F.unhex(F.sha2("_t", 256)).alias("digest"), F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt")
    )
    salted = rows.groupBy("digest", "_salt", "_t").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "_t").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole


def exact_dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null and empty texts are copies of each other. Of equal texts the largest doc_id stays;
    rows that repeat a doc_id with the same text are all marked kept, and a null doc_id is never kept while its group
    has another. Other columns are ignored; an empty table gives an empty result.
    """
    full = classes_of(docs, text, ident)
    w = full.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    # The third merge has ended here; what the documents look up is small.
    cls = materialize(w, "op3-classes")
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    ids = docs.select(F.col(ident).alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("digest"))
    ids = materialize(ids, "op3-ids")
    n, clash = cls.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.coalesce(F.max("contents"), F.lit(1))).first()
    if clash == 1:
        out = lookup(ids, cls, "digest", "group_size", n)
    else:  # different texts under one digest: look up by digest and full text
        again = docs.select(F.col(ident).alias("doc_id"), norm.alias("_t")).withColumn("digest", F.unhex(F.sha2("_t", 256)))
        out = again.join(full, ["digest", "_t"])
    return out.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
