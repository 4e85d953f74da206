"""Operator 1: media payloads as content-defined chunks, deduplicated by joins on their digests and rebuilt from ordered lists."""
from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, in_arrow, lookup, materialize, table, utf8

UNIT = 64
LEAST, MOST, CUT_BITS = 2048, 32768, 12
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling gear hash at each byte: the sum of GEAR[byte] << age over the last 32 bytes, in five doublings."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k].copy() << np.uint32(k))
    return h


def cuts(raw: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each payload raw[bounds[i]:bounds[i+1]]. A chunk ends where the hash's leading bits are zero, after LEAST bytes
    (more than the hash's window, so it never sees the payload before) and at MOST bytes at the latest."""
    at = np.flatnonzero(gear(raw) >> np.uint32(32 - CUT_BITS) == 0) + 1 if (np.diff(bounds) > LEAST).any() else np.zeros(0, np.int64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends = []
        while b - a > LEAST:
            i = int(np.searchsorted(at, a + LEAST))
            e = min(int(at[i]) if i < len(at) else b, a + MOST, b)
            ends.append(e)
            a = e
        if a < b:
            ends.append(b)
        out.append(ends)
    return out


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads: each text with zero bytes up to a positive multiple of UNIT."""
    lens = np.diff(offsets)
    full = np.maximum(-(-lens // UNIT) * UNIT, UNIT)
    bounds = np.concatenate(([0], np.cumsum(full)))
    out = np.zeros(int(bounds[-1]), np.uint8)
    for a, b, s in zip(offsets[:-1], offsets[1:], bounds[:-1], strict=True):
        out[s : s + b - a] = raw[a:b]
    return out, bounds


def payloads(batches):
    """(batch rows i to j, payload bytes, bounds, lengths of the texts) in pieces of bounded size."""
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        for i, j in groups(offsets):
            part = offsets[i : j + 1] - offsets[i]
            yield batch.slice(i, j - i), *padded(raw[offsets[i] : offsets[j]], part), np.diff(part)


def manifests(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media_id, chunks): the payload's SHA-256 and the ordered list of its chunks' digests."""

    def run(batches):
        for rows, raw, bounds, lens in payloads(batches):
            buf, ids, lists = raw.tobytes(), [], []
            for a, b, ends in zip(bounds[:-1].tolist(), bounds[1:].tolist(), cuts(raw, bounds), strict=True):
                ids.append(hashlib.sha256(buf[a:b]).digest())
                digests = []
                for e in ends:
                    digests.append(hashlib.sha256(buf[a:e]).digest())
                    a = e
                lists.append(digests)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lens), pa.array(ids, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media_id", "chunks"])

    return in_arrow(docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text)), run, "doc_id long, n_bytes long, media_id binary, chunks array<binary>")


def chunk_rows(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(media_id, digest, frame): each chunk's bytes as a Zstandard frame. A task sends a chunk once per payload."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=6)
        for rows, raw, bounds, _ in payloads(batches):
            buf, out = raw.tobytes(), {}
            for a, b, ends in zip(bounds[:-1].tolist(), bounds[1:].tolist(), cuts(raw, bounds), strict=True):
                media = hashlib.sha256(buf[a:b]).digest()
                for e in ends:
                    key = (media, hashlib.sha256(buf[a:e]).digest())
                    if key not in out:
                        out[key] = z.compress(buf[a:e])
                    a = e
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.binary()), pa.array([k[1] for k in out], pa.binary()), pa.array(list(out.values()), pa.binary())], ["media_id", "digest", "frame"])

    return in_arrow(docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text)), run, "media_id binary, digest binary, frame binary")


def rebuilt(lists: DataFrame) -> DataFrame:
    """Features of each medium from its stored chunks: (media_id, pieces) with pieces an array of (seq, digest, frame).

    The stored form is a header (per chunk: digest, bytes raw and stored) and the frames in order. Reading decompresses and
    joins the frames; a payload whose SHA-256 isn't its media_id stops the job.
    """

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            cols = [[] for _ in range(7)]
            for media, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces.sort(key=lambda p: p["seq"])
                raws = [z.decompress(p["frame"]) for p in pieces]
                payload = b"".join(raws)
                found = hashlib.sha256(payload)
                if found.digest() != media or [p["seq"] for p in pieces] != list(range(len(pieces))):
                    raise ValueError(f"medium {media.hex()} can't be rebuilt from its chunks")
                head = b"".join(p["digest"] + struct.pack("<II", len(r), len(p["frame"])) for p, r in zip(pieces, raws, strict=True))
                stored = hashlib.sha256(head)
                for p in pieces:
                    stored.update(p["frame"])
                hist = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                mean = int(hist @ np.arange(256)) / len(payload)
                values = (media, len(payload), found.hexdigest(), zlib.crc32(payload[-UNIT:]), len(head) + sum(len(p["frame"]) for p in pieces),
                          stored.hexdigest(), f"chunks={len(pieces)};mean={mean:.4f};values={int((hist > 0).sum())};zeros={int(hist[0])}")
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                                             ["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return in_arrow(lists, run, "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_media(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Payloads with equal bytes are one medium, stored and rebuilt once. Each distinct chunk crosses the network once, to the
    partition of its digest, where Spark keeps one copy and joins the lists that name it; a medium of one chunk is rebuilt
    there, larger ones are gathered by medium. A chunk that more than 1,024 media (and more than a thousandth of all references)
    name is kept in several salted copies, so that no task serves them all; at most 1,024 chunks can be so common, which bounds
    their broadcast table. Null text counts as empty, a payload of zeros; rows that repeat a doc_id each return; a null doc_id comes
    back null; a long text is a medium of many chunks; other columns, whatever their names, play no part; an empty table gives an
    empty result. write_media and read_media keep payloads in a folder and give them back.
    """
    lists = materialize(manifests(docs, text, ident), "op1-manifests")
    media = materialize(lists.groupBy("media_id").agg(F.first("chunks").alias("chunks"), F.count(F.lit(1)).alias("docs")), "op1-media")
    refs = media.select("media_id", F.size("chunks").alias("n"), F.posexplode("chunks").alias("seq", "digest"))
    total = media.agg(F.coalesce(F.sum(F.size("chunks")), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    floor = max(1024, total[0] // 1024)
    heavy = materialize(refs.groupBy("digest").count().filter(F.col("count") > floor).select("digest", F.ceil(F.col("count") / 512).cast("int").alias("salts")), "op1-heavy")
    salted = lambda df: df.join(F.broadcast(heavy), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("media_id"), "salts").cast("int"), F.lit(0))).drop("salts")
    store = salted(chunk_rows(docs, text, ident)).groupBy("digest", "salt").agg(F.first("frame").alias("frame"))
    one = salted(refs.filter("n = 1")).join(store, ["digest", "salt"]).select("media_id", F.array(F.struct("seq", "digest", "frame")).alias("pieces"))
    many = salted(refs.filter("n > 1")).join(store, ["digest", "salt"]).groupBy("media_id").agg(F.collect_list(F.struct("seq", "digest", "frame")).alias("pieces"))
    found = materialize(rebuilt(one.unionByName(many)).join(media.select("media_id", "docs"), "media_id"), "op1-found")
    return lookup(lists.select("doc_id", "n_bytes", "media_id"), found, "media_id", "docs", total[1]).drop("media_id", "docs")


def write_media(docs: DataFrame, path: str, text: str = "text", ident: str = "doc_id") -> None:
    """Keep the payloads of docs under `path`: chunks (digest, frame), each distinct chunk once, and media (doc_id, n_bytes, media_id,
    chunks), the ordered lists that name them."""
    lists = manifests(docs, text, ident)
    lists.write.parquet(f"{path}/media")
    # Copies of a chunk meet per task and salt first, so a common chunk is no task's burden.
    salt = F.pmod(F.xxhash64("media_id"), F.lit(16))
    salted = chunk_rows(docs, text, ident).groupBy("digest", salt.alias("salt")).agg(F.first("frame").alias("frame"))
    salted.groupBy("digest").agg(F.first("frame").alias("frame")).write.parquet(f"{path}/chunks")


def read_media(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, payload, text) of what write_media kept, of the ids in `wanted` (doc_id) or all: chunks joined by their digests, put in
    order and checked; a payload whose SHA-256 isn't its media_id stops the job. text is the payload less its padding."""
    media = spark.read.parquet(f"{path}/media")
    media = media if wanted is None else media.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    each = media.groupBy("media_id").agg(F.first("chunks").alias("chunks")).select("media_id", F.posexplode("chunks").alias("seq", "digest"))
    pieces = each.join(spark.read.parquet(f"{path}/chunks"), "digest").groupBy("media_id").agg(F.collect_list(F.struct("seq", "digest", "frame")).alias("pieces"))

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for media_id, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = b"".join(z.decompress(p["frame"]) for p in sorted(parts, key=lambda p: p["seq"]))
                if hashlib.sha256(payload).digest() != media_id:
                    raise ValueError(f"medium {media_id.hex()} can't be rebuilt from its chunks")
                out.append(payload)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["media_id", "payload"])

    whole = in_arrow(pieces, run, "media_id binary, payload binary")
    return media.join(whole, "media_id").select("doc_id", "payload", F.decode(F.expr("substring(payload, 1, cast(n_bytes as int))"), "UTF-8").alias("text"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_media(table(spark, sf_dir, "documents"))
