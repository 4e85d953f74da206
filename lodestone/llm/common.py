"""Shared pieces: scratch tables, skew-safe lookups, connected components, Arrow text buffers."""
from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEW_EDGES = 1 << 20  # edges that components() unites within one task
HEAVY = 4096  # keys that lookup() broadcasts, at most
FEW_ROWS = 1 << 20  # rows that small() broadcasts, at most
SIEVE = 13  # bits of a hash that name a block of sieved(); 15 more are a place in it
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Where it is unset, a session in one JVM gets a temporary folder; on a
    cluster no machine's own folder would do, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table written by materialize() that nothing reads any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration() if hasattr(df.sparkSession, "_jsc") else df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lookup(left: DataFrame, right: DataFrame, key: str, size_col: str, total: int | None = None) -> DataFrame:
    """left inner join right on key, where right holds each key of left once, with its number of left rows in size_col.

    Keys with more than `floor` rows are broadcast. The sizes add up to the total, so there are HEAVY of them at most, whatever the
    corpus. The others are joined by a shuffle in which no key is large. Both inputs should be written tables.
    """
    if total is None:
        total = right.agg(F.coalesce(F.sum(size_col), F.lit(0))).first()[0]
    floor = max(64, total // HEAVY)
    heavy = right.filter(F.col(size_col) > floor)
    if heavy.isEmpty():
        return left.join(right, key)
    cold = right.filter(F.col(size_col) <= floor)
    hot = left.join(F.broadcast(heavy), key)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(cold, key)
    return hot.unionByName(rest)


def small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """A written table, to be broadcast in a join if it has no more than FEW_ROWS rows (or a greater sum of weights); a larger one is left to
    be joined by a shuffle."""
    size = df.limit(FEW_ROWS + 1).count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= FEW_ROWS else df


def hashed(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """small(), where a table too large for it is joined by a shuffle with a hash table of each of its partitions, so that what it is joined
    with is neither sorted nor spilled. It should be much the smaller of the two, and no key of it large."""
    out = small(df, weight)
    return out.hint("shuffle_hash") if out is df else out


def sieved(left: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """left without most of the rows whose key is none of ids, and with all whose key is one. Keys are hashes of 64 bits, whose first 28 are places of
    a bitmap of 32 MB; that is broadcast, whatever the number of ids. Of n ids a share of n / 2^28 of the other rows stays."""
    block = lambda c: F.shiftrightunsigned(c, 64 - SIEVE)
    at = lambda c: F.shiftrightunsigned(c, 64 - SIEVE - 15).bitwiseAND(32767).cast("int")
    bits = ids.select(block(key).alias("_block"), at(key).cast("long").alias("_at")).repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    bits = materialize(bits, "sieve")
    byte = F.conv(F.hex(F.expr("substring(_bits, shiftright(_at, 3) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftleft(1, _at & 7)").bitwiseAND(byte) != 0
    return left.withColumns({"_block": block(key), "_at": at(key)}).join(F.broadcast(bits), "_block").filter(hit).select(*left.columns)


def having(left: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of left whose key, a hash of 64 bits, is in the written table ids, which holds each once. If it is too large to be broadcast, rows
    are sieved first: few but those that stay go through the shuffle. That join is an inner one, as Catalyst would put a semi join before the sieve."""
    own = small(ids)
    if own is not ids:
        return left.join(own, key, "left_semi")
    return sieved(left, ids, key).join(ids.hint("shuffle_hash"), key).select(*left.columns)


def forget(spark: SparkSession) -> None:
    """The files of shuffles that no plan refers to any more are deleted when the driver's JVM collects its garbage, which one with much memory
    seldom does by itself."""
    spark._jvm.System.gc()


def star_forest(e: DataFrame) -> bool:
    """Whether each end of an edge (a, b) is either the a of some or the b of one: then a is b's component."""
    ends = e.select(F.col("b").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("a").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    node = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return node.filter("below > 1 or (below = 1 and above = 1)").isEmpty()


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges (a, b) and the smallest id that each is connected to."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low, high = np.minimum(label[ia], label[ib]), np.maximum(label[ia], label[ib])
        if (low == high).all():
            return ids, ids[label]
        np.minimum.at(label, high, low)
        while not (label == label[label]).all():
            label = label[label]


def components(edges: DataFrame, tag: str = "cc", rounds: int = 60) -> DataFrame:
    """(id, comp): for every end of an edge (a, b) the smallest id that it is connected to.

    Up to FEW_EDGES edges, 16 MB, are united within one task. More go through alternating large-star and small-star rewrites until
    only stars are left; each is written to the shared folder, and no group is ever gathered: a node's minimum is a partial
    aggregate, joined back by `lookup`. Either way gives the same result.
    """
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), tag)
    if e.count() <= FEW_EDGES:

        def run(batches):
            held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
            if held:
                ids, comp = united(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comp)], ["id", "comp"])

        out = materialize(in_arrow(e.coalesce(1), run, "id long, comp long"), tag)
        discard(e)
        return out
    for _ in range(rounds):
        if star_forest(e):
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("deg")), tag)
        large = materialize(lookup(both, low, "u", "deg").filter("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), tag)
        discard(low)
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg")), tag)
        m = lookup(down, low, "u", "deg")
        small = m.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        new = materialize(small.distinct(), tag)
        for old in (e, large, low):
            discard(old)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = materialize(e.select(F.col("b").alias("id"), F.col("a").alias("comp")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct()), tag)
    discard(e)
    return out


# ---- Arrow text buffers -------------------------------------------------------------------------------------------


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of a few megabytes: the batches of all tasks of an executor lie outside its heap, beside its
    Python workers. A row larger than that is a batch of its own. The session's two limits are lowered to that, never raised, and
    stay so, as the plan runs later."""
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 4 << 20)):
        now = str(df.sparkSession.conf.get(f"spark.sql.execution.arrow.{key}"))
        if not (now.isdigit() and 0 < int(now) <= most):
            df.sparkSession.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df.mapInArrow(run, schema)


U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BINV = pow(BASE, -1, 1 << 64)
C1, C2, C3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, the same everywhere."""
    x = x ^ (x >> U64(30))
    x = x * C1
    x = x ^ (x >> U64(27))
    x = x * C2
    return x ^ (x >> U64(31))


def powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if cache.get("n", 0) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, b in (("up", BASE), ("down", BINV)):
                a = np.full(size, U64(b), U64)
                a[0] = 1
                cache[name] = np.multiply.accumulate(a)
        cache["n"] = size
    return cache["up"][:n], cache["down"][:n]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if col.null_count:
        lens = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
        if lens.sum() != offsets[-1]:
            return utf8(col.fill_null("" if "string" in str(col.type) else b""))
    return raw, offsets


def groups(offsets: np.ndarray, most: int = 1 << 19):
    """Slices of rows whose texts add up to about `most` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans_of_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than space and 0x09-0x0D; rows end words."""
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    prev = np.empty_like(word)
    prev[:1] = False
    prev[1:] = word[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first = word & ~prev
    first[edge] = word[edge]
    starts = np.flatnonzero(first)
    nxt = np.empty_like(word)
    nxt[-1:] = False
    nxt[:-1] = word[1:]
    last = word & ~nxt
    tail = offsets[1:][np.diff(offsets) > 0] - 1
    last[tail] = word[tail]
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


LANE_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
LONG_SPAN = 256


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: eight bytes at a time through a non-linear finaliser, spans over LONG_SPAN bytes by xxHash."""
    lens = ends - starts
    h = mix(lens.astype(U64) * C3 + U64(1))
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))
    with np.errstate(over="ignore"):
        live, at, left = np.flatnonzero(lens <= LONG_SPAN), starts, lens
        if len(live) < len(starts):
            at, left = starts[live], lens[live]
        while len(live):
            v = mix((h if len(live) == len(h) else h[live]) * C1 ^ (lanes[at] & LANE_MASKS[np.minimum(left, 8)]))
            if len(live) == len(h):
                h = v
            else:
                h[live] = v
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(lens > LONG_SPAN)
    if len(long):
        view = memoryview(np.ascontiguousarray(raw))
        h[long] = mix(np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], U64) ^ h[long])
    return h


def rolling(raw: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit polynomial hash of each window of `length` bytes. Equal windows have equal values; different ones nearly always differ,
    though texts can be made for which they don't, so it may choose candidates and must decide nothing."""
    with np.errstate(over="ignore"):
        up, down = powers(len(raw) + 1)
        acc = np.zeros(len(raw) + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * up[:-1], out=acc[1:])
        return mix((acc[length:] - acc[: max(len(raw) - length + 1, 0)]) * down[: max(len(raw) - length + 1, 0)])
