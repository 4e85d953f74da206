"""Operator 4: fuzzy line dedup by SimHash, blocks of words, edit similarity and components."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import C1, C3, U64, components, discard, forget, groups, hash_spans, hashed, having, in_arrow, materialize, mix, small, spans_of_words, table, utf8
from .edits import within
from .linking import alike, dealt, labelled, unsettled

SIMILARITY = 0.8
BLOCKS = 5  # blocks of three words that stand for a line
LONG_BLOCK = 14  # blocks of so many bytes come first: shorter ones are common words
WIDE, SHORT = 14, 60  # bits between SimHashes of lines that share a block; lines under SHORT characters are not held to it
HELD = 24 << 20  # bytes of pairs that a task verifies at once
MARKED = 8  # blocks of a line by which pairs of large blocks are told apart
MANY = 64  # lines of a block beyond which they are compared with leaders first
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[[9, 11, 12, 13]] = 32


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number within the row of each line; the newline belongs to no line."""
    cut = np.flatnonzero(raw == 10)
    rows = np.searchsorted(offsets, cut, "right") - 1
    lens = np.diff(offsets)
    starts = np.sort(np.concatenate((offsets[:-1], cut + 1)))
    ends = np.sort(np.concatenate((offsets[1:], cut)))
    owner = np.sort(np.concatenate((np.arange(len(lens)), rows)))
    first = np.searchsorted(owner, np.arange(len(lens)))
    return starts, ends, owner, np.arange(len(owner)) - first[owner]


def simhashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each line over the hashes of its words; first holds each line's first word, and no line is empty.

    Bits are counted in the bytes of eight 64-bit sums, 255 words at a time."""
    count = np.diff(np.concatenate((first, [len(words)])))
    turns = -(-count // 255)
    base = np.repeat(np.cumsum(turns) - turns, turns)
    part = np.repeat(first, turns) + (np.arange(turns.sum()) - base) * 255
    bits = np.empty((len(first), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat((words >> U64(k)) & U64(0x0101010101010101), part).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[:, k::8] = np.add.reduceat(sums, np.cumsum(turns) - turns, axis=0) if len(sums) > len(first) else sums
    return np.packbits(2 * bits > count[:, None], axis=1, bitorder="little").view(U64).ravel()


class Lines:
    """The lines with a word of some rows: normalised (A-Z in lower case, words joined by single spaces), with their place."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[raw]
        starts, ends, owner, number = lines_of(raw, offsets)
        self.ws, self.we, _ = spans_of_words(self.low, np.concatenate((starts, [len(raw)])) if len(starts) else offsets)
        line = np.searchsorted(starts, self.ws, "right") - 1
        self.first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        self.last = np.concatenate((self.first[1:], [len(line)])).astype(np.int64) if len(line) else self.first
        have = line[self.first]
        self.owner, self.number = owner[have], number[have]
        head, tail = (self.ws[self.first], self.we[self.last - 1]) if len(have) else (self.first, self.first)
        size = np.concatenate(([0], np.cumsum(self.we - self.ws)))
        length = size[self.last] - size[self.first] + self.last - self.first - 1
        plain = length == tail - head
        buf = self.low.tobytes()
        self.texts = [buf[a:b] if ok else b" ".join(buf[a:b].split()) for a, b, ok in zip(head.tolist(), tail.tolist(), plain.tolist(), strict=True)]
        more = np.flatnonzero((self.low & 0xC0) == 0x80)
        self.chars = length - (np.searchsorted(more, tail) - np.searchsorted(more, head))

    def digests(self) -> np.ndarray:
        """128 bits of each line, as two signed longs."""
        return np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=16).digest() for t in self.texts]), np.int64).reshape(-1, 2)


def least(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, tag: int, late: np.ndarray | None = None) -> np.ndarray:
    """n min-hashes of values[start:end] for each span, `late` values after all others; no span is empty."""
    at = np.column_stack((starts, ends)).ravel()
    out = np.empty((len(starts), n), U64)
    last = np.zeros(1, U64)
    for m in range(n):
        turn = mix(np.array([m + 1 + tag], U64) * C3)
        v = mix(values ^ turn) >> U64(1)
        if late is not None:
            v |= late
        out[:, m] = mix(np.minimum.reduceat(np.concatenate((v, last)), at)[::2] ^ turn)
    return out


def blocks(lines: Lines, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key), in the order of lines: the blocks that stand for each line. A few edits leave some block of a line as it was, so
    nearly equal lines share one.

    Of a line's runs of three words the BLOCKS with the least hashes, long ones first; in lines of up to eight words runs of two as
    well; in lines of three words or twenty characters runs of three bytes among lines of about that length."""
    rows, keys = [], []
    count = lines.last - lines.first

    def put(row, key):
        rows.append(np.repeat(row, key.shape[1]))
        keys.append(key.ravel())

    with np.errstate(over="ignore"):
        for k, fits, tag in ((3, count >= 3, 100), (2, (count >= 2) & (count <= 8), 200)):
            at = np.flatnonzero(fits)
            if len(at):
                run = words[: len(words) - k + 1]
                for j in range(1, k):
                    run = mix(run * C1 + words[j : len(words) - k + 1 + j])
                late = (lines.we[k - 1 :] - lines.ws[: len(run)] < LONG_BLOCK).astype(U64) << U64(63)
                put(at, least(run, lines.first[at], lines.last[at] - k + 1, BLOCKS, tag, late))
        at = np.flatnonzero((count <= 3) | (lines.chars < 20))
        if len(at):
            text = [b"\n " + lines.texts[i] + b" " for i in at.tolist()]
            end = np.cumsum([len(x) for x in text])
            start = np.concatenate(([0], end[:-1]))
            raw = np.frombuffer(b"".join(text), np.uint8)
            grams = hash_spans(raw, np.arange(len(raw) - 2), np.arange(2, len(raw)) + 1)
            low = least(grams, start, end - 2, 24, 300)
            size = np.floor(np.log(np.maximum(lines.chars[at], 1)) / np.log(1.25) + 1e-9).astype(np.int64)
            for short, key in ((True, low[:, :12]), (False, mix(low[:, ::2] * C1 + low[:, 1::2]))):
                fits = (lines.chars[at] < 14) if short else (lines.chars[at] >= 10)
                for step in (0, 1):
                    put(at[fits], mix(key[fits] ^ mix((size[fits] + step).astype(U64) + U64(7 * short))[:, None]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def keyed(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """(doc_id, tkey, text): a row is known by its id and a hash of its text, so rows that repeat an id with other texts stay apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.xxhash64(t).alias("tkey"), t.alias("_text"))


def line_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, line, d1, d2, sim, chars, keys) of each line with a word: its place, digest, SimHash, length and blocks. A task gives
    the blocks of equal lines once; the others' are null."""

    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            ids, tkeys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in groups(offsets):
                lines = Lines(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not len(lines.first):
                    continue
                words = hash_spans(lines.low, lines.ws, lines.we)
                digest = lines.digests()
                d1 = digest[:, 0].copy()
                kinds, at = np.unique(d1, return_index=True)
                new = ~np.isin(kinds, seen, assume_unique=True) if len(seen) else np.ones(len(kinds), bool)
                seen = np.sort(np.concatenate((seen, kinds[new]))) if len(seen) < 1 << 21 else kinds
                fresh = np.zeros(len(d1), bool)
                fresh[at[new]] = True
                row, key = blocks(lines, words)
                keep = fresh[row]
                bounds = np.searchsorted(row[keep], np.arange(len(d1) + 1)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(bounds), pa.array(key[keep].view(np.int64)), mask=pa.array(~fresh))
                own = lines.owner
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][own]), pa.array(tkeys[i:j][own]), pa.array(lines.number.astype(np.int32)), pa.array(d1), pa.array(digest[:, 1].copy()),
                     pa.array(simhashes(words, lines.first).view(np.int64)), pa.array(lines.chars.astype(np.int32)), keys],
                    ["doc_id", "tkey", "line", "d1", "d2", "sim", "chars", "keys"])

    return in_arrow(docs, run, "doc_id long, tkey long, line int, d1 long, d2 long, sim long, chars int, keys array<long>")


def line_texts(docs: DataFrame) -> DataFrame:
    """(id, d2, line): the normalised lines, equal ones once a slice of text; id is the first half of a line's digest."""

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for i, j in groups(offsets):
                lines = Lines(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not len(lines.first):
                    continue
                digest = lines.digests()
                at = np.unique(digest[:, 0], return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(digest[at, 0]), pa.array(digest[at, 1]), pa.array([lines.texts[k] for k in at.tolist()], pa.binary())], ["id", "d2", "line"])

    return in_arrow(docs, run, "id long, d2 long, line binary")


def near(sims: np.ndarray, chars: np.ndarray, sim, length) -> np.ndarray:
    """Whether lines are worth an edit distance from a line: by their lengths, and by SimHash unless one is short."""
    longer, shorter = np.maximum(chars, length), np.minimum(chars, length)
    fits = shorter >= longer - np.floor(longer * (1 - SIMILARITY) + 1e-9)
    return fits & ((np.bitwise_count(sims ^ sim) <= WIDE) | (shorter < SHORT))


def near_pairs(ids: np.ndarray, sims: np.ndarray, chars: np.ndarray, comps: np.ndarray | None = None):
    """Pairs of rows (i, j), of different components if given, that are near."""
    for k in range(len(ids) - 1):
        ok = near(sims[k + 1 :], chars[k + 1 :], sims[k], chars[k])
        if comps is not None:
            ok &= comps[k + 1 :] != comps[k]
        hit = np.flatnonzero(ok) + k + 1
        if len(hit):
            yield np.full(len(hit), k), hit


def crossing(bucket: int, comps: np.ndarray, sigs: np.ndarray, marks: np.ndarray, least: float):
    """near_pairs for rows whose signature is SimHash and length; of pairs that share a block among the marked ones only in the first."""
    packed, here = np.ascontiguousarray(sigs), np.uint32(bucket & 0xFFFFFFFF)
    for k, other in near_pairs(comps, packed[:, :8].copy().view(U64).ravel(), packed[:, 8:].copy().view(np.int32).ravel().astype(np.int64), comps):
        own = marks[k[0]]
        shared = marks[other] == own
        other = other[~shared.any(axis=1) | (own[shared.argmax(axis=1)] == here)]
        yield k[: len(other)], other


def met(rows: DataFrame) -> DataFrame:
    """(a, b, bits, bucket) from rows (bucket, id, sim, chars): near pairs of ids that share a bucket, and by how many bits their SimHashes
    differ. In buckets of over MANY ids only those of a leader, the first id that is near no earlier leader, with the ids near it;
    then a row (id, null, null, bucket) for each id names the bucket."""

    def run(batches):
        keep = None

        def pairs(bucket, ids, sims, chars):
            a, b, bits, big, member = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def put(x, y, s, t):
                a.append(x)
                b.append(y)
                bits.append(np.bitwise_count(s ^ t).astype(np.int32))

            size = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            count = np.diff(np.concatenate((size, [len(bucket)])))  # 1 where equal lines alone shared the bucket
            two = size[count == 2]
            ok = near(sims[two], chars[two], sims[two + 1], chars[two + 1])
            put(ids[two[ok]], ids[two[ok] + 1], sims[two[ok]], sims[two[ok] + 1])
            for s, n in zip(size[count > 2].tolist(), count[count > 2].tolist(), strict=True):
                i, h, c = ids[s : s + n], sims[s : s + n], chars[s : s + n]
                if n <= MANY:
                    for x, y in near_pairs(i, h, c):
                        put(i[x], i[y], h[x], h[y])
                else:
                    big.append(bucket[s : s + n])
                    member.append(i)
                    left = np.arange(n)
                    while len(left) > 1:
                        head, left = left[0], left[1:]
                        ok = near(h[left], c[left], h[head], c[head])
                        put(np.full(int(ok.sum()), i[head]), i[left[ok]], h[left[ok]], h[head])
                        left = left[~ok]
            pairs_ = [np.concatenate(x) for x in (a, b, bits)]
            big, member = np.concatenate(big), np.concatenate(member)
            none, some = len(big), len(pairs_[0])
            cols = [pa.array(np.concatenate((pairs_[0], member)))]
            cols += [pa.concat_arrays([pa.array(x), pa.nulls(none, t)]) for x, t in zip(pairs_[1:], (pa.int64(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays([*cols, pa.concat_arrays([pa.nulls(some, pa.int64()), pa.array(big)])], ["a", "b", "bits", "bucket"])

        def settled(cols):
            same = cols[0][1:] == cols[0][:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            cols = [c[shared] for c in cols]
            order = np.lexsort((cols[1], cols[0]))
            cols = [c[order] for c in cols]
            if not len(order):
                return None
            new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))  # equal lines of several tasks
            return pairs(*[c[new] for c in cols])

        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in range(4)]
            cols = [cols[0], cols[1], cols[2].view(U64), cols[3].astype(np.int64)]
            if keep is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(keep, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            keep = [c[cut:] for c in cols]
            out = settled([c[:cut] for c in cols]) if cut else None
            if out is not None and len(out):
                yield out
        if keep is not None and len(keep[0]):
            out = settled(keep)
            if out is not None and len(out):
                yield out

    return in_arrow(rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "id", "sim", "chars"), run, "a long, b long, bits int, bucket long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose lines are within the edit distance. A line goes to each pair of which it is the second, and once
    to those of which it is the first."""
    second = texts.select(F.col("id").alias("b"), F.col("line").alias("lb")).join(small(pairs), "b")
    both = second.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").select("a", "b", "la", "lb")

    def run(batches):
        held, size = [], 0

        def flush():
            keep = within([x for h in held for x in h[2]], [x for h in held for x in h[3]], 1 - SIMILARITY)
            cols = [np.concatenate([h[k] for h in held])[np.array(keep, bool)] for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b"])

        for batch in batches:  # many pairs at once: they are worked out in batches of like length
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            size += batch.nbytes
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return in_arrow(both, run, "a long, b long")


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one component."""
    c = small(comps)
    own = pairs.join(c.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").join(c.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
    return own.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def linked_lines(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(d1, d2, g1, g2): for each line digest that is linked to others, the digest that names its group.

    Each line is held against its nearest neighbour by SimHash first, of those about as near the one that most have in common; of the other pairs those whose ends are not connected by then
    are verified as well, and at last those of large blocks."""
    rows = prints.filter("keys is not null").select(F.explode(F.array_distinct("keys")).alias("bucket"), F.col("d1").alias("id"), "sim", "chars")
    found = materialize(met(rows), "op4-met")
    forget(docs.sparkSession)
    pairs = materialize(found.filter("bucket is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits").filter("a < b").distinct(), "op4-pairs")
    big = materialize(found.filter("bucket is not null").select("bucket", F.col("a").alias("id")), "op4-big")
    large = not big.isEmpty()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    if large:
        flat = lambda c, n: F.reverse(F.unhex(F.lpad(F.hex(c), n, "0")))  # noqa: E731  little-endian
        mark = lambda k: flat(F.coalesce(F.get("keys", F.lit(k)), F.xxhash64("id", F.lit(k))).bitwiseAND(0xFFFFFFFF), 8)
        sig = F.concat(flat("sim", 16), flat(F.col("chars").cast("long"), 8), *[mark(k) for k in range(MARKED)])
        own = prints.filter("keys is not null").select(F.col("d1").alias("id"), "sim", "chars", "keys")
        many = materialize(own.join(small(big), "id").select("bucket", "id", sig.alias("sig")).dropDuplicates(["bucket", "id"]), "op4-many")
        ids = ids.union(many.select("id"))
    lines = having(line_texts(docs), materialize(ids.distinct(), "op4-ids"), "id").groupBy("id").agg(F.min("d2").alias("d2"), F.min_by("line", "d2").alias("line"))
    texts = materialize(lines, "op4-texts")
    discard(found)
    judged = materialize(pairs.groupBy("b").agg(F.min_by("a", F.struct((F.col("bits") / 4).cast("int"), "a")).alias("a")).select("a", "b"), "op4-nearest")
    links = materialize(verified(judged, texts), "op4-links")
    comps = components(links, "op4-comps")

    def judge(more: DataFrame) -> None:
        nonlocal judged, comps
        more = materialize(apart(more, comps).join(small(judged), ["a", "b"], "left_anti"), "op4-pairs")
        need = materialize(more.select(F.col("a").alias("id")).union(more.select("b")).distinct(), "op4-ids")
        found = materialize(verified(more, having(texts, need, "id")), "op4-links")
        judged = materialize(judged.unionByName(more), "op4-judged")
        comps = components(found.unionByName(comps.select(F.col("comp").alias("a"), F.col("id").alias("b"))), "op4-comps")
        forget(docs.sparkSession)

    judge(pairs.select("a", "b"))
    if large:
        hubs = many.groupBy("bucket").agg(F.min("id").alias("hub"))
        left = unsettled(materialize(labelled(many.join(hubs, "bucket"), comps), "op4-left"), "op4-left")
        cells = materialize(dealt(left), "op4-cells")
        judge(materialize(alike(cells, 0, crossing, MARKED), "op4-rest"))
        discard(cells)
    own = texts.select("id", "d2")
    named = comps.join(own, "id").select(F.col("id").alias("d1"), "d2", F.col("comp").alias("g1"))
    heads = own.select(F.col("id").alias("g1"), F.col("d2").alias("g2"))
    return materialize(named.join(heads, "g1").select("d1", "d2", "g1", "g2"), "op4-named")


def removed_lines(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, tkey, lines): of each document that loses lines their numbers; tkey is xxhash64 of its text.

    Lines are compared in lower case (A-Z), words joined by single spaces; equal ones form a class. Classes that share a block
    of words, and whose SimHashes are near, are linked when their edit distance is at most a fifth of the longer one. Of each
    connected group the first occurrence by (doc_id, line) stays, all others go.

    A line without a word is never removed. Rows with a null doc_id lose nothing and count for nothing; rows that repeat
    a doc_id with another text are documents of their own, those that repeat the text too count as one. Lines may be of
    any length; an empty table gives an empty result.
    """
    docs = keyed(docs.filter(F.col(ident).isNotNull()), text, ident)
    prints = materialize(line_prints(docs), "op4-lines", "lz4")
    named = linked_lines(docs, prints)
    place = F.struct("doc_id", "line", "tkey")
    tagged = prints.select("doc_id", "line", "tkey", "d1", "d2").join(hashed(named), ["d1", "d2"], "left")
    tagged = tagged.select("doc_id", "line", "tkey", F.coalesce("g1", "d1").alias("g1"), F.coalesce("g2", "d2").alias("g2"))
    several = materialize(tagged.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "op4-several")
    again = materialize(tagged.join(hashed(several.drop("n")), ["g1", "g2"]), "op4-again")
    discard(prints)
    first = materialize(again.groupBy("g1", "g2").agg(F.min(place).alias("first")), "op4-first")
    gone = again.join(hashed(first), ["g1", "g2"]).filter(place != F.col("first")).select("doc_id", "tkey", "line")
    lists = materialize(gone.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("line")).alias("lines")), "op4-lists")
    discard(again)
    forget(docs.sparkSession)
    return lists


def cut(docs: DataFrame, lists: DataFrame, text: str = "text", ident: str = "doc_id", digest: bool = False) -> DataFrame:
    """docs less the lines in lists, with two more columns, _n_lines and _n_removed (the columns of docs may have any names: those come
    back as c0, c1, ...). With `digest` the text is replaced by its SHA-256."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at, own = docs.columns.index(text), docs.columns.index(ident)
    plain = docs.toDF(*names)
    key = plain.withColumn("_tkey", F.xxhash64(F.coalesce(F.col(names[at]), F.lit(""))))
    both = key.join(hashed(lists.toDF("_id", "_k", "_lines"), weight=1 + F.size("_lines")), (F.col(names[own]).cast("long") == F.col("_id")) & (F.col("_tkey") == F.col("_k")), "left").select(*names, "_lines")
    fields = [T.StructField(f.name, T.StringType() if k == at else f.dataType) for k, f in enumerate(plain.schema.fields)]

    def run(batches):
        for batch in batches:
            texts, total, removed = [], [], []
            for t, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                parts = (t or "").split("\n")
                if gone:
                    drop = set(gone)
                    t = "\n".join([p for k, p in enumerate(parts) if k not in drop])
                texts.append(hashlib.sha256((t or "").encode()).hexdigest() if digest else t)
                total.append(len(parts))
                removed.append(len(gone or ()))
            cols = [batch.column(k) for k in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "_n_lines", "_n_removed"])

    return in_arrow(both, run, T.StructType([*fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_removed", T.LongType())]))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left). Null texts count as one empty line. What else is removed,
    and what isn't, is told at removed_lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = cut(docs, removed_lines(docs), digest=True)
    return out.select(F.col("c0").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("c1").alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs, each with its text less the removed lines and n_chars, if there is such a column, to match; documents that lose every
    word are left out. Other columns, whatever their names, stay as they are."""
    out = cut(docs, removed_lines(docs, text, ident), text, ident)
    body = F.col(f"c{docs.columns.index(text)}")
    out = out.filter((F.col("_n_removed") == 0) | F.coalesce(body.rlike(r"[^\s]"), F.lit(False)))
    if "n_chars" in docs.columns:
        c = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(c, F.when(F.col("_n_removed") > 0, F.char_length(body).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(c)))
    return out.drop("_n_lines", "_n_removed").toDF(*docs.columns)
