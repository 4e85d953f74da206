"""Operator 6: repeated byte strings by bounded interval expansion on a Burrows-Wheeler transform."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, discard, groups, hash_spans, in_arrow, lookup, materialize, rolling, spans_of_words, table, utf8

LENGTH = 400
GRAM = 64
HOT, SLICE = 4096, 2048
BATCH = 2 << 20
PASSAGE, PASSAGE_GRAM = 51, 16  # words of a passage, and of the grams that choose what to compare
WINDOWS = 1 << 14  # windows of passages in a batch of rows, about
REACH = 1 << 24  # window starts of a text that are worked on at once; their places fit into 28 bits


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of consecutive window starts that share their minimiser: (row, start, count, gram hash).

    A window's minimiser is the leftmost of its grams with the least hash, so equal windows have equal minimisers at
    the same place in them. Each window belongs to exactly one run. raw has fewer than 2**28 bytes, or hashes of words.
    """
    width = length - gram + 1
    lens = np.diff(offsets)
    if not (lens >= length).any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    g = rolling(raw, gram)
    packed = (g & ~U64((1 << 28) - 1)) | np.arange(len(g), dtype=U64)
    n = -(-len(packed) // width) * width
    blocks = np.full(n, U64(0xFFFFFFFFFFFFFFFF), U64)
    blocks[: len(packed)] = packed
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b - a >= length])
    least = (np.minimum(behind[starts], ahead[starts + width - 1]) & U64((1 << 28) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, last = starts[new], starts[np.concatenate((new[1:] - 1, [len(starts) - 1]))]
    return np.searchsorted(offsets, first, "right") - 1, first, last - first + 1, g[least[new]]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of text in the order of their first `depth` bytes, by prefix doubling of what isn't told apart yet."""
    n = len(text)
    wrapped = np.concatenate((text, np.resize(text, 8))).astype(U64)
    key = np.zeros(n, U64)
    for i in range(8):
        key = (key << U64(8)) | wrapped[i : i + n]
    sa = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[sa][1:] != key[sa][:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while h < depth:
        head = np.flatnonzero(new)
        size = np.diff(np.concatenate((head, [n])))
        open_ = np.repeat(size > 1, size)
        slots = np.flatnonzero(open_)
        if not len(slots):
            break
        i = sa[slots]
        nxt = i + h
        nxt[nxt >= n] %= n
        key = rank[i] * n + rank[nxt]
        order = np.argsort(key, kind="stable")
        sa[slots], key = i[order], key[order]
        new[slots] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[sa[slots]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[slots]
        h *= 2
    return sa


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """For each position of text, whether the `length` bytes there (cyclically) start at another position as well.

    Breadth-first over the string intervals of the transform: the interval of w at level |w| is extended backward by each
    byte before it, and an extension whose right border has no value yet gets |w| as common prefix there and goes on. Borders
    so get their values in increasing order; after `length` levels, those without one have a common prefix of `length` or more.
    """
    n = len(text)
    sa = suffix_array(text, length)
    bwt = text[sa - 1]
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[order] = np.arange(n)
    symbol = bwt[order]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        to = lf[at]
        by = np.argsort(to, kind="stable")
        to, owner = to[by], owner[by]
        cut = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[to[1:]] != symbol[to[:-1]]))))
        low, high = to[cut], to[np.concatenate((cut[1:] - 1, [len(to) - 1]))] + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
        if not len(low):
            break
    shares = ~known
    out = np.zeros(n, bool)
    inner = np.flatnonzero(shares[1:n]) + 1
    out[sa[inner]] = True
    out[sa[inner - 1]] = True
    return out


def keyed(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """(doc_id, tkey, text): a row is known by its id and a hash of its text, so rows that repeat an id with other texts stay apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.xxhash64(t).alias("tkey"), t.alias("_text"))


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, tkey, start, count, gram, c1, c2): the runs of all texts; c1 and c2 are 128 bits of the run's bytes."""

    def digests(buf, starts, counts):
        spans = zip(starts.tolist(), (starts + counts - 1 + length).tolist(), strict=True)
        return np.frombuffer(b"".join([hashlib.blake2b(buf[a:b], digest_size=16).digest() for a, b in spans]), np.int64).reshape(-1, 2)

    def parts(raw, offsets):
        for i, j in groups(offsets):
            if j - i > 1 or offsets[j] - offsets[i] <= REACH + length:  # several texts make a small group
                yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0
            else:
                for at in range(0, int(offsets[j] - offsets[i]) - length + 1, REACH):
                    block = raw[offsets[i] + at : min(offsets[i] + at + REACH + length - 1, offsets[j])]
                    yield i, j, block, np.array([0, len(block)]), at

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            ids, tkeys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j, block, bounds, at in parts(raw, offsets):
                row, start, count, g = anchors(block, bounds, length, gram)
                if len(row):
                    c = digests(memoryview(np.ascontiguousarray(block)), start, count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i:j][row]), pa.array(tkeys[i:j][row]), pa.array((start - bounds[row] + at).astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())],
                        ["doc_id", "tkey", "start", "count", "gram", "c1", "c2"])

    return in_arrow(docs, run, "doc_id long, tkey long, start long, count int, gram long, c1 long, c2 long")


def cut_out(docs: DataFrame, length: int) -> DataFrame:
    """(gram, slice, hot, doc_id, tkey, start, n, piece) from (doc_id, tkey, text, at array<struct>): the bytes of each run in `at`."""
    names = ["gram", "slice", "hot", "doc_id", "tkey", "start", "n", "piece"]

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            lists = batch.column(3)
            lo = np.asarray(lists.offsets)
            flat = lists.values
            col = {f: np.asarray(flat.field(f)) for f in ("start", "count", "gram", "slice", "hot", "n")}
            ids, tkeys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            buf = raw.tobytes()
            for k in range(0, len(ids), 256):
                to = min(k + 256, len(ids))
                a, b = lo[k], lo[to]
                own = np.repeat(np.arange(k, to), np.diff(lo[k : to + 1]))
                pieces = [buf[offsets[r] + s : offsets[r] + s + c - 1 + length] for r, s, c in zip(own, col["start"][a:b], col["count"][a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([*[pa.array(col[f][a:b]) for f in names[:3]], pa.array(ids[own]), pa.array(tkeys[own]), pa.array(col["start"][a:b]), pa.array(col["n"][a:b]), pa.array(pieces, pa.binary())], names)

    return in_arrow(docs, run, "gram long, slice int, hot int, doc_id long, tkey long, start long, n long, piece binary")


def starts_of(lens: np.ndarray, base: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of pieces that begin at base, and the piece of each."""
    count = lens - length + 1
    own = np.repeat(np.arange(len(lens)), count)
    return np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + base[own], own


def repeating(raws: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the pieces its piece, its place there, and whether its bytes are those of another window too.

    The transform judges what may repeat at all: the stretch of each piece from its first to its last window whose rolling hash
    another window has."""
    lens = np.array([len(r) for r in raws])
    base = np.concatenate(([0], np.cumsum(lens)))[:-1]
    whole = b"".join(raws)
    at, own = starts_of(lens, base, length)
    h = rolling(np.frombuffer(whole, np.uint8), length)[at]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    maybe = np.zeros(len(h), bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    flag = np.zeros(len(h), bool)
    hit = np.flatnonzero(maybe)
    if len(hit):
        head = np.flatnonzero(np.concatenate(([True], own[hit][1:] != own[hit][:-1])))
        tail = np.concatenate((head[1:], [len(hit)])) - 1
        lo, hi = at[hit[head]], at[hit[tail]] + length
        text = np.frombuffer(b"\xff".join([whole[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]) + b"\xff", np.uint8)
        there, which = starts_of(hi - lo, np.concatenate(([0], np.cumsum(hi - lo + 1)))[:-1], length)
        first = np.concatenate(([0], np.cumsum(hi - lo - length + 1)))[:-1]
        spot = hit[head][which] + np.arange(len(which)) - first[which]
        flag[spot] = repeated(text, length)[there]
        flag &= maybe
    return own, at - base[own], flag


def judged(pieces: DataFrame, length: int) -> DataFrame:
    """Window starts of the pieces that repeat among the pieces beside them, as spans (kind 0: doc_id, tkey, start, end in bytes), and for
    hot grams each window's digest (kind 1: not found to repeat here; kind 2: one of each that does), to be compared across slices."""
    names = ["kind", "doc_id", "tkey", "start", "end", "h1", "h2"]

    def work(hot, ids, tkeys, starts, n, raws):
        own, place, flag = repeating(raws, length)
        edge = flag & (n[own] == 1)
        step = np.concatenate(([True], (own[1:] != own[:-1])))
        lo = np.flatnonzero(edge & (step | ~np.concatenate(([False], edge[:-1]))))
        hi = np.flatnonzero(edge & np.concatenate((step[1:] | ~edge[1:], [True])))
        s, none = starts[own[lo]] + place[lo], np.zeros(len(lo), np.int64)
        yield out(np.zeros(len(lo), np.int32), ids[own[lo]], tkeys[own[lo]], s, s + hi - lo + length, none, none)
        if hot.any():
            w = np.flatnonzero(hot[own] == 1)
            digest = np.frombuffer(b"".join([hashlib.blake2b(raws[r][a : a + length], digest_size=16).digest() for r, a in zip(own[w].tolist(), place[w].tolist(), strict=True)]), np.int64).reshape(-1, 2)
            kind = np.where(flag[w] | (n[own[w]] > 1), 2, 1).astype(np.int32)
            pick = kind == 1
            two = np.flatnonzero(~pick)
            pick[two[np.unique(digest[two], axis=0, return_index=True)[1]]] = True
            s = starts[own[w]] + place[w]
            yield out(kind[pick], ids[own[w]][pick], tkeys[own[w]][pick], s[pick], s[pick] + length, digest[pick, 0], digest[pick, 1])

    def out(*cols):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            raw, offsets = utf8(batch.column(7))
            if not len(batch):
                continue
            key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            new = np.concatenate(([True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])))
            rest = [np.asarray(batch.column(i)) for i in (2, 3, 4, 5, 6)]
            buf = raw.tobytes()
            a = 0
            for b in [*np.flatnonzero(new)[1:].tolist(), len(new)]:
                k = (key[0][a], key[1][a])
                if size > BATCH and held and held[-1][0] != k:
                    yield from flush(held)
                    held, size = [], 0
                held.append((k, *[c[a:b] for c in rest], [buf[offsets[r] : offsets[r + 1]] for r in range(a, b)]))
                size += int(offsets[b] - offsets[a])
                a = b
        if held:
            yield from flush(held)

    def flush(held):
        yield from work(*[np.concatenate([h[i] for h in held]) for i in range(1, 6)], [r for h in held for r in h[6]])

    order = pieces.repartition("gram", "slice").sortWithinPartitions("gram", "slice").select("gram", "slice", "hot", "doc_id", "tkey", "start", "n", "piece")
    return in_arrow(order, run, "kind int, doc_id long, tkey long, start long, end long, h1 long, h2 long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, tkey, start, end): byte spans covered by strings of `length` bytes that start elsewhere too; tkey is xxhash64 of the text.
    Spans may overlap.

    Every window of `length` bytes has one minimiser gram. Runs of windows with equal gram and equal bytes repeat as a whole. Runs
    with equal grams and different bytes are brought together by gram, and the transform tells which of their windows
    repeat. A gram with more than HOT different runs is cut into slices; its windows are then compared across slices by digest.
    """
    docs = keyed(docs.filter(F.col(ident).isNotNull()), text, ident)
    rows = materialize(anchor_rows(docs, length, gram), "op6-anchors", "lz4")
    runs = materialize(rows.groupBy("gram", "c1", "c2").agg(F.min(F.struct("doc_id", "tkey", "start", "count")).alias("at"), F.count(F.lit(1)).alias("n")), "op6-runs", "lz4")
    by_gram = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("ctxs"), F.min("n").alias("least")).filter("ctxs > 1 and least = 1").select("gram", "ctxs")
    by_gram = materialize(by_gram, "op6-grams")
    check = lookup(runs, by_gram, "gram", "ctxs").withColumn("hot", (F.col("ctxs") > HOT).cast("int"))
    check = check.withColumn("slice", F.when(F.col("hot") == 1, F.pmod(F.xxhash64("c1"), F.ceil(F.col("ctxs") / SLICE).cast("int"))).otherwise(0).cast("int"))
    lists = check.groupBy("at.doc_id", "at.tkey").agg(F.collect_list(F.struct(F.col("at.start").alias("start"), F.col("at.count").alias("count"), "gram", "slice", "hot", "n")).alias("at"))
    lists = materialize(lists, "op6-lists")
    there = docs.join(lists, ["doc_id", "tkey"]).select("doc_id", "tkey", "_text", "at")
    found = materialize(judged(cut_out(there, length), length), "op6-judged")
    spans = found.filter("kind = 0").select("doc_id", "tkey", "start", "end")
    windows = found.filter("kind > 0")
    again = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    spans = spans.unionByName(windows.filter("kind = 1").join(again, ["h1", "h2"], "left_semi").select("doc_id", "tkey", "start", "end"))
    key = F.struct("gram", "c1", "c2")
    twice = materialize(runs.filter("n > 1").select(key.alias("key"), "n"), "op6-twice")
    whole = lookup(rows.withColumn("key", key), twice, "key", "n")
    return spans.unionByName(whole.select("doc_id", "tkey", "start", (F.col("start") + F.col("count") - 1 + length).alias("end")))


def word_blocks(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Slices of rows with their words: (first row, row after the last, starts, ends, first word of each row, whether a text begins there).
    A text of over REACH bytes goes in blocks that overlap by length - 1 words, so each window of `length` words lies in one of them."""
    for i, j in groups(offsets):
        at, end, size = int(offsets[i]), int(offsets[j]), REACH
        if j - i > 1 or end - at <= REACH:
            starts, ends, rows = spans_of_words(raw[at:end], offsets[i : j + 1] - at)
            yield i, j, starts + at, ends + at, np.searchsorted(rows, np.arange(j - i + 1)), True
            continue
        while True:
            to = min(at + size, end)
            starts, ends, _ = spans_of_words(raw[at:to], np.array([0, to - at]))
            if to < end and len(ends) and ends[-1] == to - at:  # a word that may go on
                starts, ends = starts[:-1], ends[:-1]
            if to < end and len(starts) < length:
                size *= 2
                continue
            yield i, j, starts + at, ends + at, np.array([0, len(starts)]), at == offsets[i]
            if to == end:
                break
            at, size = at + int(starts[len(starts) - length + 1]), REACH


def passage_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, doc_id, tkey, start, end, head, gram, c1, c2): the runs of all windows of `length` words, as anchors() finds them over the words'
    hashes, in bytes, with a number of the row of docs; head: the run holds the text's first word; c1 and c2 are 128 bits of the run's words."""

    def digests(raw, starts, ends, first, last):
        at = np.concatenate(([0], np.cumsum(ends - starts + 1)))  # the words one after the other, a space behind each
        flat = np.concatenate((raw, [np.uint8(32)]))[np.arange(at[-1]) + np.repeat(starts - at[:-1], ends - starts + 1)]
        flat[at[1:] - 1] = 32
        buf = memoryview(flat)
        return np.frombuffer(b"".join([hashlib.blake2b(buf[a:b], digest_size=16).digest() for a, b in zip(at[first].tolist(), at[last + 1].tolist(), strict=True)]), np.int64).reshape(-1, 2)

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(3))
            numbers, ids, tkeys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            for i, j, starts, ends, bounds, begins in word_blocks(raw, offsets, length):
                row, first, count, g = anchors(hash_spans(raw, starts, ends), bounds, length, gram)
                if len(row):
                    last = first + count + length - 2
                    lo, hi = starts[0], ends[-1]
                    c = digests(raw[lo:hi], starts - lo, ends - lo, first, last)
                    base = offsets[i:j][row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (numbers[i:j][row], ids[i:j][row], tkeys[i:j][row], starts[first] - base, ends[last] - base, (first == bounds[row]) & begins, g.view(np.int64), c[:, 0].copy(), c[:, 1].copy())],
                        ["row", "doc_id", "tkey", "start", "end", "head", "gram", "c1", "c2"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "tkey", "_text")
    return in_arrow(numbered, run, "row long, doc_id long, tkey long, start long, end long, head boolean, gram long, c1 long, c2 long")


def passage_windows(docs: DataFrame, length: int) -> DataFrame:
    """(row, h1, h2) from (row, text, at array<struct<start, end>>): 128 bits of each window of `length` words in `at`."""

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            lists = batch.column(2)
            lo = np.asarray(lists.offsets)
            a, b = np.asarray(lists.values.field("start")), np.asarray(lists.values.field("end"))
            numbers = np.asarray(batch.column(0))
            buf = memoryview(np.ascontiguousarray(raw))
            own = np.repeat(np.arange(len(numbers)), np.diff(lo))
            found, sizes, k = [], [], 0
            for m, (r, x, y) in enumerate(zip(offsets[own].tolist(), a[lo[0] : lo[-1]].tolist(), b[lo[0] : lo[-1]].tolist(), strict=True), 1):
                words = bytes(buf[r + x : r + y]).split()
                found += [hashlib.blake2b(b" ".join(words[w : w + length]), digest_size=16).digest() for w in range(len(words) - length + 1)]
                sizes.append(len(words) - length + 1)
                if len(found) >= WINDOWS or m == len(own):
                    h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[np.repeat(own[k:m], sizes)]), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["row", "h1", "h2"])
                    found, sizes, k = [], [], m

    return in_arrow(docs, run, "row long, h1 long, h2 long")


def shared_passages(docs: DataFrame, length: int = PASSAGE, gram: int = PASSAGE_GRAM, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, tkey): the documents that hold `length` consecutive words which another document holds as well, whatever white space lies
    between them; tkey is xxhash64 of the text.

    As in repeated_spans each window belongs to one run, and equal windows have equal grams, so grams of one document settle
    nothing and go first. A run that two documents have settles both. The windows of different runs with equal grams are compared by
    digest, one row each, so no group is gathered.
    """
    docs = keyed(docs.filter(F.col(ident).isNotNull()), text, ident)
    size, several = F.count(F.lit(1)).alias("n"), F.min("row") < F.max("row")
    rows = materialize(passage_rows(docs, length, gram), "op6-passage-rows", "lz4")
    ids = materialize(rows.filter("head").select("row", "doc_id", "tkey"), "op6-passage-ids")
    by_gram = materialize(rows.groupBy("gram").agg(size, several.alias("several")).filter("several").select("gram", "n"), "op6-passage-grams")
    near = materialize(lookup(rows.select("row", "start", "end", "gram", "c1", "c2"), by_gram, "gram", "n").drop("n"), "op6-passage-near", "lz4")
    discard(rows)
    place = [F.first(c).alias(c) for c in ("row", "start", "end")]
    runs = materialize(near.groupBy("gram", "c1", "c2").agg(*place, size, several.alias("shared")), "op6-passage-runs", "lz4")
    key = F.struct("gram", "c1", "c2").alias("key")
    twice = materialize(runs.filter("shared").select(key, "n"), "op6-passage-twice")
    found = materialize(lookup(near.select("row", key), twice, "key", "n").select("row").distinct(), "op6-passage-found")
    discard(near)
    open_ = materialize(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("ctxs"), F.min("shared").alias("all")).filter("ctxs > 1 and not all").select("gram", "ctxs"), "op6-passage-open")
    lists = lookup(runs.select("row", "start", "end", "gram"), open_, "gram", "ctxs").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("at"))
    lists = materialize(lists.join(ids, "row"), "op6-passage-lists")
    windows = materialize(passage_windows(docs.join(lists, ["doc_id", "tkey"]).select("row", "_text", "at"), length), "op6-passage-windows", "lz4")
    key = F.struct("h1", "h2").alias("key")
    again = materialize(windows.groupBy("h1", "h2").agg(size, several.alias("several")).filter("several").select(key, "n"), "op6-passage-again")
    more = lookup(windows.select("row", key), again, "key", "n").select("row")
    out = materialize(found.unionByName(more).distinct().join(ids, "row").select("doc_id", "tkey").distinct(), "op6-passages")
    for old in (ids, by_gram, runs, twice, found, open_, lists, windows, again):
        discard(old)
    return out


def remove_spans(docs: DataFrame, spans: DataFrame, text: str = "text", ident: str = "doc_id", passages: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats, shares_passage): the text's bytes without the spans, which are merged
    first; whether there were any; whether the document is in passages (doc_id, tkey), null where there is no such table."""
    spans = spans.select("doc_id", "tkey", F.struct("start", "end").alias("span"), F.lit(False).alias("passage"))
    if passages is not None:
        spans = spans.unionByName(passages.select("doc_id", "tkey", F.lit(None).cast("struct<start: long, end: long>").alias("span"), F.lit(True).alias("passage")))
    lists = materialize(spans.groupBy("doc_id", "tkey").agg(F.collect_list("span").alias("at"), F.max("passage").alias("passage")), "op6-spans")
    lists = lists.toDF("_id", "_k", "at", "passage")
    own = keyed(docs, text, ident)
    shares = F.lit(None).cast("boolean") if passages is None else F.coalesce("passage", F.lit(False))
    both = own.join(lists, (F.col("doc_id") == F.col("_id")) & (F.col("tkey") == F.col("_k")), "left").select("doc_id", "_text", "at", shares.alias("passage"))

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            at = batch.column(2)
            lo = np.asarray(at.offsets)
            s, e = np.asarray(at.values.field("start")), np.asarray(at.values.field("end"))
            buf = raw.tobytes()
            cols = [[] for _ in range(5)]
            for r in range(len(batch)):
                left = memoryview(buf)[offsets[r] : offsets[r + 1]]
                size, kept, last, gone, count = len(left), hashlib.sha256(), 0, 0, 0
                a, b = s[lo[r] : lo[r + 1]], e[lo[r] : lo[r + 1]]
                if len(a):
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    head = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
                    for x, y in zip(a[head].tolist(), b[np.concatenate((head[1:], [len(a)])) - 1].tolist(), strict=True):
                        kept.update(left[last:x])
                        gone, count, last = gone + y - x, count + 1, y
                kept.update(left[last:])
                for c, v in zip(cols, (size, gone, count, kept.hexdigest(), gone > 0), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], batch.column(3)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", "shares_passage"])

    return in_arrow(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean, shares_passage boolean")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats (whether the document holds a string of 400 bytes that also starts
    elsewhere), shares_passage (whether it holds over 50 consecutive words that another document holds too).

    Words are runs of other bytes than space and 0x09-0x0D, as they are; passages lose nothing by being shared, as many are shorter than 400 bytes.
    Null text has no bytes; texts under 400 bytes lose nothing; texts may be of any length. Rows that repeat a doc_id are
    documents of their own, so equal ones of 400 bytes lose all; a null doc_id loses nothing and counts for nothing;
    no string has a first occurrence that stays, so there are no ties; other columns, whatever their names, play no part; an
    empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    passages = shared_passages(docs)
    return remove_spans(docs, repeated_spans(docs), passages=passages)
