"""Operator 9: SentencePiece encoding over a lattice of piece occurrences, and decoding."""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import C1, U64, groups, hash_spans, in_arrow, mix, table, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
KNOWN = 1 << 20  # words whose ids a task remembers; beyond that it starts anew
WIDE = 256  # edges of a word beyond which its fold runs by itself


@dataclass
class Pieces:
    """The piece table: text of each normal piece (with spaces for word marks), ids, scores, the id of byte 0, and each id's bytes."""

    texts: list[str]
    ids: list[int]
    scores: list[float]
    byte0: int
    raw: list[bytes]

    def ranks(self) -> list[int]:
        """The order in which pieces are merged: by falling score. Pieces of spaces only share a score, the least, and so a rank."""
        order = {s: r for r, s in enumerate(sorted(set(self.scores), reverse=True))}
        return [order[s] for s in self.scores]

    def blanks(self) -> list[list[int]]:
        """Lengths of the pieces that 0, 1, ... spaces become; from the last entry on, each as many spaces as that has are one piece and
        the rest follow. All share a score, so the leftmost neighbours that make a piece are merged first."""
        lengths = {len(t) for t in self.texts if not t.strip(" ")} | {1}
        most = max(lengths)

        def joined(n):
            left, p = [1] * n, 0
            while p + 1 < len(left):
                if left[p] + left[p + 1] in lengths:
                    left[p : p + 2] = [left[p] + left[p + 1]]
                    p = max(p - 1, 0)
                else:
                    p += 1
            return left

        out = [joined(n) for n in range(most + 1)]
        if any(joined(n) != [most] * (n // most) + out[n % most] for n in range(4 * most)):
            raise ValueError("runs of spaces don't fall into pieces of the greatest length and a rest")
        return out


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, ids, scores, raw = [], [], [], []
    byte0 = sp.piece_to_id("<0x00>")
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            raw.append(bytes([i - byte0]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            t = sp.id_to_piece(i).replace("▁", " ")
            raw.append(t.encode())
            texts.append(t)
            ids.append(i)
            scores.append(float(sp.get_score(i)))
    if any(" " in t.lstrip(" ") or "\n" in t or (t[:2] == "  " and t.strip(" ")) for t in texts):
        raise ValueError("units_of cuts texts before runs of spaces and at newlines, and a piece of this model reaches across")
    if {x for t, x in zip(texts, scores, strict=True) if not t.strip(" ")} - {min(scores)}:
        raise ValueError("a piece of spaces has a score of its own, and blanks() takes them to share the least")
    return Pieces(texts, ids, scores, byte0, raw)


def units_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each unit: a run of spaces opens one, a newline is one. No piece reaches across, so no merge does."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    cut = (raw == 32) | (raw == 10)
    cut[1:] &= (raw[:-1] != 32) | (raw[1:] != 32)
    cut[1:] |= raw[:-1] == 10
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.concatenate((starts[1:], [len(raw)]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def marked(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty, as the model expects."""
    lens = np.diff(offsets)
    grown = np.where(lens > 0, lens + 1, 0)
    new = np.concatenate(([0], np.cumsum(grown)))
    out = np.full(int(new[-1]), 32, np.uint8)
    put = np.ones(len(out), bool)
    put[new[:-1][lens > 0]] = False
    out[put] = raw
    return out, new


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) from distinct units: every substring of bounded length is looked up in the piece table, the hits are the edges of
    the word's lattice, and a fold over the edges, by rank and then from left to right, merges what lies side by side.

    The state is the list of boundaries that are left. An edge whose ends are boundaries with one more between them takes that
    one away: two neighbours have become its piece. In a byte-pair model a piece's parts rank before it, so one pass in the
    order of ranks makes the model's own merges. The piece table is broadcast: its size is the model's. A character that
    is no piece becomes its UTF-8 bytes.
    """
    spark = words.sparkSession
    longest = max(map(len, pieces.texts))
    blanks = {len(t): i for t, i in zip(pieces.texts, pieces.ids, strict=True) if not t.strip(" ")}
    blank_rank = max(pieces.ranks()) if len(blanks) > 1 else 1 << 30
    table_ = spark.createDataFrame(list(zip(pieces.texts, pieces.ids, pieces.ranks(), strict=True)), "sub string, id int, rank int")
    size = F.char_length("word")
    subs = words.select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    subs = subs.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("start")))).alias("len"))
    subs = subs.withColumn("sub", F.substring("word", F.col("start") + 1, F.col("len")))
    code = F.hex(F.encode("sub", "UTF-8"))
    as_bytes = F.transform(F.sequence(F.lit(0), F.octet_length("sub") - 1), lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + pieces.byte0)
    edges = subs.join(F.broadcast(table_), "sub", "left").filter("id is not null or len = 1").select(
        "word", F.struct(F.coalesce("rank", F.lit(-1)).alias("rank"), "start", (F.col("start") + F.col("len")).alias("end"), F.when(F.col("id").isNotNull(), F.array("id")).otherwise(as_bytes).alias("ids")).alias("e"))
    held = edges.groupBy("word").agg(F.sort_array(F.collect_list("e")).alias("edges"))

    def step(left, e):
        at = F.array_position(left, e["start"]).cast("int")
        inner = F.get(left, at)
        return F.when((at > 0) & (F.get(left, at + 1) == e["end"]), F.array_remove(left, inner)).otherwise(left)

    longer = F.filter("edges", lambda e: (e["end"] - e["start"] > 1) & (e["rank"] < blank_rank))
    left = held.select("word", "edges", F.aggregate(longer, F.sequence(F.lit(0), size), step).alias("left"))
    run = size - F.char_length(F.ltrim("word"))
    free = F.when(run > 1, run - F.when(F.array_contains("left", run) | (run == size), 0).otherwise(1)).otherwise(0)
    spans = F.transform(F.sequence(F.lit(1), F.size("left") - 1), lambda i: F.when(F.get("left", i - 1) >= free, F.filter("edges", lambda e: (e["start"] == F.get("left", i - 1)) & (e["end"] == F.get("left", i)))[0]["ids"]).otherwise(F.array().cast("array<int>")))
    cuts = pieces.blanks()
    most = len(cuts) - 1
    rests = F.array(*[F.array(*[F.lit(blanks[n]) for n in cut]).cast("array<int>") for cut in cuts])
    lead = F.concat(F.array_repeat(F.lit(blanks[most]), F.floor(free / most).cast("int")), F.get(rests, free % most)) if most > 1 else F.array().cast("array<int>")
    return left.select("word", F.concat(lead, F.flatten(spans)).alias("ids"))


# ---- The same lattice over arrays, for the words of a task ---------------------------------------------------------


def packed(pieces: Pieces) -> tuple:
    """The piece table as plain arrays: hashes of all prefixes of pieces with a directory by leading bits, and of each the piece's rank
    and id (-1: a prefix only); how runs of spaces are cut, and the ids of spaces; the bytes of each id."""
    ranks, found, blanks = pieces.ranks(), {}, {}
    for t, i, r in zip(pieces.texts, pieces.ids, ranks, strict=True):
        if not t.strip(" "):
            blanks[len(t)] = i
        h = None
        for k, c in enumerate(t):
            h = chained(None if h is None else h, np.array([ord(c)], np.uint32))
            old = found.get(int(h[0]), (-1, -1))
            whole = k + 1 == len(t) and (t.strip(" ") or len(t) == 1)
            found[int(h[0])] = (r, i) if whole else old
    keys = np.array(sorted(found), U64)
    values = np.array([found[int(k)] for k in keys], np.int32)
    bits = 18
    first = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << U64(64 - bits))
    raw = np.frombuffer(b"".join(pieces.raw), np.uint8)
    return (keys, values[:, 0].copy(), values[:, 1].copy(), np.concatenate((first, [len(keys)])), bits,
            (pieces.blanks(), blanks), pieces.byte0, raw, np.concatenate(([0], np.cumsum([len(r) for r in pieces.raw]))))


def chained(h: np.ndarray | None, code: np.ndarray) -> np.ndarray:
    """The hash of a prefix grown by one character."""
    with np.errstate(over="ignore"):
        return mix((code.astype(U64) + U64(1)) * C1 if h is None else h * C1 ^ (code.astype(U64) + U64(1)))


class Lattice:
    """Encodes words within a task: explodes their substrings as far as they are prefixes of pieces, joins them with the piece table,
    groups the edges by word and folds them, all words at once."""

    def __init__(self, table_: tuple):
        self.keys, self.rank, self.id, self.first, self.bits, self.blanks, self.byte0, self.raw, self.offsets = table_
        self.most = int(np.diff(self.first).max())
        self.known, self.at, self.n, self.pool = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes in the table, -1 where they aren't in it."""
        b = (h >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.first[b], self.first[b + 1]
        out = np.full(len(h), -1, np.int32)
        live = np.flatnonzero(at < end)
        for _ in range(self.most):
            hit = self.keys[at[live]] == h[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
            if not len(live):
                break
        return out

    def edges(self, code: np.ndarray, last: np.ndarray):
        """(start, length, rank, id) of each piece of two characters or more; and the ids of single characters, -1 where none."""
        h = chained(None, code)
        spot = self.find(h)
        single = np.where(spot >= 0, self.id[spot], -1)
        live, out, k = np.flatnonzero((spot >= 0) & (last > np.arange(len(code)) + 1)), [], 1
        h = h[live]
        while len(live):
            h = chained(h, code[live + k])
            spot = self.find(h)
            keep = spot >= 0
            live, h, spot, k = live[keep], h[keep], spot[keep], k + 1
            whole = self.id[spot] >= 0
            out.append((live[whole], np.full(int(whole.sum()), k), self.rank[spot[whole]], self.id[spot[whole]]))
            more = last[live] > live + k
            live, h = live[more], h[more]
        if not out:
            return (np.zeros(0, np.int64),) * 4, single
        return tuple(np.concatenate([o[c] for o in out]).astype(np.int64) for c in range(4)), single

    def encode(self, buf: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units buf[bounds[i]:bounds[i+1]] in order, and the number of each unit's ids."""
        raw = np.frombuffer(buf, np.uint8)
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        text = buf.decode("utf-8", "surrogateescape")
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(code) == lead[-1]:
            head = lead[bounds]
            place = np.flatnonzero((raw & 0xC0) != 0x80)
        else:  # broken UTF-8: each stray byte is a character of its own
            sizes = [len(c.encode("utf-8", "surrogateescape")) for c in text]
            place = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
            head = np.searchsorted(place, bounds)
        n = len(code)
        word = np.repeat(np.arange(len(bounds) - 1), np.diff(head))
        (start, size, rank, ids), tok = self.edges(code, head[1:][word])
        order = np.argsort(word[start] << 20 | rank, kind="stable")
        start, end, ids = start[order], (start + size)[order], ids[order]
        alive, nxt = np.ones(n, bool), np.arange(1, n + 1)
        count = np.bincount(word[start], minlength=len(head) - 1)
        base = np.cumsum(count) - count
        live = np.flatnonzero((count > 0) & (count <= WIDE))
        for k in range(WIDE):
            live = live[count[live] > k]
            if not len(live):
                break
            e = base[live] + k
            s, t = start[e], end[e]
            mid = nxt[s]
            ok = alive[s] & (mid < t)
            ok &= nxt[np.minimum(mid, n - 1)] == t
            alive[mid[ok]] = False
            nxt[s[ok]] = t[ok]
            tok[s[ok]] = ids[e[ok]]
        for w in np.flatnonzero(count > WIDE).tolist():
            a, b = head[w], head[w + 1]
            there, to = [True] * int(b - a), list(range(1, int(b - a) + 1))
            part = slice(base[w], base[w] + count[w])
            for s, t, i in zip((start[part] - a).tolist(), (end[part] - a).tolist(), ids[part].tolist(), strict=True):
                mid = to[s]
                if there[s] and mid < t and to[mid] == t:
                    there[mid] = False
                    to[s] = t
                    tok[s + a] = i
            alive[a:b] = there
            nxt[a:b] = np.array(to) + a
        self.join_blanks(code, head, alive, nxt, tok)
        s = np.flatnonzero(alive)
        tok = tok[s]
        width = np.ones(len(s), np.int64)
        odd = tok < 0
        edge = np.concatenate((place, [len(raw)]))
        width[odd] = np.diff(edge)[s[odd]]
        out = np.repeat(tok, width).astype(np.int32)
        if odd.any():
            w = width[odd]
            spots = np.repeat((np.cumsum(width) - width)[odd], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            out[spots] = self.byte0 + raw[np.repeat(place[s[odd]], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)].astype(np.int32)
        return out, np.bincount(word[s], weights=width, minlength=len(bounds) - 1).astype(np.int64)

    def join_blanks(self, code, head, alive, nxt, tok) -> None:
        """Spaces that no letter took, at the head of a unit, become pieces of spaces."""
        first = head[:-1]
        ok = np.diff(head) > 1
        many = np.flatnonzero(ok)[(code[first[ok]] == 32) & (code[first[ok] + 1] == 32)]
        cuts, ids = self.blanks
        most = len(cuts) - 1
        if not len(many) or most < 2:
            return
        solid = np.concatenate(([0], np.cumsum(code != 32)))
        for w in many.tolist():
            a, b = int(head[w]), int(head[w + 1])
            c = int(np.searchsorted(solid[a + 1 : b + 1], solid[a] + 1)) if solid[b] > solid[a] else b - a
            free = c - (1 if nxt[a + c - 1] > a + c else 0)
            alive[a : a + free] = False
            for size in [most] * (free // most) + cuts[free % most]:
                alive[a], nxt[a], tok[a] = True, a + size, ids[size]
                a += size

    def all(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and the number of each one's ids. Each distinct unit is encoded once, and remembered."""
        keys, at, which = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[spot] != keys) if len(self.known) else np.arange(len(keys))
        if len(new):
            if len(self.known) > KNOWN:
                self.__init__((self.keys, self.rank, self.id, self.first, self.bits, self.blanks, self.byte0, self.raw, self.offsets))
                new = np.arange(len(keys))
            s, lens = starts[at[new]], (ends - starts)[at[new]]
            bounds = np.concatenate(([0], np.cumsum(lens)))
            ids, n = self.encode(raw[np.arange(bounds[-1]) - np.repeat(bounds[:-1], lens) + np.repeat(s, lens)].tobytes(), bounds)
            where = np.searchsorted(self.known, keys[new])
            self.at = np.insert(self.at, where, len(self.pool) + np.cumsum(n) - n)
            self.n = np.insert(self.n, where, n)
            self.known = np.insert(self.known, where, keys[new])
            self.pool = np.concatenate((self.pool, ids))
            spot = np.searchsorted(self.known, keys)
        n, b = self.n[spot][which], self.at[spot][which]
        return self.pool[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b, n)], n


def decoded(ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes that ids stand for, by the piece table's bytes and offsets."""
    n = np.diff(offsets)[ids]
    return raw[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1][ids], n)]


def encode_documents(docs: DataFrame, model: str = MODEL, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, ids, decoded_sha256, round_trip (decoding the ids gives the text's bytes).

    A text is cut into units where no piece reaches across (a run of spaces opens one, a newline is one). Each distinct unit of
    a slice of text goes through the lattice; the ids are those of the model's own encoder, except that U+2581 is kept apart
    from the space. Nothing is shuffled, and the piece table alone is broadcast: its size is the model's. Null and empty texts have no ids; any
    character round-trips, as bytes where the model lacks it; texts and words may be of any length. Rows that
    repeat a doc_id each return; a null doc_id comes back null; other columns, whatever their names, play no part; an empty table
    gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(packed(load(model)))

    def run(batches):
        coder = Lattice(held.value)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in groups(offsets):
                own, bounds = marked(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                starts, ends, rows = units_of(own, bounds)
                out, n = coder.all(own, starts, ends)
                per = np.bincount(rows, weights=n, minlength=j - i).astype(np.int64)
                at = np.concatenate(([0], np.cumsum(per)))
                back = decoded(out, coder.raw, coder.offsets)
                ends_at = np.concatenate(([0], np.cumsum(np.diff(coder.offsets)[out])))[at]
                lens, same, digest = np.diff(offsets[i : j + 1]), [], []
                for r in range(j - i):
                    text_ = back[ends_at[r] : ends_at[r + 1]][1:].tobytes()
                    same.append(text_ == raw[offsets[i + r] : offsets[i + r + 1]].tobytes())
                    digest.append(hashlib.sha256(text_).hexdigest())
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lens), pa.array(per), lists, pa.array(digest), pa.array(same)], ["doc_id", "n_bytes", "n_tokens", "ids", "decoded_sha256", "round_trip"])

    return in_arrow(docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text)), run, "doc_id long, n_bytes long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the texts that the ids stand for; no ids give an empty text."""
    pieces = load(model)
    held = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(pieces.raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in pieces.raw])))))

    def run(batches):
        raw, offsets = held.value
        for batch in batches:
            texts = [decoded(np.array(ids or [], np.int64), raw, offsets)[1:].tobytes().decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_documents with the ids as a digest: doc_id, n_bytes, n_tokens, ids_sha256 (of the ids, joined by commas), decoded_sha256, round_trip."""
    out = encode_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "decoded_sha256", "round_trip")
