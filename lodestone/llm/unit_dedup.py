"""Operator 8: substring dedup by hashing lines and the sentences in them."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, groups, in_arrow, lookup, materialize, table, utf8
from .line_dedup import LOWER as FOLDED
from .line_dedup import keyed, lines_of

SENTENCE_WORDS = 6  # sentences of fewer words are no units
PASSAGE_WORDS = 30  # words in repeated units from which a document counts as one that shares passages
SENTENCE = r"[^.!?]*[.!?]+[ \t]*|[^.!?]+"


def sentences_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and line of each sentence: up to a run of . ! ? and the blanks after it, or to the line's end."""
    stop = (raw == 46) | (raw == 33) | (raw == 63)
    last = np.flatnonzero(stop & ~np.concatenate((stop[1:], [False]))) + 1
    solid = np.flatnonzero((raw != 32) & (raw != 9))
    spot = np.searchsorted(solid, last)
    nxt = np.concatenate((solid, [len(raw)]))[spot]
    line = np.searchsorted(starts, last - 1, "right") - 1
    nxt = np.minimum(nxt, ends[line])
    inner = nxt < ends[line]
    line, nxt = line[inner], nxt[inner]
    begin = np.concatenate((starts, nxt))
    owner = np.concatenate((np.arange(len(starts)), line))
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.concatenate((begin[1:], [0]))
    tail = np.concatenate((owner[1:] != owner[:-1], [True])) if len(owner) else np.zeros(0, bool)
    end[tail] = ends[owner[tail]]
    return begin, end, owner


def unit_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, start, end, whole, d1, d2, words) from keyed rows: lines with a word (whole), and of lines of several sentences those of
    SENTENCE_WORDS words or more; start and end in the text's bytes, d1 and d2 128 bits of the normalised unit."""

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            ids, tkeys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in groups(offsets):
                low = FOLDED[raw[offsets[i] : offsets[j]]]
                bounds = offsets[i : j + 1] - offsets[i]
                starts, ends, owner, _ = lines_of(low, bounds)
                begin, end, line = sentences_of(low, starts, ends)
                several = np.bincount(line, minlength=len(starts)) > 1
                part = several[line]
                begin, end, line = np.concatenate((starts, begin[part])), np.concatenate((ends, end[part])), np.concatenate((np.arange(len(starts)), line[part]))
                whole = np.arange(len(begin)) < len(starts)
                word = low != 32
                head = np.concatenate(([0], np.cumsum(word & (low != 10) & np.concatenate(([True], (low[:-1] == 32) | (low[:-1] == 10))))))
                words = head[end] - head[begin] + ((begin < len(low)) & (end > begin) & word[np.minimum(begin, len(low) - 1)] & (head[np.minimum(begin + 1, len(low))] == head[begin]) if len(low) else 0)
                keep = np.flatnonzero(np.where(whole, words >= 1, words >= SENTENCE_WORDS))
                begin, end, whole, words, row = begin[keep], end[keep], whole[keep], words[keep], owner[line[keep]]
                buf = low.tobytes()
                digest = np.frombuffer(b"".join([hashlib.blake2b(b" ".join(buf[a:b].split()), digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][row]), pa.array(tkeys[i:j][row]), pa.array(begin - bounds[row]), pa.array(end - bounds[row]), pa.array(whole), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(words.astype(np.int32))],
                    ["doc_id", "tkey", "start", "end", "whole", "d1", "d2", "words"])

    return in_arrow(docs, run, "doc_id long, tkey long, start long, end long, whole boolean, d1 long, d2 long, words int")


def marked(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, tkey, at, shared): of each document that holds repeated units the spans (start, end, whole) of those to remove, and the number
    of words in its repeated units of SENTENCE_WORDS or more, be they kept or removed; tkey is xxhash64 of the text.

    Units are lines, and sentences within lines; they are equal if they are in lower case (A-Z) and with white space collapsed.
    Of equal units the earliest by (doc_id, start) stays. A repeated line goes whole; of other lines the repeated sentences
    of SENTENCE_WORDS words or more go. A line without a word stays.
    """
    units = materialize(unit_rows(keyed(docs.filter(F.col(ident).isNotNull()), text, ident)), "op8-units", "lz4")
    key = F.struct("d1", "d2").alias("digest")
    cls = materialize(units.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, "n"), "op8-classes")
    place = F.struct("doc_id", "start", F.col("whole").cast("int").alias("part"), "tkey")
    again = materialize(lookup(units.withColumn("digest", F.struct("d1", "d2")), cls, "digest", "n").select("doc_id", "tkey", "start", "end", "whole", "words", "digest"), "op8-again")
    first = materialize(again.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "op8-first")
    found = lookup(again, first, "digest", "n").withColumn("gone", place != F.col("first"))
    size = F.when(F.col("words") >= SENTENCE_WORDS, F.col("words")).otherwise(0)
    spans = F.array_sort(F.collect_set(F.when(F.col("gone"), F.struct("start", "end", "whole"))))
    sizes = F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("rev"), size.cast("int").alias("words"))))
    lists = found.groupBy("doc_id", "tkey").agg(spans.alias("at"), sizes.alias("sizes"))
    # In order of their starts, a line before its sentences: what lies within a unit that was counted counts no more.
    none = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).alias("total"))
    step = lambda a, x: F.when(x["start"] >= a["end"], F.struct((-x["rev"]).alias("end"), (a["total"] + x["words"]).alias("total"))).otherwise(a)
    return materialize(lists.select("doc_id", "tkey", "at", F.aggregate("sizes", none, step)["total"].alias("shared")), "op8-lists")


def cut(docs: DataFrame, lists: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs, their columns named c0, c1, ..., less the units in lists, with _units (lines), _lines (removed), _sentences (removed), _bytes
    (removed), _spans (start, end of each removed unit in the original's bytes) and _shared (see marked)."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at, own = docs.columns.index(text), docs.columns.index(ident)
    plain = docs.toDF(*names)
    key = plain.withColumn("_tkey", F.xxhash64(F.coalesce(F.col(names[at]), F.lit(""))))
    both = key.join(lists.toDF("_id", "_k", "_at", "_words"), (F.col(names[own]).cast("long") == F.col("_id")) & (F.col("_tkey") == F.col("_k")), "left").select(*names, "_at", F.coalesce("_words", F.lit(0)).alias("_shared"))
    fields = [T.StructField(f.name, T.StringType() if k == at else f.dataType) for k, f in enumerate(plain.schema.fields)]
    more = [("_units", pa.int64(), T.LongType()), ("_lines", pa.int64(), T.LongType()), ("_sentences", pa.int64(), T.LongType()), ("_bytes", pa.int64(), T.LongType()),
            ("_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]

    def less(raw: bytes, spans: list[dict]):
        """The text without the spans; a whole line goes with its newline."""
        left, used, gone, head = [], [], [0, 0, 0], True
        lines, k, start = raw.split(b"\n"), 0, 0
        for line in lines:
            end, part, at = start + len(line), [], start
            drop = False
            while k < len(spans) and spans[k]["start"] <= end and (spans[k]["end"] <= end):
                s = spans[k]
                k += 1
                if s["whole"]:
                    drop = True
                elif not drop:
                    part.append((s["start"], s["end"]))
            if drop:
                used.append({"start": start, "end": end})
                gone[0] += 1
                gone[2] += end - start
            else:
                for a, b in part:
                    left.append((b"" if head or at > start else b"\n") + raw[at:a])
                    head, at = False, b
                    used.append({"start": a, "end": b})
                    gone[1] += 1
                    gone[2] += b - a
                left.append((b"" if head or at > start else b"\n") + raw[at:end])
                head = False
            start = end + 1
        return b"".join(left), used, gone, len(lines)

    def run(batches):
        for batch in batches:
            texts, cols = [], [[] for _ in more]
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if spans:
                    raw, used, gone, n = less(t.encode(), sorted(spans, key=lambda s: (s["start"], not s["whole"], s["end"])))
                    t = raw.decode()
                else:
                    used, gone, n = [], (0, 0, 0), (t or "").count("\n") + 1
                texts.append(t)
                for c, v in zip(cols, (n, *gone, used), strict=True):
                    c.append(v)
            own_ = [batch.column(k) for k in range(len(names))]
            own_[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*own_, *[pa.array(c, kind) for c, (_, kind, _) in zip(cols, more, strict=True)], batch.column(len(names) + 1)], [*names, *[m[0] for m in more], "_shared"])

    return in_arrow(both, run, T.StructType([*fields, *[T.StructField(n, t) for n, _, t in more], T.StructField("_shared", T.IntegerType())]))


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_units (lines), n_removed (of them), n_cut (sentences removed from other lines), removed_bytes, spans ('start-end' of the
    original's bytes, in order), kept_sha256, repeats (units of SENTENCE_WORDS words or more that occur elsewhere too hold
    PASSAGE_WORDS words or more of the document, be they kept here or removed).

    Of equal units the occurrence that is earliest by (doc_id, byte) stays. Null text counts as one empty unit; a null doc_id loses
    nothing and counts for nothing; rows that repeat a doc_id with another text are documents of their own, those that
    repeat the text too count as one; texts and lines may be of any length; other columns, whatever their names, play no part; an
    empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = cut(docs, marked(docs))
    return out.select(
        F.col("c0").alias("doc_id"), F.col("_units").alias("n_units"), F.col("_lines").alias("n_removed"), F.col("_sentences").alias("n_cut"), F.col("_bytes").alias("removed_bytes"),
        F.array_join(F.transform("_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.sha2(F.coalesce("c1", F.lit("")), 256).alias("kept_sha256"), (F.col("_shared") >= PASSAGE_WORDS).alias("repeats"),
    )


OP8_SQL = f"""
WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
     l AS (SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS part FROM p),
     o AS (SELECT *, coalesce(sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
                  regexp_extract_all(part, '{SENTENCE}') AS sents FROM l),
     t AS (SELECT doc_id, line, start, generate_subscripts(sents, 1) AS k, unnest(sents) AS part FROM o WHERE len(sents) > 1),
     u AS (SELECT doc_id, line, 0 AS k, part, start FROM o
           UNION ALL
           SELECT doc_id, line, k, part, start + coalesce(sum(strlen(part)) OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT FROM t),
     n AS (SELECT *, trim(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[ \\t-\\r]+', ' ', 'g'), ' ') AS norm FROM u),
     w AS (SELECT *, len(string_split(norm, ' ')) AS words FROM n WHERE norm <> '' AND (k = 0 OR len(string_split(norm, ' ')) >= {SENTENCE_WORDS})),
     r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, start, k > 0 DESC) > 1 AS again, count(*) OVER (PARTITION BY norm) > 1 AS shared FROM w),
     g AS (SELECT doc_id, line, k, start, strlen(part) AS size, words, again, shared, max(CASE WHEN k = 0 AND again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line) AS whole,
                  max(CASE WHEN k = 0 AND shared THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line) AS wide FROM r),
     x AS (SELECT doc_id, line, k, start, size, whole FROM g WHERE again AND (k = 0 OR whole = 0)),
     d AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_removed, count(*) FILTER (k > 0) AS n_cut, sum(size)::BIGINT AS removed_bytes,
                  string_agg(start::VARCHAR || '-' || (start + size)::VARCHAR, ',' ORDER BY start) AS spans FROM x GROUP BY doc_id),
     s AS (SELECT doc_id, sum(words) AS words FROM g WHERE shared AND words >= {SENTENCE_WORDS} AND (k = 0 OR wide = 0) GROUP BY doc_id),
     c AS (SELECT o.doc_id, o.line, string_agg(CASE WHEN xs.k IS NULL THEN coalesce(t.part, o.part) ELSE '' END, '' ORDER BY coalesce(t.k, 0)) AS part
           FROM o LEFT JOIN t ON t.doc_id = o.doc_id AND t.line = o.line LEFT JOIN x xs ON xs.doc_id = t.doc_id AND xs.line = t.line AND xs.k = t.k
           WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = o.doc_id AND x.line = o.line AND x.k = 0) GROUP BY o.doc_id, o.line),
     j AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY line) AS kept FROM c GROUP BY doc_id)
SELECT p.doc_id, len(parts) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(n_cut, 0) AS n_cut, coalesce(removed_bytes, 0)::BIGINT AS removed_bytes, coalesce(spans, '') AS spans,
       sha256(coalesce(kept, '')) AS kept_sha256, coalesce(s.words, 0) >= {PASSAGE_WORDS} AS repeats
FROM p LEFT JOIN d ON d.doc_id = p.doc_id LEFT JOIN s ON s.doc_id = p.doc_id LEFT JOIN j ON j.doc_id = p.doc_id
"""
