"""Operator 10: toxicity by a chain of linear classifiers over hashed text features."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import C2, U64, groups, hash_spans, in_arrow, lower_bytes, materialize, mix, spans_of_words, table, utf8

BITS = 16
SAMPLE = 12_000
FOLDS = 3
THRESHOLD = 0.6
PREFIX = 5
SIGMAS = (4.0, 3.0, 2.0)  # screens to choose from, in standard errors; the last one also limits what comes to the driver
#: The chain, in order: each link's labels come from the labels table. The last one decides.
CHAIN = ("low_quality", "toxic")


def chain_labels(labels: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(doc_id, low_quality, toxic) of rows with both labels; of rows that repeat a doc_id one, the most toxic."""
    l = labels.filter(F.col(ident).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return l.groupBy(F.col(ident).alias("doc_id")).agg((1 - F.min("quality")).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic"))


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) for each word of 3 bytes or more: its hash and that of its first bytes, punctuation at its ends cut off."""
    low = lower_bytes(raw)
    starts, ends, rows = spans_of_words(low, offsets)
    if not len(starts):
        return rows, np.zeros(0, np.int64)
    punct = np.zeros(256, bool)
    punct[33:48] = punct[58:65] = punct[91:97] = punct[123:127] = True
    for _ in range(2):
        ends = ends - (punct[low[ends - 1]] & (ends - starts > 1))
        starts = starts + (punct[low[starts]] & (ends - starts > 1))
    ok = ends - starts >= 3
    starts, ends, rows = starts[ok], ends[ok], rows[ok]
    word = hash_spans(low, starts, ends)
    long = ends - starts > PREFIX
    with np.errstate(over="ignore"):
        head = mix(hash_spans(low, starts[long], starts[long] + PREFIX) ^ C2)
    size = U64((1 << BITS) - 1)
    feats = np.concatenate(((word & size).astype(np.int64), (head & size).astype(np.int64) + (1 << BITS)))
    return np.concatenate((rows, rows[long])), feats


class Chain:
    """Weights of the links; link i also takes the probabilities of the links before it."""

    def __init__(self, weights: np.ndarray, extra: list[np.ndarray], bias: np.ndarray):
        self.weights, self.extra, self.bias = weights, extra, bias

    def predict(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, a column for each link. Only a feature's presence counts."""
        out = np.zeros((n, len(self.bias)))
        used = (self.weights != 0).any(axis=0)[feats]
        rows, feats = present(rows[used], feats[used])
        for i in range(len(self.bias)):
            z = np.bincount(rows, weights=self.weights[i][feats], minlength=n) + self.bias[i] + out[:, :i] @ self.extra[i]
            out[:, i] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def present(rows: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(rows.astype(np.int64) << (BITS + 2) | feats)
    return key >> (BITS + 2), key & ((1 << (BITS + 2)) - 1)


def screened(rows, feats, y, sigma: float) -> np.ndarray:
    """Whether each feature's log odds differ from the class balance by sigma standard errors."""
    size, pos = 2 << BITS, max(int(y.sum()), 1)
    neg = max(len(y) - pos, 1)
    hot = y[rows] == 1
    a = np.bincount(feats[hot], minlength=size) + 0.5
    b = np.bincount(feats[~hot], minlength=size) + 0.5
    return np.abs(np.log(a / (pos + 1)) - np.log(b / (neg + 1))) / np.sqrt(1 / a + 1 / b) > sigma


def fit_link(rows, feats, dense, y, sigma: float, steps: int = 200, rate: float = 0.05, l2: float = 1e-4):
    """Logistic regression on the screened features and the dense columns, by full-batch Adam, the classes balanced."""
    size, (n, k) = 2 << BITS, dense.shape
    keep = screened(rows, feats, y, sigma)
    names = np.flatnonzero(keep)
    at = keep[feats]
    rows, feats = rows[at], np.searchsorted(names, feats[at])
    m0 = len(names)
    w = np.zeros(m0 + k + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    pos = max(y.sum(), 1)
    weight = np.where(y == 1, 0.5 / pos, 0.5 / max(n - pos, 1))
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[feats], minlength=n) + dense @ w[m0 : m0 + k] + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.concatenate((np.bincount(feats, weights=e[rows], minlength=m0), dense.T @ e, [e.sum()])) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    full = np.zeros(size)
    full[names] = w[:m0]
    return full, w[m0 : m0 + k], w[-1]


def out_of_fold(rows, feats, dense, y, sigma: float, folds: int) -> np.ndarray:
    """Each row's probability by a model that hasn't seen it."""
    n = len(y)
    fold, out = np.arange(n) % folds, np.zeros(n)
    for f in range(folds):
        train = fold != f
        at, new = train[rows], np.cumsum(train) - 1
        w, x, b = fit_link(new[rows[at]], feats[at], dense[train], y[train], sigma)
        z = np.bincount(rows, weights=w[feats], minlength=n) + dense @ x + b
        out[~train] = 1 / (1 + np.exp(-np.clip(z[~train], -40, 40)))
    return out


def fit(rows: np.ndarray, feats: np.ndarray, labels: np.ndarray, folds: int = FOLDS, sigmas: tuple[float, ...] = SIGMAS) -> Chain:
    """Fit the chain. Later links train on earlier links' out-of-fold probabilities, which have not seen the row, as at prediction.
    Of the screens the one is taken with which the last link's out-of-fold loss, the classes balanced, is least: few labels
    need a loose one."""
    n, links = labels.shape
    rows, feats = present(rows, feats)
    best = None
    for sigma in sigmas:
        earlier = np.zeros((n, 0))
        for i in range(links):
            p = out_of_fold(rows, feats, earlier, labels[:, i], sigma, folds)
            earlier = np.column_stack((earlier, p))
        y = labels[:, -1]
        loss = -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1))
        loss = loss[y == 1].mean() + loss[y == 0].mean()
        if best is None or loss < best[0]:
            best = loss, sigma, earlier
    _, sigma, earlier = best
    links_ = [fit_link(rows, feats, earlier[:, :i], labels[:, i], sigma) for i in range(links)]
    return Chain(np.array([w for w, _, _ in links_]), [x for _, x, _ in links_], np.array([b for _, _, b in links_]))


def sample_features(docs: DataFrame, chosen: DataFrame, text: str, ident: str) -> DataFrame:
    """(doc_id, feats, labels of the chain) of the chosen documents, written out: as many rows as the sample has at most. Of rows
    that repeat a doc_id each is one."""
    names = list(CHAIN)

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in groups(offsets):
                rows, feats = present(*words_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                bounds = np.searchsorted(rows, np.arange(j - i + 1))
                cols = [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(feats.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*cols, *[batch.column(2 + k).slice(i, j - i) for k in range(len(names))]], ["doc_id", "feats", *names])

    picked = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "_text", *names)
    return materialize(in_arrow(picked, run, "doc_id long, feats array<int>, " + ", ".join(f"{c} int" for c in names)), "op10-sample")


def telling(sample: DataFrame, sigma: float) -> np.ndarray:
    """The features whose odds in any label of the chain differ from the class balance by sigma standard errors. Spark counts them;
    2 << BITS numbers come to the driver at most."""
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in CHAIN]).first()
    per = sample.select(F.explode("feats").alias("feat"), *CHAIN).groupBy("feat").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in CHAIN])
    tests = []
    for c in CHAIN:
        pos = max(int(total[c] or 0), 1)
        neg = max(total.n - pos, 1)
        a, b = F.col(c) + 0.5, F.col("n") - F.col(c) + 0.5
        tests.append(F.abs(F.ln(a / (pos + 1)) - F.ln(b / (neg + 1))) / F.sqrt(1 / a + 1 / b) > sigma)
    test = tests[0]
    for t in tests[1:]:
        test = test | t
    return np.sort(np.asarray(per.filter(test).select("feat").toArrow()["feat"].to_numpy()))


def gathered(sample: DataFrame, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, features and labels of the sample, its features limited to `kept`; rows in the order of doc_id and features."""
    held, names = sample.sparkSession.sparkContext.broadcast(kept), list(CHAIN)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            off = np.asarray(lists.offsets).astype(np.int64)
            flat = lists.values.to_numpy()[off[0] : off[-1]]
            own = np.repeat(np.arange(len(batch)), np.diff(off))
            spot = np.minimum(np.searchsorted(held.value, flat), max(len(held.value) - 1, 0))
            ok = held.value[spot] == flat if len(held.value) else np.zeros(len(flat), bool)
            bounds = np.searchsorted(own[ok], np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[ok])), *[batch.column(2 + k) for k in range(len(names))]], ["doc_id", "feats", *names])

    got = in_arrow(sample, run, "doc_id long, feats array<int>, " + ", ".join(f"{c} int" for c in names)).orderBy("doc_id", "feats").toArrow().combine_chunks()
    lists = got["feats"].combine_chunks()
    lens = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lens), dtype=np.int32), lens), lists.flatten().to_numpy(), np.column_stack([got[c].to_numpy() for c in names])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", ident: str = "doc_id") -> Chain | None:
    """Fit the chain on at most `sample` labelled documents, half of them toxic where there are enough, chosen by a hash of
    doc_id. None where no label or no toxic label is at hand: then nothing counts as toxic."""
    l = chain_labels(labels)
    half = sample // 2
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = l.filter("toxic = 1").orderBy(order, "doc_id").limit(half).unionByName(l.filter("toxic = 0").orderBy(order, "doc_id").limit(half))
    picked = sample_features(docs, chosen, text, ident)
    rows, feats, y = gathered(picked, telling(picked, min(SIGMAS)))
    return fit(rows, feats, y) if len(y) and 0 < y[:, -1].sum() < len(y) else None


def score(docs: DataFrame, chain: Chain | None, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs with p_<link> for each link of the chain. Whole texts are read, batch by batch."""
    columns = columns or docs.columns
    names = [f"p_{c}" for c in CHAIN]
    if chain is None:
        return docs.select(*columns, *[F.lit(0.0).alias(c) for c in names])
    held = docs.sparkSession.sparkContext.broadcast((chain.weights.astype(np.float32), chain.extra, chain.bias))
    at = columns.index(text)
    kept = docs.select(*columns)

    def run(batches):
        w, extra, bias = held.value
        model = Chain(w, extra, bias)
        for batch in batches:
            raw, offsets = utf8(batch.column(at))
            for i, j in groups(offsets):
                rows, feats = words_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p = model.predict(rows, feats, j - i)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(p[:, k]) for k in range(p.shape[1])]], [*columns, *names])

    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])
    return in_arrow(kept, run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic. Null and empty texts have no features and get the chain's base rates; whole texts
    are read, however long; rows that repeat a doc_id each get their own, equal texts equal ones; other columns and their names
    play no part; an empty table gives an empty result, and a labels table without both classes calls nothing toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, chain)
    return out.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") > THRESHOLD).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain does not call toxic, with their own columns, whatever those are named. A document without
    text stays, and so does each row that repeats an id if its own text is clean; an empty table stays empty."""
    chain = train(docs, labels)
    clash = [c for c in docs.columns if c.startswith("p_")]
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)} if clash else {}
    plain = docs.withColumnsRenamed(names) if clash else docs
    out = score(plain, chain, names.get("text", "text"))
    blank = ~F.coalesce(F.col(names.get("text", "text")), F.lit("")).rlike(r"\S")
    out = out.filter((F.col("p_toxic") <= THRESHOLD) | blank).select(*plain.columns)
    return out.withColumnsRenamed({v: k for k, v in names.items()}) if clash else out
