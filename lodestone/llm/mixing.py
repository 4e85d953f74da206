"""Operator 2: mixing sources to target weights by iterative proportional fitting. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import discard, materialize, table

DIMS = ("source", "lang", "topic")
ROUNDS, BOUND_ROUNDS, ALPHA = 5, 3, 0.7
FRACTION, LOSS = 0.5, 0.02  # share of all tokens to sample at most; share of the mixture that scarce cells may fail to give before raking makes it up
TOPICS = (
    ("legal", r"[Ll]icen[sc]e|[Cc]opyright|[Ww]arranty"),
    ("contact", r"[A-Za-z0-9._]+@[A-Za-z0-9]|https?://"),
    ("figures", r"[0-9]{3}"),
)


def topic_of(c) -> F.Column:
    """The first pattern of TOPICS that the text holds, else prose."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in TOPICS:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("prose")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _source, _lang, _topic (null: '') and _tokens, the number of words, 1 at least. A column `topic` of docs is
    their topic; without one the text's patterns tell it."""
    t = F.coalesce(F.col(text), F.lit(""))
    named = {f"_{c}": F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("") for c in ("source", "lang")}
    topic = F.coalesce(F.col("topic"), F.lit("")) if "topic" in docs.columns else topic_of(t)
    return docs.withColumns(named | {"_topic": topic, "_tokens": F.greatest(F.regexp_count(t, F.lit("[^ \t-\r]+")), F.lit(1)).cast("long")})


def shares(cells: DataFrame, d: str, alpha: float) -> DataFrame:
    """(d, _share): each value's share of all tokens to the power alpha, made to add up to 1."""
    raw = materialize(cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(alpha))).alias("_p")), "op2-target")
    whole = raw.agg(F.sum("_p")).first()[0]
    return materialize(raw.select(d, (F.col("_p") / F.lit(whole)).alias("_share")), "op2-target")


def fitted(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, total: float = 1.0, bound: str | None = None) -> DataFrame:
    """cells with w fitted to each dimension's target in turn, `total` times its share, `rounds` times; no cell above its `bound`, if given.

    A marginal is a partial aggregate joined back by its value, so no dimension's cells are gathered. Each step is written out: its
    plan is an aggregate and a join, and the same in each round."""
    for _ in range(rounds):
        for d in DIMS:
            have = cells.groupBy(d).agg(F.sum("w").alias("_have")).filter("_have > 0").join(targets[d], d)
            step = F.col("w") * (F.col("_share") * F.lit(float(total))) / F.col("_have")
            new = F.when(F.col("_have").isNull(), F.col("w")).otherwise(F.least(step, F.col(bound)) if bound else step)
            before, cells = cells, materialize(cells.join(have, d, "left").withColumn("w", new).select(*cells.columns), "op2-cells")
            discard(before)
    return cells


def rake(cells: DataFrame, rounds: int = ROUNDS, alpha: float = ALPHA, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add w to cells (source, lang, topic, tokens): shares of the mixture, fitted to each dimension's target in turn.

    targets: by dimension a table (value, _share); by default `shares` to the power alpha. Cells number at most the product of
    the dimensions' values, whatever the corpus.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("w", F.lit(0.0))
    targets = targets or {d: shares(cells, d, alpha) for d in DIMS}
    return fitted(cells.withColumn("w", F.col("tokens") / F.lit(float(total))), targets, rounds)  # what it discards are its own steps


def feasible(fit: DataFrame, total: float, most: float, loss: float) -> float:
    """The largest share of all tokens, `most` at most, in steps of an eighth of a doubling, of which cells that would have to give more
    than they hold fail to give `loss` at most. Cells are counted by the step of their need, of which there are few."""
    step = F.ceil(F.round(F.log2(F.col("w") * F.lit(total) / F.col("tokens")) * 8, 6)).cast("int")
    per = fit.filter("w > 0").groupBy(step.alias("k")).agg(F.sum("w").alias("w"), (F.sum("tokens") / F.lit(total)).alias("held"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)  # over steps, a few hundred rows
    size = F.pow(F.lit(2.0), -F.col("k") / 8)
    lost = per.select(size.alias("f"), (F.coalesce(F.sum("w").over(above), F.lit(0.0)) - F.coalesce(F.sum("held").over(above), F.lit(0.0)) / size).alias("lost"))
    found = lost.filter(F.col("lost") <= loss).agg(F.max("f")).first()[0]
    return min(most, found if found is not None else most)


def calibrate(docs: DataFrame, fraction: float = FRACTION, rounds: int = ROUNDS, alpha: float = ALPHA, loss: float = LOSS) -> DataFrame:
    """(_source, _lang, _topic, w, p, realised): the mixture's share of each cell, the probability that keeps its tokens in the sample,
    and its share of the sample so expected.

    The sample is as large as scarce cells allow, `fraction` of all tokens at most (see feasible). Within it the cells are raked
    again, none above what it holds, so that the others make up for the scarce ones. `marginals` reports what comes of it.
    """
    counts = materialize(docs.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")).toDF(*DIMS, "tokens"), "op2-counts")
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    out = T.StructType([T.StructField(f"_{d}", T.StringType()) for d in DIMS] + [T.StructField(c, T.DoubleType()) for c in ("w", "p", "realised")])
    if not total:
        return docs.sparkSession.createDataFrame([], out)
    targets = {d: shares(counts, d, alpha) for d in DIMS}
    fit = rake(counts, rounds, alpha, targets)
    f = feasible(fit, float(total), float(fraction), loss)
    cells = fit.withColumn("fit", F.col("w")).withColumn("held", F.col("tokens") / F.lit(float(total)))
    cells = fitted(cells.withColumn("w", F.least(F.col("held"), F.col("fit") * F.lit(f))), targets, BOUND_ROUNDS, f, "held")
    whole = cells.agg(F.sum("w")).first()[0]
    return cells.select(*[F.col(d).alias(f"_{d}") for d in DIMS], F.col("fit").alias("w"), (F.col("w") / F.col("held")).alias("p"), (F.col("w") / F.lit(whole)).alias("realised"))


def marginals(docs: DataFrame, alpha: float = ALPHA, **options) -> DataFrame:
    """(dimension, value, natural, target, realised): shares of tokens in docs, in the target mixture, and as the sample is expected to have
    them."""
    rows = materialize(features(docs).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("_tokens")), "op2-rows")
    cells = materialize(calibrate(rows, alpha=alpha, **options), "op2-fit")
    both = rows.withColumnRenamed("_tokens", "tokens").join(cells, ["_source", "_lang", "_topic"])
    total = rows.agg(F.sum("_tokens")).first()[0]
    parts = [both.groupBy(F.col(f"_{d}").alias("value")).agg((F.sum("tokens") / F.lit(total)).alias("natural"), F.sum("w").alias("target"), F.sum("realised").alias("realised")).withColumn("dimension", F.lit(d)) for d in DIMS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("dimension", "value", "natural", "target", "realised")


def uniform(ident) -> F.Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(ident.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix_sources(docs: DataFrame, fraction: float = FRACTION, rounds: int = ROUNDS, alpha: float = ALPHA, ident: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, weight (its cell's share of the mixture), p, realised, kept.

    The draw is a hash of doc_id against p, so it repeats exactly, and rows that repeat an id are kept or dropped together. Null
    source and lang are values of their own, ''; null and empty texts count one token, so every document has a chance, and
    very long ones count all theirs; a null doc_id draws as the word 'null'. Other columns, whatever their names, play no part.
    An empty table gives an empty result. The cells are joined by broadcast only where Spark
    finds their table small enough, else by a shuffle that adaptive execution splits.
    """
    own = docs.select(F.col(ident).alias("doc_id"), *[c for c in ("text", *DIMS) if c in docs.columns])
    rows = materialize(features(own).select("doc_id", "_source", "_lang", "_topic", "_tokens"), "op2-rows")
    cells = calibrate(rows, fraction, rounds, alpha)
    return rows.join(cells, ["_source", "_lang", "_topic"]).select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"),
        F.round("w", 9).alias("weight"), F.round("p", 9).alias("p"), F.round("realised", 9).alias("realised"),
        (uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) < F.col("p")).alias("kept"),
    )


def sample_documents(docs: DataFrame, fraction: float = FRACTION, rounds: int = ROUNDS, alpha: float = ALPHA, ident: str = "doc_id") -> DataFrame:
    """The documents that mix_sources keeps, with their own columns, whatever those are named."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in ("text", *DIMS) if c in docs.columns}
    plain = docs.toDF(*names)
    f = features(plain.select(*names, *[F.col(k).alias(c) for c, k in at.items()])).drop(*at)
    rows = materialize(f.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("_tokens")), "op2-rows")
    cells = calibrate(rows, fraction, rounds, alpha)
    drawn = uniform(F.coalesce(F.col(names[docs.columns.index(ident)]).cast("string"), F.lit("null"))) < F.col("p")
    return f.join(cells, ["_source", "_lang", "_topic"]).filter(drawn).select(*names).toDF(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def _sql() -> str:
    topics = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS)
    steps, last = [], "w0"

    def fit(count, size, least, more):
        nonlocal last
        for _ in range(count):
            for d in DIMS:
                new = f"w{len(steps) + 1}"
                to = f"w * (s.share * {size}) / sum(w) OVER (PARTITION BY {d})"
                steps.append(f"{new} AS (SELECT source, lang, topic, tokens{more}, CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN {least.format(to)} ELSE w END AS w FROM {last} JOIN s_{d} s USING ({d}))")
                last = new

    fit(ROUNDS, "1.0::DOUBLE", "{}", "")
    steps.append(f"""q AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM c)::DOUBLE AS held, ceil(round(log2(w * (SELECT sum(tokens) FROM c)::DOUBLE / tokens) * 8, 6))::INTEGER AS k FROM {last})""")
    steps.append("b AS (SELECT k, sum(w) AS w, sum(held) AS held, pow(2.0::DOUBLE, -k / 8.0::DOUBLE) AS f FROM q GROUP BY k)")
    above = "OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    steps.append(f"l AS (SELECT f, coalesce(sum(w) {above}, 0) - coalesce(sum(held) {above}, 0) / f AS lost FROM b)")
    steps.append(f"z AS MATERIALIZED (SELECT least({FRACTION}::DOUBLE, max(f)) AS f FROM l WHERE lost <= {LOSS})")
    steps.append("x0 AS (SELECT source, lang, topic, tokens, held, w AS fit, least(held, w * (SELECT f FROM z)) AS w FROM q)")
    last = "x0"
    fit(BOUND_ROUNDS, "(SELECT f FROM z)", "least({}, held)", ", held, fit")
    share = ", ".join(f"s_{d} AS (SELECT {d}, pow(sum(tokens), {ALPHA}) / sum(pow(sum(tokens), {ALPHA})) OVER () AS share FROM c GROUP BY {d})" for d in DIMS)
    return f"""
WITH r AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
     f AS (SELECT doc_id, source, lang, CASE {topics} ELSE 'prose' END AS topic,
                  greatest(len(regexp_extract_all(t, '[^ \t-\r]+')), 1)::BIGINT AS tokens FROM r),
     c AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM f GROUP BY ALL),
     {share},
     w0 AS (SELECT *, tokens / (SELECT sum(tokens) FROM c)::DOUBLE AS w FROM c),
     {", ".join(steps)},
     p AS (SELECT source, lang, topic, fit AS w, w / held AS p, w / sum(w) OVER () AS realised FROM {last})
SELECT doc_id, source, lang, topic, f.tokens AS tokens, round(w, 9) AS weight, round(p, 9) AS p, round(realised, 9) AS realised,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < p AS kept
FROM f JOIN p USING (source, lang, topic)
"""


OP2_SQL = _sql()
