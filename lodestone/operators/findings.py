"""Findings as a table, its filters (Q16) and its sinks (K2, K4, K5, K7, K8)."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: source, title, confidence, informational, file, line, repo: what every analysis can be brought to.
COLUMNS = ["source", "title", "confidence", "informational", "file", "line", "repo"]


def finding(df: DataFrame, source: str, title: Column, confidence: Column, file: Column, line: Column, repo: Column, informational: bool = False) -> DataFrame:
    return df.select(F.lit(source).alias("source"), title.alias("title"), F.round(confidence.cast("double"), 6).alias("confidence"), F.lit(informational).alias("informational"),
                     file.cast("string").alias("file"), line.cast("long").alias("line"), repo.cast("string").alias("repo"))


def query_findings(findings: DataFrame, source: str = "", repo: str = "", least: float = 0.0) -> DataFrame:
    """Findings of a source (case apart), of repositories whose name holds `repo`, and of a confidence of `least` or more."""
    out = findings.filter(F.col("confidence") >= least)
    if source.strip():
        out = out.filter(F.lower("source") == source.strip().lower())
    if repo.strip():
        out = out.filter(F.contains(F.lower("repo"), F.lit(repo.strip().lower())))
    return out


def by_source(findings: DataFrame) -> DataFrame:
    return findings.groupBy("source").agg(F.count(F.lit(1)).alias("findings"), F.max("confidence").alias("highest"))


def identity(findings: DataFrame) -> Column:
    """What a finding is across runs: its source and its title with digits blanked, and its file; a line may move."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.col("source"), F.regexp_replace("title", "[0-9]+", "#"), F.coalesce("file", F.lit(""))), 256), 1, 16)


def sarif_results(findings: DataFrame) -> DataFrame:
    """(rule_id, rule_index, level, message, uri, start_line, fingerprint, properties): a row per SARIF result; rules are numbered by
    name. Rules are as many as there are analyses, so their table is broadcast."""
    rules = findings.select(F.col("source").alias("rule_id")).distinct()
    index = rules.groupBy().agg(F.array_sort(F.collect_list("rule_id")).alias("rules")).select(F.posexplode("rules").alias("rule_index", "rule_id"))
    level = F.when(F.col("informational"), "note").when(F.col("confidence") >= 0.9, "error").otherwise("warning")
    return findings.withColumn("rule_id", F.col("source")).join(F.broadcast(index), "rule_id").select(
        "rule_id", "rule_index", level.alias("level"), F.regexp_replace("title", r"\s+", " ").alias("message"), F.col("file").alias("uri"), F.greatest("line", F.lit(1)).alias("start_line"), identity(findings).alias("fingerprint"), "confidence")


def write_sarif(findings: DataFrame, path: str, tool: str = "lodestone") -> None:
    """One SARIF 2.1.0 document a partition of results, under path: results stream from executors, and only rule names are common."""
    r = sarif_results(findings)
    where = F.when(F.col("uri").isNotNull(), F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"), where.alias("locations"), F.struct(F.col("fingerprint").alias("identity/v1")).alias("partialFingerprints"), F.struct("confidence").alias("properties"))
    names = r.select("rule_id").distinct().orderBy("rule_id").collect()  # one per analysis
    rules = F.array(*[F.struct(F.lit(n.rule_id).alias("id")) for n in names]) if names else F.array()
    lists = r.select(result.alias("r"), F.spark_partition_id().alias("p")).groupBy("p").agg(F.collect_list("r").alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.col("results"))
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    lists.select(F.to_json(doc).alias("value")).write.text(path)


def write_insights(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines in one total order."""
    evidence = F.array(F.struct("file", "line", "repo"))
    findings.orderBy(F.desc("confidence"), "source", "title", "file", "line").select("source", "title", "confidence", "informational", evidence.alias("evidence")).write.json(path)


def write_flows(flows: DataFrame, path: str, most: int = 20) -> None:
    """The top flows (root, reach, ...) as JSON lines, by reach and name."""
    flows.orderBy(F.desc("reach"), "root").limit(most).write.json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Whole texts of documents beside the facts, as JSON lines (id, digest, text): facts name them by id and tell a change by digest."""
    documents.select("id", F.sha2("text", 256).alias("digest"), "text").write.json(path)


def published(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write df beside path and swap it in: readers see the old folder or the new one, never half of it."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.format(fmt).save(staged)
    jvm = spark._jvm
    new, final, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path, f"{staged}.old"))
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final) and not fs.rename(final, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, final):
        raise OSError(f"{staged} can't be moved to {path}")
    fs.delete(old, True)
