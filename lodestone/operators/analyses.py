"""Analyses over facts and edges (A rows): outliers, top-k, anti joins and package metrics.

Mean and standard deviation are those of the whole population; thresholds are scalars, brought to the rows by a one-row broadcast.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

MAX_CONFIDENCE = 0.95


def population(symbols: DataFrame, degrees: DataFrame) -> DataFrame:
    """Every distinct symbol (key) with its degrees, 0 where it has no edge: what outliers are measured against. Written out, as it is
    read for the threshold and for the rows."""
    return checkpointed(symbols.select("key").distinct().join(degrees, "key", "left").fillna(0, ["fan_in", "fan_out"]))


def with_outlier_threshold(df: DataFrame, value: str) -> DataFrame:
    """df with threshold = mean + 2 population standard deviations of value, from exact integer sums where value is an integer."""
    v = F.col(value).cast("double")
    stats = df.agg((F.avg(v) + 2 * F.stddev_pop(v)).alias("threshold"))
    return df.join(F.broadcast(stats))  # one row


def clamp_confidence(value: Column, threshold: Column) -> Column:
    """0.5 + 0.5 * (value / threshold - 1), between 0.5 and 0.95; 0.6 for a threshold of 0 or less."""
    c = 0.5 + 0.5 * (value / threshold - 1)
    return F.when(threshold <= 0, 0.6).otherwise(F.greatest(F.lit(0.5), F.least(c, F.lit(MAX_CONFIDENCE))))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def hotspots(degrees: DataFrame, least: int = 3, k: int = 20) -> DataFrame:
    """Nodes with fan-in and fan-out of `least` or more whose product is an outlier; the k largest."""
    p = degrees.withColumn("score", F.col("fan_in") * F.col("fan_out"))
    x = with_outlier_threshold(p, "score").filter((F.col("score") > F.col("threshold")) & (F.col("fan_in") >= least) & (F.col("fan_out") >= least))
    return top(x, k, F.desc("score"), F.asc("key")).drop("threshold")


def god_classes(degrees: DataFrame, least: int = 8, k: int = 25) -> DataFrame:
    x = with_outlier_threshold(degrees, "fan_in").filter((F.col("fan_in") >= least) & (F.col("fan_in") > F.col("threshold")))
    return top(x.withColumn("confidence", F.round(clamp_confidence(F.col("fan_in"), F.col("threshold")), 6)), k, F.desc("fan_in"), F.asc("key")).drop("threshold")


def complexity_outliers(symbols: DataFrame, least: int = 10, k: int = 15) -> DataFrame:
    x = with_outlier_threshold(symbols, "cyclomatic").filter((F.col("cyclomatic") >= least) & (F.col("cyclomatic") > F.col("threshold")))
    return top(x, k, F.desc("cyclomatic"), F.asc("name")).drop("threshold")


def exported_surface(symbols: DataFrame, least: int = 15, ratio: float = 0.85, k: int = 20) -> DataFrame:
    g = symbols.filter(F.col("exported").isNotNull()).groupBy("module").agg(F.count(F.lit(1)).alias("symbols"), F.count_if("exported").alias("exported"))
    g = g.withColumn("ratio", F.round(F.col("exported") / F.col("symbols"), 3))
    return top(g.filter((F.col("symbols") >= least) & (F.col("exported") / F.col("symbols") >= ratio)), k, F.desc("exported"), F.desc("ratio"), F.asc("module"))


def package_metrics(edges: DataFrame, types: DataFrame) -> DataFrame:
    """package, ca, ce, instability, abstractness, distance, zone. edges: src, dst between packages; types: package, abstract."""
    e = edges.filter("src <> dst").distinct()
    ca = e.groupBy(F.col("dst").alias("package")).agg(F.count(F.lit(1)).alias("ca"))
    ce = e.groupBy(F.col("src").alias("package")).agg(F.count(F.lit(1)).alias("ce"))
    n = types.groupBy("package").agg(F.count(F.lit(1)).alias("classes"), F.count_if("abstract").alias("abstract_n"))
    x = n.join(ca, "package", "left").join(ce, "package", "left").fillna(0, ["ca", "ce"])
    i = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0)
    a = F.when(F.col("classes") > 0, F.col("abstract_n") / F.col("classes")).otherwise(0.0)
    x = x.withColumn("i", i).withColumn("a", a).withColumn("d", F.abs(F.col("a") + F.col("i") - 1))
    zone = F.when((F.col("d") > 0.7) & (F.col("classes") >= 3), F.when(F.col("a") + F.col("i") < 1, "pain").otherwise("useless")).when(F.col("d") <= 0.3, "main").otherwise("neutral")
    return x.select("package", "classes", "ca", "ce", F.round("i", 3).alias("instability"), F.round("a", 3).alias("abstractness"), F.round("d", 3).alias("distance"), zone.alias("zone"))


def rigid_floor(metrics: DataFrame, least: int = 5) -> DataFrame:
    """The afferent coupling from which a package counts as rigid: the value at index floor((9n+9)/10) of the sorted values, 5 at least.
    Packages number in the thousands; the rank is a window over their counts, not over facts."""
    w = Window.orderBy("ca", "package")
    x = metrics.select("ca", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return x.filter(F.col("i") == F.least(F.floor((9 * F.col("n") + 9) / 10), F.col("n") - 1)).select(F.greatest(F.col("ca"), F.lit(least)).alias("floor"))


def dead_code(symbols: DataFrame, usage: DataFrame) -> DataFrame:
    """Symbols that no usage edge (src, dst) names: isolated where they use nothing themselves, else unreferenced."""
    un = symbols.join(usage.select(F.col("dst").alias("name")).distinct(), "name", "left_anti")
    out = usage.select(F.col("src").alias("name")).distinct().withColumn("uses", F.lit(True))
    return un.join(out, "name", "left").withColumn("class", F.when(F.col("uses"), "unreferenced").otherwise("isolated")).drop("uses")


def mutual_pairs(pairs: DataFrame) -> DataFrame:
    """Directed pairs whose reverse exists, once, the smaller name first."""
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return pairs.select("src", "dst").distinct().join(back, ["src", "dst"], "left_semi").filter("src < dst")


def risk(weight: Column, confidence: Column, handler: Column) -> Column:
    return F.round(weight * confidence * F.when(handler, 1.3).otherwise(1.0), 2)


#: Names of folders that by custom hold others' code, and names of licence files in lower case.
VENDOR_FOLDERS = ("third_party", "thirdparty", "3rdparty", "external", "externals", "extern", "deps", "contrib", "vendored", "Pods", "Carthage", "bower_components")
LICENCE_FILES = ("license", "license.txt", "license.md", "license.rst", "licence", "licence.txt", "licence.md", "copying", "copying.txt", "copying.md", "license-mit", "license-apache", "unlicense", "copyright")


def vendored_candidates(files: DataFrame, levels: int = 2) -> DataFrame:
    """(dir, licence, files, ignore): folders that hold a licence file and lie at most `levels` below a folder whose name says it holds
    others' code; how many files they hold, and the glob that would leave them out. A report: nothing is left out by it."""
    parts = F.split("path", "/")
    f = files.select("path", parts.alias("parts"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folders"))
    under = F.exists(F.slice("folders", F.greatest(F.size("folders") - levels, F.lit(1)), F.least(F.lit(levels), F.greatest(F.size("folders") - 1, F.lit(0)))), lambda x: x.isin(*VENDOR_FOLDERS))
    held = f.filter(F.lower(F.element_at("parts", -1)).isin(*LICENCE_FILES) & (F.size("folders") > 1) & under)
    held = held.groupBy(F.array_join("folders", "/").alias("dir")).agg(F.min(F.element_at("parts", -1)).alias("licence"))
    above = F.transform(F.sequence(F.lit(1), F.size("folders")), lambda i: F.array_join(F.slice("folders", F.lit(1), i), "/"))
    inside = f.filter(F.size("folders") > 0).select(F.explode(above).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    return held.join(inside, "dir").select("dir", "licence", "files", F.concat("dir", F.lit("/**")).alias("ignore"))
