"""Structured sources: unified diffs, OpenAPI documents and package manifests, read with Spark's own functions."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_lines(patches: DataFrame, key: str = "patch") -> DataFrame:
    """(patch, file, side, line): each line that a unified diff adds (side 'new') or removes (side 'old'), with its number on its side.

    patches has (patch, body). A line's number is its hunk's start plus the lines of its side between. Within a hunk the header's
    counts tell which lines belong to it, so text that looks like a header is none. A pair of windows over a patch's own lines carries header and counts.
    """
    rows = patches.select(key, F.posexplode(F.split("body", "\n", -1)).alias("n", "text"))
    order = Window.partitionBy(key).orderBy("n")
    number = lambda k, default: F.coalesce(F.try_element_at(F.filter(F.array(F.regexp_extract("text", HUNK, k)), lambda x: x != ""), F.lit(1)).cast("int"), F.lit(default))
    head = F.col("text").rlike(HUNK)
    hunk = F.when(head, F.struct("n", number(1, 0).alias("old"), number(2, 1).alias("olds"), number(3, 0).alias("new"), number(4, 1).alias("news")))
    rows = rows.withColumn("hunk", F.last(hunk, True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inner = Window.partitionBy(key, "hunk.n").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.substring("text", 1, 1)
    on_old = F.when(F.col("n") == F.col("hunk.n"), 0).when(mark.isin("+", "\\"), 0).otherwise(1)
    on_new = F.when(F.col("n") == F.col("hunk.n"), 0).when(mark.isin("-", "\\"), 0).otherwise(1)
    rows = rows.withColumns({"at_old": F.coalesce(F.sum(on_old).over(inner), F.lit(0)), "at_new": F.coalesce(F.sum(on_new).over(inner), F.lit(0))})
    inside = F.col("hunk").isNotNull() & (F.col("n") > F.col("hunk.n")) & ((F.col("at_old") < F.col("hunk.olds")) | (F.col("at_new") < F.col("hunk.news")))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(False)))
    named = lambda sign, folder: F.last(F.when(~F.col("inside") & F.col("text").startswith(sign), F.regexp_replace(F.regexp_extract("text", r"^... (?:" + folder + r"/)?([^\t]*)", 1), r"\s+$", "")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"old_file": named("--- ", "a"), "new_file": named("+++ ", "b")})
    side = F.when(mark == "+", "new").when(mark == "-", "old")
    found = rows.filter("inside").withColumn("side", side).filter("side is not null")
    new = F.col("side") == "new"
    return found.select(key, F.when(new, F.col("new_file")).otherwise(F.col("old_file")).alias("file"), "side",
                        F.when(new, F.col("hunk.new") + F.col("at_new")).otherwise(F.col("hunk.old") + F.col("at_old")).cast("long").alias("line"))


def openapi_routes(files: DataFrame) -> DataFrame:
    """(file, line, method, path, handler, role) from OpenAPI documents in JSON (path, body): a server route per operation. The server's base
    path comes before each path; a document without `paths` gives nothing. YAML bodies are turned into JSON first by `as_json`."""
    spec = "struct<openapi:string,swagger:string,basePath:string,servers:array<struct<url:string>>,paths:map<string,map<string,string>>>"
    doc = files.select(F.col("path").alias("file"), F.from_json("body", spec).alias("d")).filter("d.paths is not null and (d.openapi is not null or d.swagger is not null)")
    base = F.regexp_replace(F.coalesce("d.basePath", F.regexp_replace(F.try_element_at("d.servers", F.lit(1))["url"], "^[a-z]+://[^/]*", ""), F.lit("")), "/+$", "")
    ops = doc.select("file", base.alias("base"), F.explode("d.paths").alias("route", "verbs")).select("file", "base", "route", F.explode("verbs").alias("verb", "op"))
    ops = ops.filter(F.lower("verb").isin(*METHODS))
    return ops.select("file", F.lit(1).alias("line"), F.upper("verb").alias("method"), F.concat("base", "route").alias("path"), F.get_json_object("op", "$.operationId").alias("handler"), F.lit("server").alias("role"))


def as_json(files: DataFrame) -> DataFrame:
    """files with YAML bodies (.yaml, .yml) as JSON; a body that doesn't parse becomes null. Needs PyYAML on the executors."""

    def run(batches):
        import json

        import yaml

        for pdf in batches:
            out = []
            for path, body in zip(pdf["path"], pdf["body"], strict=True):
                if path.endswith((".yaml", ".yml")):
                    try:
                        body = json.dumps(yaml.safe_load(body), default=str)
                    except yaml.YAMLError:
                        body = None
                out.append(body)
            pdf["body"] = out
            yield pdf

    return files.select("path", "body").mapInPandas(run, "path string, body string")


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(file, ecosystem, name, version, scope) from package.json, go.mod, requirements.txt and Cargo.toml files (path, body)."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    f = files.select(F.col("path").alias("file"), "body", base.alias("base"))
    spec = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>>"
    npm = f.filter("base = 'package.json'").select("file", F.from_json("body", spec).alias("d"))
    parts = [npm.select("file", F.explode(f"d.{field}").alias("name", "version")).select("file", F.lit("npm").alias("ecosystem"), "name", "version", F.lit(scope).alias("scope"))
             for field, scope in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"))]
    lines = f.filter("base in ('go.mod', 'requirements.txt', 'Cargo.toml')").select("file", "base", F.posexplode(F.split("body", "\n", -1)).alias("n", "text"))
    go = lines.filter("base = 'go.mod'").withColumn("m", F.regexp_extract("text", r"^\s*(?:require\s+)?([^\s/]+\.[^\s]+)\s+(v[^\s]+)", 0)).filter("m <> '' and not text rlike '^\\\\s*(module|replace|exclude|go)\\\\b'")
    parts.append(go.select("file", F.lit("go").alias("ecosystem"), F.regexp_extract("text", r"([^\s/]+\.[^\s]+)\s+v", 1).alias("name"), F.regexp_extract("text", r"\s(v[^\s]+)", 1).alias("version"),
                           F.when(F.col("text").contains("// indirect"), "indirect").otherwise("runtime").alias("scope")))
    pip = lines.filter("base = 'requirements.txt'").withColumn("name", F.regexp_extract("text", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)).filter("name <> ''")
    parts.append(pip.select("file", F.lit("pypi").alias("ecosystem"), F.lower("name").alias("name"), F.regexp_extract("text", r"([=<>~!]=?[^#;\s]+)", 1).alias("version"), F.lit("runtime").alias("scope")))
    section = F.last(F.when(F.col("text").rlike(r"^\s*\["), F.regexp_extract("text", r"^\s*\[+([^\]]+)\]", 1)), True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cargo = lines.filter("base = 'Cargo.toml'").withColumn("section", section).filter("section in ('dependencies', 'dev-dependencies')").withColumn("name", F.regexp_extract("text", r"^\s*([A-Za-z0-9_-]+)\s*=", 1)).filter("name <> ''")
    parts.append(cargo.select("file", F.lit("crates").alias("ecosystem"), "name", F.regexp_extract("text", r'"([^"]+)"', 1).alias("version"), F.when(F.col("section") == "dependencies", "runtime").otherwise("dev").alias("scope")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def declared_intent(files: DataFrame, key: str = "intent") -> DataFrame:
    """(page, section, entry, line) from markdown pages (path, body) that opt in: the front matter, between the first line '---' and the
    next, holds `key:`, beneath it sections, and beneath those entries as list items. A page's prose is never read, and every row names its page."""
    lines = files.filter(F.col("path").endswith(".md")).select(F.col("path").alias("page"), F.posexplode(F.split("body", "\n", -1)).alias("n", "text"))
    order = Window.partitionBy("page").orderBy("n")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.rtrim("text") == "---"
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(so_far)).withColumn("opens", F.first(fence).over(so_far))
    front = lines.filter("opens and fences = 1 and n > 0")
    top = F.when(F.col("text").rlike(r"^\S"), F.regexp_extract("text", r"^([^:\s]+):", 1))
    front = front.withColumn("top", F.last(top, True).over(so_far)).filter(F.col("top") == key)
    section = F.when(F.col("text").rlike(r"^\s+[^-\s][^:]*:\s*$"), F.regexp_extract("text", r"^\s+([^:]+):", 1))
    front = front.withColumn("section", F.last(section, True).over(before))
    item = F.regexp_extract("text", r"^\s+-\s+(.*?)\s*$", 1)
    return front.withColumn("entry", item).filter("entry <> '' and section is not null").select("page", "section", "entry", (F.col("n") + 1).alias("line"))
