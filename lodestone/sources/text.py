"""Sources: file walk, content manifest, incremental selection, facts JSONL, and extractors for line formats and Python."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_test_path, matches_glob

FACTS = ("repo string, kind string, name string, file string, line int, end_line int, column int, end_column int, repo_prefixed boolean, "
         "props map<string,string>, relations array<struct<kind:string,target:string,target_id:string>>, id string")


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, body, test): text files under root, without those an ignore glob matches."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace("file://", "") + "/", "")
    return raw.select(rel.alias("path"), F.col("content").cast("string").alias("body")).filter(~matches_glob(F.col("path"), ignore or [])).withColumn("test", is_test_path(F.col("path")))


def manifest(files: DataFrame, key: str = "path") -> DataFrame:
    return files.select(key, F.sha2("body", 256).alias("digest"))


def drift(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """(key, drift) for files added, removed and changed, by content hash."""
    x = manifest(old, key).withColumnRenamed("digest", "was").join(manifest(new, key).withColumnRenamed("digest", "now"), key, "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    return x.select(key, F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").otherwise("changed").alias("drift"))


def changed(files: DataFrame, last: DataFrame, key: str = "path") -> DataFrame:
    """The files whose hash the last manifest lacks: only these are extracted again."""
    return files.withColumn("digest", F.sha2("body", 256)).join(last, [key, "digest"], "left_anti")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).json(path)


def write_jsonl(facts: DataFrame, path: str) -> None:
    """Facts in one total order over range-partitioned files, so that equal facts give equal bytes."""
    facts.orderBy("repo", "kind", "file", "line", "name", "id").write.mode("errorifexists").json(path)


def by_pattern(files: DataFrame, globs: list[str], pattern: str, kind: str, name: str = "$1") -> DataFrame:
    """(file, line, kind, name) for each line that a pattern matches: the extractors of line formats."""
    lines = files.filter(matches_glob(F.col("path"), globs)).select(F.col("path").alias("file"), F.posexplode(F.split("body", "\n", -1)).alias("n", "text"))
    named = F.regexp_replace(F.regexp_extract("text", pattern, 0), pattern, name)
    return lines.filter(F.col("text").rlike(pattern)).select("file", (F.col("n") + 1).alias("line"), F.lit(kind).alias("kind"), named.alias("name"))


#: (globs, pattern, kind) of the formats that single lines tell.
LINE_FORMATS = {
    "markdown": (["**/*.md", "*.md"], r"^#{1,6}\s+(.*?)\s*$", "symbol"),
    "proto": (["**/*.proto", "*.proto"], r"^\s*rpc\s+(\w+).*$", "route"),
    "terraform": (["**/*.tf", "*.tf"], r'^\s*resource\s+"([^"]+)"\s+"([^"]+)".*$', "symbol"),
    "rego": (["**/*.rego", "*.rego"], r"^([a-z_]\w*)\s*(?:\[|:?=|if\b|\{|\().*$", "symbol"),
    "lookml": (["**/*.lkml", "*.lkml"], r"^\s*(?:view|explore):\s*(\w+).*$", "symbol"),
    "vespa": (["**/*.sd", "*.sd"], r"^\s*document\s+(\w+).*$", "storage"),
    "dbt": (["**/*.sql", "*.sql"], r"^.*\{\{\s*ref\(\s*['\"](\w+)['\"]\s*\)\s*\}\}.*$", "dependency"),
    "go": (["**/*.go", "*.go"], r"^func\s+(?:\([^)]*\)\s*)?(\w+).*$", "symbol"),
    "java": (["**/*.java", "*.java"], r"^.*\b(?:class|interface|enum)\s+(\w+).*$", "symbol"),
    "kotlin": (["**/*.kt", "*.kt"], r"^\s*(?:\w+\s+)*(?:fun|class|object|interface)\s+(\w+).*$", "symbol"),
    "scala": (["**/*.scala", "*.scala"], r"^\s*(?:\w+\s+)*(?:def|class|object|trait)\s+(\w+).*$", "symbol"),
    "ruby": (["**/*.rb", "*.rb"], r"^\s*(?:def|class|module)\s+([\w.:?!]+).*$", "symbol"),
    "rust": (["**/*.rs", "*.rs"], r"^\s*(?:pub\s+)?(?:fn|struct|enum|trait)\s+(\w+).*$", "symbol"),
    "swift": (["**/*.swift", "*.swift"], r"^\s*(?:\w+\s+)*(?:func|class|struct|protocol|enum)\s+(\w+).*$", "symbol"),
    "php": (["**/*.php", "*.php"], r"^\s*(?:\w+\s+)*(?:function|class|interface|trait)\s+(\w+).*$", "symbol"),
    "dart": (["**/*.dart", "*.dart"], r"^\s*(?:abstract\s+)?(?:class|mixin|enum)\s+(\w+).*$", "symbol"),
    "csharp": (["**/*.cs", "*.cs"], r"^\s*(?:\w+\s+)*(?:class|interface|struct|record)\s+(\w+).*$", "symbol"),
    "typescript": (["**/*.{ts,js}", "*.{ts,js}"], r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface)\s+(\w+).*$", "symbol"),
    "c": (["**/*.{c,h,cpp}", "*.{c,h,cpp}"], r"^(?:\w[\w*\s]*\s)\**(\w+)\s*\([^;]*$", "symbol"),
}


def extract_lines(files: DataFrame) -> DataFrame:
    out = None
    for language, (globs, pattern, kind) in LINE_FORMATS.items():
        part = by_pattern(files, globs, pattern, kind).withColumn("language", F.lit(language))
        out = part if out is None else out.unionByName(part)
    return out


def extract_python(files: DataFrame) -> DataFrame:
    """(file, line, end_line, kind, name, cyclomatic, loop_depth, relations) by parsing each Python file; a file that doesn't parse
    gives one `extraction` fact, so that its absence shows."""
    schema = "file string, line int, end_line int, kind string, name string, cyclomatic int, loop_depth int, relations array<struct<kind:string,target:string>>"

    def run(batches):
        import ast

        import pandas as pd

        branch = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension)

        def depth(node):
            own = isinstance(node, ast.For | ast.While | ast.AsyncFor)
            return own + max([depth(x) for x in ast.iter_child_nodes(node)], default=0)

        for pdf in batches:
            rows = []
            for path, body in zip(pdf["path"], pdf["body"], strict=True):
                module = path.removesuffix(".py").replace("/", ".")
                try:
                    tree = ast.parse(body or "")
                except (SyntaxError, ValueError):
                    rows.append((path, 1, 1, "extraction", module, 0, 0, []))
                    continue
                targets = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names] + [n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module]
                rows.append((path, 1, (body or "").count("\n") + 1, "module", module, 0, 0, [{"kind": "imports", "target": x} for x in sorted(set(targets))]))

                def visit(node, prefix, path=path, module=module, rows=rows):
                    for n in ast.iter_child_nodes(node):
                        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                            name = f"{prefix}.{n.name}"
                            rel = [("declares", module)]
                            if isinstance(n, ast.ClassDef):
                                rel += [("implements", ast.unparse(b)) for b in n.bases]
                                score, loops = 0, 0
                            else:
                                rel += sorted({("calls", ast.unparse(c.func)) for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)})
                                score, loops = 1 + sum(isinstance(x, branch) for x in ast.walk(n)), depth(n)
                            rows.append((path, n.lineno, n.end_lineno, "symbol", name, score, loops, [{"kind": k, "target": t} for k, t in rel]))
                            visit(n, name)
                        else:
                            visit(n, prefix)

                visit(tree, module)
            yield pd.DataFrame(rows, columns=["file", "line", "end_line", "kind", "name", "cyclomatic", "loop_depth", "relations"])

    return files.filter(F.col("path").endswith(".py")).select("path", "body").mapInPandas(run, schema)


def merge_provider(facts: DataFrame, provided: DataFrame) -> DataFrame:
    """Facts of an external provider beside the extractors'; on the same (kind, name, file) the extractor's stays."""
    return facts.unionByName(provided.join(facts.select("kind", "name", "file"), ["kind", "name", "file"], "left_anti"), allowMissingColumns=True)


def token(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\W+"), lambda x: x != "")
