"""Facts and edges derived from the driver's star schema, as SQL that Spark and DuckDB both read.

The tables hold no code, so nations and brands play modules, suppliers, customers and parts play symbols, regions play
repositories, and the lineitem and orders tables give the edges.
"""
from __future__ import annotations

import contextlib
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import TASK_ROWS, shared_folder

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

NAT = "nat AS (SELECT n_nationkey, 'nation/' || n_name AS module, r_name AS repo FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey)"
FACTS = """facts AS (
 SELECT repo, 'module' AS kind, module AS name, module AS file, 1 AS line, 1 AS end_line, 'package' AS symbol_kind, true AS exported, 0 AS cyclomatic, 0 AS loop_depth, '1.0' AS version FROM nat
 UNION ALL SELECT DISTINCT r_name, 'module', 'part/' || p_brand, 'part/' || p_brand, 1, 1, 'package', true, 0, 0, '1.0' FROM {part} p JOIN {region} r ON p.p_partkey % 5 = r.r_regionkey
 UNION ALL SELECT repo, 'symbol', 'Supplier.' || s_suppkey, module || '/supplier.src', CAST(s_suppkey * 10 AS INT), CAST(s_suppkey * 10 + 5 AS INT), 'class', s_acctbal >= 0, CAST(s_suppkey % 40 AS INT), CAST(s_suppkey % 4 AS INT), '1.' || (s_suppkey % 12) FROM {supplier} s JOIN nat ON s.s_nationkey = nat.n_nationkey
 UNION ALL SELECT repo, 'symbol', 'Customer.' || c_custkey, module || '/customer.src', CAST(c_custkey * 10 AS INT), CAST(c_custkey * 10 + 3 AS INT), 'function', c_acctbal >= 0, CAST(c_custkey % 23 AS INT), CAST(c_custkey % 3 AS INT), '2.' || (c_custkey % 7) FROM {customer} c JOIN nat ON c.c_nationkey = nat.n_nationkey
 UNION ALL SELECT r_name, 'symbol', 'Part.' || p_partkey, 'part/' || p_brand || '/part.src', CAST(p_partkey * 10 AS INT), CAST(p_partkey * 10 + p_size % 10 AS INT), lower(p_type), p_size % 3 <> 0, p_size, p_size % 5, '0.' || p_size FROM {part} p JOIN {region} r ON p.p_partkey % 5 = r.r_regionkey
 UNION ALL SELECT r_name, 'service', r_name, r_name, 1, 1, 'service', true, 0, 0, '1.0' FROM {region})"""
CALLS = "calls AS (SELECT DISTINCT 'Supplier.' || l_suppkey AS src, 'Part.' || l_partkey AS dst FROM {lineitem})"
DEPENDS = "depends AS (SELECT DISTINCT 'Customer.' || o_custkey AS src, 'Supplier.' || l_suppkey AS dst FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey)"
FLOW = """flow AS (SELECT a.module AS src, b.module AS dst, a.repo AS src_repo, b.repo AS dst_repo, count(*) AS n
 FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN nat a ON a.n_nationkey = c.c_nationkey
 JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN nat b ON b.n_nationkey = s.s_nationkey GROUP BY a.module, b.module, a.repo, b.repo)"""
#: The flows above rank floor(0.88 * n), so that the graph is not complete: exact, and the same in any engine.
IMPORTS = """imports AS (SELECT src, dst, src_repo, dst_repo, n FROM (SELECT flow.*, row_number() OVER (ORDER BY n, src, dst) AS rk, count(*) OVER () AS total FROM flow) x
 WHERE n >= 1 AND rk > floor(total * 0.88) AND src <> dst)"""
EDGES = """edges AS (SELECT src, 'calls' AS rel, dst FROM calls UNION ALL SELECT src, 'depends_on', dst FROM depends
 UNION ALL SELECT src, 'imports', dst FROM imports
 UNION ALL SELECT name, 'declares', regexp_replace(file, '/[a-z]+[.]src$', '') FROM facts WHERE kind = 'symbol')"""
ROUTES = """routes AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path, CASE WHEN page_id % 2 = 0 THEN 'client' ELSE 'server' END AS role,
 'repo' || (page_id % 4) AS repo, CASE WHEN page_id % 5 = 0 THEN '*' WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method FROM {pages})"""

PARTS = {"nat": NAT, "facts": FACTS, "calls": CALLS, "depends": DEPENDS, "flow": FLOW, "imports": IMPORTS, "edges": EDGES, "routes": ROUTES}
KEPT: dict[tuple, tuple] = {}
SPLIT = 16 << 20  # bytes of a file that a task reads where edges are written: before a shuffle it holds their distinct rows
NEEDS = {"facts": ["nat"], "flow": ["nat"], "imports": ["nat", "flow"], "edges": ["nat", "facts", "calls", "depends", "flow", "imports"]}


def order(names) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in out:
                out.append(x)
    return out


def sql(names: str, rest: str, recursive: bool = False) -> str:
    """DuckDB SQL: the named parts as CTEs, then rest, which starts with further CTEs (', x AS (...)') or with SELECT."""
    parts = ",\n".join(PARTS[n] for n in order(names.split())).format(**{t: t for t in TABLES})
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + parts + ("" if rest.lstrip().startswith(",") else "\n") + rest


class Tables:
    """DataFrames over one data folder, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def part(self, name: str, columns: str = "*") -> DataFrame:
        """One of PARTS as a DataFrame; Catalyst drops what isn't asked for."""
        text = "WITH " + ",\n".join(PARTS[n] for n in order([name])) + f"\nSELECT {columns} FROM {name}"
        used = [t for t in TABLES if "{" + t + "}" in text]
        return self.spark.sql(text, **{t: self.raw(t) for t in used})

    def stamp(self) -> tuple:
        """Modification times of the folder's tables: what is kept of them holds as long as these do."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{t}.parquet") for t in TABLES]
        fs = paths[0].getFileSystem(conf)
        return tuple(fs.getFileStatus(p).getModificationTime() if fs.exists(p) else 0 for p in paths)

    def stored(self, name: str, by: str, order: str) -> DataFrame:
        """One of PARTS written to the shared folder once a session, in folders by `by` and sorted by `order`: filters on either read
        little, and the hops of a walk read files instead of joining the tables again."""
        key = (self.spark.sparkContext.applicationId, self.dir, name, self.stamp())
        if key not in KEPT:
            df, path = self.part(name), f"{shared_folder(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
            with self.fine_tasks():
                df.sortWithinPartitions(by, order).write.partitionBy(by).parquet(path)
            KEPT[key] = path, df.schema
        path, schema = KEPT[key]
        return self.spark.read.schema(schema).parquet(path).select(*schema.names)

    @functools.cached_property
    def facts(self) -> DataFrame:
        return self.stored("facts", "kind", "name")

    @contextlib.contextmanager
    def fine_tasks(self):
        """Within it shuffles have a task for about TASK_ROWS rows of lineitem, none are put together, and files are read in parts of SPLIT bytes at
        most: what a task sorts or holds doesn't grow with the tables. The session's settings come back afterwards."""
        n = max(self.spark.sparkContext.defaultParallelism, -(-self.raw("lineitem").count() // TASK_ROWS))
        want = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
        if self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > SPLIT:
            want["spark.sql.files.maxPartitionBytes"] = str(SPLIT)
        was = {k: self.spark.conf.get(k) for k in want}
        try:
            for k, v in want.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in was.items():
                self.spark.conf.set(k, v)

    def edges_of(self, *rels: str) -> DataFrame:
        """The edges of some relations. Each relation is written once a session, when first asked for, in a folder of its own and sorted by source."""
        place = (self.spark.sparkContext.applicationId, self.dir, "edges", self.stamp())
        base = KEPT.setdefault(place, f"{shared_folder(self.spark)}/tables/edges-{uuid.uuid4().hex}")
        for rel in rels:
            if (*place, rel) not in KEPT:
                df = self.part("edges", "src, dst, rel").filter(F.col("rel") == rel)
                with self.fine_tasks():
                    df.select("src", "dst").sortWithinPartitions("src").write.parquet(f"{base}/rel={rel}")
                KEPT[(*place, rel)] = df.schema
        schema = KEPT[(*place, rels[0])]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/rel={r}" for r in rels]).select("src", "rel", "dst")

    @functools.cached_property
    def edges(self) -> DataFrame:
        return self.edges_of("calls", "depends_on", "imports", "declares")

    @functools.cached_property
    def imports(self) -> DataFrame:
        return self.stored("imports", "src_repo", "src")
