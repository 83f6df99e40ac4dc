"""A property graph as DataFrames, and one derived from the order tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """symbols (uid, name, qualified_name, kind, file_path, start_line, end_line, ...), edges
    (source_uid, target_uid, kind, ...) and files (uid, path, ...)."""

    symbols: DataFrame
    edges: DataFrame
    files: DataFrame

    def kind(self, *kinds: str) -> DataFrame:
        """(src, dst) of the edges of some kinds."""
        return self.edges.where(F.col("kind").isin(*kinds)).select(F.col("source_uid").alias("src"), F.col("target_uid").alias("dst"))

    def inner(self, *kinds: str) -> DataFrame:
        """kind() where both ends are symbols."""
        own = self.symbols.select("uid")
        edges = self.kind(*kinds)
        return edges.join(own, F.col("src") == F.col("uid"), "left_semi").join(own, F.col("dst") == F.col("uid"), "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, suppliers and customers as symbols; large order lines as calls and imports between them."""
    t = {n: table(spark, sf_dir, n) for n in ("part", "supplier", "customer", "lineitem", "orders")}
    columns = ["uid", "name", "qualified_name", "kind", "file_path", "start_line", "end_line"]
    part = t["part"].selectExpr(
        "'P' || p_partkey uid", "replace(p_name, ' ', '_') || '_' || p_partkey name", "replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') || '_' || p_partkey qualified_name",
        "if(p_size % 2 = 0, 'Function', 'Method') kind", "'part/' || replace(p_brand, '#', '') || '/' || lower(replace(p_type, ' ', '_')) || '.rs' file_path", "bigint(p_size) * 10 start_line", "bigint(p_size) * 10 + 9 end_line",
    )
    supplier = t["supplier"].selectExpr("'S' || s_suppkey uid", "replace(s_name, '#', '_') name", "'supplier.' || replace(s_name, '#', '_') qualified_name", "'Class' kind", "'supplier/n' || s_nationkey || '/lib.rs' file_path", "s_suppkey % 40 * 10 start_line", "s_suppkey % 40 * 10 + 9 end_line")
    customer = t["customer"].selectExpr("'C' || c_custkey uid", "replace(c_name, '#', '_') name", "lower(c_mktsegment) || '.' || replace(c_name, '#', '_') qualified_name", "'Function' kind", "'customer/' || lower(c_mktsegment) || '/n' || c_nationkey || '.rs' file_path", "c_custkey % 40 * 10 start_line", "c_custkey % 40 * 10 + 9 end_line")
    symbols = part.unionByName(supplier).unionByName(customer).select(*columns)
    lines = t["lineitem"].where("l_quantity >= 48").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    lo = lines.join(t["orders"].select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    p, s, c = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("C"), "o_custkey")
    call, k3, k2 = F.col("l_quantity") >= 49, F.col("l_orderkey") % 3, F.col("l_orderkey") % 2
    ends = lambda a, b: F.struct(a.alias("source_uid"), b.alias("target_uid"))
    pair = F.when(call, F.when(k3 == 0, ends(p, s)).when(k3 == 1, ends(s, c)).otherwise(ends(c, p))).otherwise(F.when(k2 == 0, ends(p, s)).otherwise(ends(c, p)))
    links = lo.where(call | (F.col("l_quantity") == 48)).select(pair.alias("e"), F.when(call, "CALLS").otherwise("IMPORTS").alias("kind")).select("e.*", "kind").distinct()
    contained = symbols.select(F.col("uid").alias("source_uid"), F.concat(F.lit("F:"), "file_path").alias("target_uid"), F.lit("CONTAINED_BY").alias("kind"))
    files = symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("num_symbols")).select(F.concat(F.lit("F:"), "file_path").alias("uid"), F.col("file_path").alias("path"), F.lit("Rust").alias("language"), "num_symbols")
    return Graph(symbols, links.unionByName(contained), files)


#: The same graph as SQL: tables sym, edge and community to put before a query.
GRAPH_SQL = """WITH RECURSIVE sym AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR(20)) AS uid, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR(20)) AS name,
    replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR(20)) AS qualified_name,
    CASE WHEN p_size % 2 = 0 THEN 'Function' ELSE 'Method' END AS kind,
    'part/' || replace(p_brand, '#', '') || '/' || lower(replace(p_type, ' ', '_')) || '.rs' AS file_path,
    CAST(p_size * 10 AS BIGINT) AS start_line, CAST(p_size * 10 + 9 AS BIGINT) AS end_line FROM part
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR(20)), replace(s_name, '#', '_'), 'supplier.' || replace(s_name, '#', '_'), 'Class',
    'supplier/n' || CAST(s_nationkey AS VARCHAR(20)) || '/lib.rs', CAST(s_suppkey % 40 * 10 AS BIGINT), CAST(s_suppkey % 40 * 10 + 9 AS BIGINT) FROM supplier
  UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR(20)), replace(c_name, '#', '_'), lower(c_mktsegment) || '.' || replace(c_name, '#', '_'), 'Function',
    'customer/' || lower(c_mktsegment) || '/n' || CAST(c_nationkey AS VARCHAR(20)) || '.rs', CAST(c_custkey % 40 * 10 AS BIGINT), CAST(c_custkey % 40 * 10 + 9 AS BIGINT) FROM customer
), lo AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), edge AS (
  SELECT DISTINCT 'P' || CAST(l_partkey AS VARCHAR(20)) AS src, 'S' || CAST(l_suppkey AS VARCHAR(20)) AS dst, 'CALLS' AS kind FROM lo WHERE l_quantity >= 49 AND l_orderkey % 3 = 0
  UNION ALL SELECT DISTINCT 'S' || CAST(l_suppkey AS VARCHAR(20)), 'C' || CAST(o_custkey AS VARCHAR(20)), 'CALLS' FROM lo WHERE l_quantity >= 49 AND l_orderkey % 3 = 1
  UNION ALL SELECT DISTINCT 'C' || CAST(o_custkey AS VARCHAR(20)), 'P' || CAST(l_partkey AS VARCHAR(20)), 'CALLS' FROM lo WHERE l_quantity >= 49 AND l_orderkey % 3 = 2
  UNION ALL SELECT DISTINCT 'P' || CAST(l_partkey AS VARCHAR(20)), 'S' || CAST(l_suppkey AS VARCHAR(20)), 'IMPORTS' FROM lo WHERE l_quantity = 48 AND l_orderkey % 2 = 0
  UNION ALL SELECT DISTINCT 'C' || CAST(o_custkey AS VARCHAR(20)), 'P' || CAST(l_partkey AS VARCHAR(20)), 'IMPORTS' FROM lo WHERE l_quantity = 48 AND l_orderkey % 2 = 1
  UNION ALL SELECT uid, 'F:' || file_path, 'CONTAINED_BY' FROM sym
), link AS (SELECT e.* FROM edge e JOIN sym a ON a.uid = e.src JOIN sym b ON b.uid = e.dst
), community AS (SELECT uid, split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS community FROM sym
)"""


def with_graph(sql: str, *ctes: str) -> str:
    """A query over the derived graph's tables, with further tables before it."""
    return GRAPH_SQL + "".join(f", {c}" for c in ctes) + " " + sql
