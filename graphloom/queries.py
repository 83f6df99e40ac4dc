"""The registered queries of the graph and retrieval operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .graph import derived, with_graph
from .plans.planner import cypher

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if that can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def pattern(name: str, text: str, sql: str, *ctes: str) -> None:
    """Registers a pattern query over the derived graph."""
    QUERIES[name] = lambda spark, sf_dir: cypher(derived(spark, sf_dir), text)
    ORACLES[name] = with_graph(sql, *ctes)


PAIR = "FROM edge e JOIN sym a ON a.uid = e.src JOIN sym b ON b.uid = e.dst"
FLAGSHIP = "MATCH (a)-[:CALLS]->(b) WHERE b.kind = 'Class' RETURN a.name AS caller, b.name AS callee ORDER BY caller LIMIT 20"

pattern("flagship", FLAGSHIP, f"SELECT a.name AS caller, b.name AS callee {PAIR} WHERE e.kind = 'CALLS' AND b.kind = 'Class' ORDER BY caller, callee LIMIT 20")
pattern("match_scan", "MATCH (n:CodeSymbol) RETURN n.uid AS uid, n.name AS name, n.kind AS kind, n.nothing AS nothing", "SELECT uid, name, kind, CAST(NULL AS VARCHAR) AS nothing FROM sym")
pattern("match_file", "MATCH (s)-[:CONTAINED_BY]->(f:File) WHERE f.num_symbols > 3 RETURN s.uid AS uid, f.path AS path", "SELECT uid, file_path AS path FROM sym WHERE file_path IN (SELECT file_path FROM sym GROUP BY 1 HAVING count(*) > 3)")
pattern("match_edge", "MATCH (a)-[r:CALLS]->(b) RETURN a.uid AS a, b.uid AS b, r.kind AS kind", f"SELECT e.src AS a, e.dst AS b, e.kind {PAIR} WHERE e.kind = 'CALLS'")
pattern("match_edge_left", "MATCH (a)<-[:IMPORTS]-(b) RETURN a.uid AS a, b.uid AS b", f"SELECT e.dst AS a, e.src AS b {PAIR} WHERE e.kind = 'IMPORTS'")
pattern("match_edge_both", "MATCH (a)-[:CALLS|IMPORTS]-(b) RETURN a.uid AS a, b.uid AS b", "SELECT src AS a, dst AS b FROM link UNION ALL SELECT dst, src FROM link")
pattern("match_cross", "MATCH (a:CodeSymbol), (b:CodeSymbol) WHERE a.kind = 'Class' AND b.start_line = 10 AND b.kind = 'Class' RETURN a.uid AS a, b.uid AS b", "SELECT a.uid AS a, b.uid AS b FROM sym a, sym b WHERE a.kind = 'Class' AND b.start_line = 10 AND b.kind = 'Class'")
pattern("match_multihop", "MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c) RETURN a.uid AS a, b.uid AS b, c.uid AS c", "SELECT x.src AS a, x.dst AS b, y.dst AS c FROM link x JOIN link y ON x.dst = y.src WHERE x.kind = 'CALLS' AND y.kind = 'CALLS'")
pattern("match_shared_var", "MATCH (a)-[:CALLS]->(b), (c)-[:IMPORTS]->(b) RETURN a.uid AS a, b.uid AS b, c.uid AS c", "SELECT calls.src AS a, dst AS b, imports.src AS c FROM calls JOIN imports USING (dst)", "calls AS MATERIALIZED (SELECT src, dst FROM link WHERE kind = 'CALLS'), imports AS MATERIALIZED (SELECT src, dst FROM link WHERE kind = 'IMPORTS')")
pattern("match_var_length", "MATCH (a)-[:CALLS*1..2]->(b) WHERE a.kind = 'Class' RETURN a.uid AS a, b.uid AS b", "SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM edge WHERE kind = 'CALLS' UNION ALL SELECT x.src, y.dst FROM edge x JOIN edge y ON x.dst = y.src WHERE x.kind = 'CALLS' AND y.kind = 'CALLS') p JOIN sym s ON s.uid = a AND s.kind = 'Class' JOIN sym t ON t.uid = b")
pattern("match_property_map", "MATCH (n:CodeSymbol {kind: 'Class', start_line: 20}) RETURN n.uid AS uid", "SELECT uid FROM sym WHERE kind = 'Class' AND start_line = 20")
pattern("where_compare", "MATCH (n) WHERE n.start_line >= 100 AND n.start_line < 300 AND n.name > 'C' AND n.kind <> 'Method' RETURN n.uid AS uid", "SELECT uid FROM sym WHERE start_line >= 100 AND start_line < 300 AND name > 'C' AND kind <> 'Method'")
pattern("where_bool", "MATCH (n) WHERE NOT (n.kind = 'Function' OR n.kind IN ['Method', 'Enum']) OR n.start_line = 30 RETURN n.uid AS uid", "SELECT uid FROM sym WHERE NOT (kind = 'Function' OR kind IN ('Method', 'Enum')) OR start_line = 30")
pattern("where_contains", "MATCH (n) WHERE n.name CONTAINS 'OLD' OR n.file_path STARTS WITH 'supplier/n1' OR n.name ENDS WITH '77' RETURN n.uid AS uid", "SELECT uid FROM sym WHERE contains(lower(name), 'old') OR starts_with(file_path, 'supplier/n1') OR suffix(name, '77')")
pattern("where_null", "MATCH (n) WHERE n.nothing IS NULL AND n.name IS NOT NULL AND n.kind = 'Class' RETURN n.uid AS uid", "SELECT uid FROM sym WHERE kind = 'Class'")
pattern("scalar_case", "MATCH (n) RETURN n.uid AS uid, toUpper(n.name) AS up, toLower(n.qualified_name) AS low, unknown(n.name) AS none", "SELECT uid, upper(name) AS up, lower(qualified_name) AS low, CAST(NULL AS VARCHAR) AS none FROM sym")
pattern("agg_global", "MATCH (n) WHERE n.kind <> 'Class' RETURN count(*) AS n, count(DISTINCT n.kind) AS kinds, sum(n.start_line) AS total, avg(n.start_line) AS mean, min(n.name) AS first, max(n.end_line) AS last", "SELECT count(*) AS n, count(DISTINCT kind) AS kinds, CAST(sum(start_line) AS BIGINT) AS total, avg(start_line) AS mean, min(name) AS first, max(end_line) AS last FROM sym WHERE kind <> 'Class'")
pattern("agg_grouped", "MATCH (a)-[:CALLS]->(b) RETURN a.kind AS a_kind, b.kind AS b_kind, count(*) AS n, count(DISTINCT a) AS callers", f"SELECT a.kind AS a_kind, b.kind AS b_kind, count(*) AS n, count(DISTINCT a.uid) AS callers {PAIR} WHERE e.kind = 'CALLS' GROUP BY a.kind, b.kind")
QUERIES["agg_collect_sorted"] = lambda spark, sf_dir: cypher(derived(spark, sf_dir), "MATCH (a)-[:CALLS]->(b) RETURN b.uid AS uid, collect(a.uid) AS callers").selectExpr("uid", "array_join(callers, ',') callers")
ORACLES["agg_collect_sorted"] = with_graph(f"SELECT b.uid, string_agg(a.uid, ',' ORDER BY a.uid) AS callers {PAIR} WHERE e.kind = 'CALLS' GROUP BY b.uid")
pattern("order_skip_limit", "MATCH (n) RETURN n.uid AS uid, n.name AS name ORDER BY n.start_line DESC, n.name SKIP 7 LIMIT 25", "SELECT uid, name FROM sym ORDER BY start_line DESC, name, uid LIMIT 25 OFFSET 7")
pattern("distinct_with", "MATCH (a)-[:CALLS]->(b) WITH a, count(*) AS n WHERE n > 2 RETURN DISTINCT a.kind AS kind, n AS n", f"SELECT DISTINCT kind, n FROM (SELECT a.uid, a.kind, count(*) AS n {PAIR} WHERE e.kind = 'CALLS' GROUP BY a.uid, a.kind) WHERE n > 2")

#: Classes with few symbols around them, as ends of path searches.
ENDS = "a.kind = 'Class' AND a.start_line = 10 AND b.kind = 'Class' AND b.start_line = 20"
WALKS = """und AS (SELECT src, dst, src || '>' || dst || kind AS e FROM link UNION ALL SELECT dst, src, src || '>' || dst || kind FROM link),
ends AS (SELECT a.uid AS a, b.uid AS b FROM sym a, sym b WHERE a.kind = 'Class' AND a.start_line = 10 AND b.kind = 'Class' AND b.start_line = 20),
walk(a, node, depth) AS (SELECT DISTINCT a, a, 0 FROM ends UNION SELECT a, dst, depth + 1 FROM walk JOIN und ON src = node WHERE depth < {depth})"""
SIMPLE = """simple(a, b, node, nodes) AS (SELECT a, b, a, [a] FROM ends UNION ALL SELECT a, b, dst, list_append(nodes, dst) FROM simple JOIN und ON src = node WHERE node <> b AND len(nodes) <= {depth} AND NOT list_contains(nodes, dst))"""
pattern("shortest_path_len", f"MATCH p = shortestPath((a)-[*..4]->(b)) WHERE {ENDS} RETURN a.uid AS a, b.uid AS b, length(p) AS hops", "")
ORACLES["shortest_path_len"] = with_graph("SELECT a, b, hops FROM ends LEFT JOIN (SELECT a, node AS b, min(depth) AS hops FROM walk GROUP BY a, node) USING (a, b)", WALKS.format(depth=4))
pattern("all_paths_count", f"MATCH p = allPaths((a)-[*..4]->(b)) WHERE {ENDS} RETURN a.uid AS a, b.uid AS b, count(p) AS n", "")
ORACLES["all_paths_count"] = with_graph("SELECT a, b, count(*) AS n FROM simple WHERE node = b GROUP BY a, b", WALKS.format(depth=4), SIMPLE.format(depth=4))
pattern("any_path_exists", f"MATCH p = anyPath((a)-[*..3]->(b)) WHERE {ENDS} RETURN a.uid AS a, b.uid AS b, length(p) AS hops", "")
ORACLES["any_path_exists"] = with_graph("SELECT a, node AS b, min(depth) AS hops FROM walk JOIN ends e USING (a) WHERE node = e.b GROUP BY a, node", WALKS.format(depth=3))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


def queries() -> dict[str, Query]:
    from . import analytics_queries, index_queries, more_queries, record_queries, retrieval_queries, service_queries  # noqa: F401  they register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
