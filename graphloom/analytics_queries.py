"""Queries of graph analytics over the derived graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, derived, table, with_graph
from .operators import analytics as A
from .operators import paths
from .queries import query


def seeds(g: Graph) -> DataFrame:
    return g.symbols.where("kind = 'Class' AND start_line = 10").select(F.col("uid").alias("seed"))


SEEDS = "(SELECT uid AS seed FROM sym WHERE kind = 'Class' AND start_line = 10)"
PLACED = "placed AS (SELECT e.*, a.community AS a, b.community AS b FROM edge e JOIN community a ON a.uid = e.src JOIN community b ON b.uid = e.dst)"
MODULES = "modules AS (SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM edge e JOIN sym a ON a.uid = e.src JOIN sym b ON b.uid = e.dst WHERE e.kind = 'IMPORTS' AND a.file_path <> b.file_path)"
COUPLING = "coupling AS (SELECT module, CAST(sum(a) AS BIGINT) AS afferent, CAST(sum(e) AS BIGINT) AS efferent, round(CAST(sum(e) AS DOUBLE) / (sum(a) + sum(e)), 6) AS instability FROM (SELECT dst AS module, 1 AS a, 0 AS e FROM modules UNION ALL SELECT src, 0, 1 FROM modules) GROUP BY module)"
DEGREES = "degrees AS (SELECT uid, CAST(coalesce(sum(i), 0) AS BIGINT) AS in_degree, CAST(coalesce(sum(o), 0) AS BIGINT) AS out_degree FROM sym LEFT JOIN (SELECT dst AS uid, 1 AS i, 0 AS o FROM edge WHERE kind = 'CALLS' UNION ALL SELECT src, 0, 1 FROM edge WHERE kind = 'CALLS') USING (uid) GROUP BY uid)"


def closure_sql(a: str, b: str) -> str:
    return with_graph("SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node HAVING min(depth) > 0", f"walk(seed, node, depth) AS (SELECT seed, seed, CAST(0 AS BIGINT) FROM {SEEDS} UNION SELECT seed, {b}, depth + 1 FROM walk JOIN edge ON {a} = node AND kind = 'CALLS' WHERE depth < 3)")


@query(closure_sql("dst", "src"))
def callers_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.callers(g := derived(spark, sf_dir), seeds(g))


@query(closure_sql("src", "dst"))
def callees_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.callees(g := derived(spark, sf_dir), seeds(g))


@query(with_graph("SELECT uid, coalesce(min(depth), 0) AS depth FROM sym LEFT JOIN walk ON node = uid GROUP BY uid", "walk(node, depth) AS (SELECT DISTINCT src, CAST(0 AS BIGINT) FROM link WHERE kind = 'CALLS' AND src NOT IN (SELECT dst FROM link WHERE kind = 'CALLS') UNION SELECT dst, depth + 1 FROM walk JOIN link ON src = node AND kind = 'CALLS' WHERE depth < 60)"))
def call_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.call_depths(derived(spark, sf_dir))


@query(with_graph("SELECT CAST(1 + min(depth) AS BIGINT) AS nodes, min(depth) AS hops FROM walk WHERE node = 'S2'", "und AS (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge)", "walk(node, depth) AS (SELECT 'S1', 0 UNION SELECT dst, depth + 1 FROM walk JOIN und ON src = node WHERE depth < 6)"))
def find_path_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return paths.find_path(g, "S1", "S2", 6).agg((F.max("step") + 1).cast("long").alias("nodes"), F.max("step").alias("hops"))


@query(with_graph("""SELECT s.uid, (SELECT string_agg(DISTINCT a.name, ',' ORDER BY a.name) FROM edge e JOIN sym a ON a.uid = e.src WHERE e.dst = s.uid AND e.kind = 'CALLS') AS callers,
  (SELECT string_agg(DISTINCT b.name, ',' ORDER BY b.name) FROM edge e JOIN sym b ON b.uid = e.dst WHERE e.src = s.uid AND e.kind = 'CALLS') AS callees FROM sym s WHERE s.kind = 'Class'"""))
def symbol_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    names = g.symbols.select(F.col("uid").alias("other"), "name")
    joined = lambda own, other, alias: g.kind("CALLS").join(names, F.col(other) == F.col("other")).groupBy(F.col(own).alias("uid")).agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias(alias))
    return g.symbols.where("kind = 'Class'").select("uid").join(joined("dst", "src", "callers"), "uid", "left").join(joined("src", "dst", "callees"), "uid", "left")


@query(with_graph("SELECT file, other, depth, direction FROM (SELECT file, other, min(depth) AS depth, 'imports' AS direction FROM fwd GROUP BY file, other UNION ALL SELECT file, other, min(depth), 'imported_by' FROM bwd GROUP BY file, other) WHERE depth > 0", MODULES, "files AS (SELECT DISTINCT file_path AS file FROM sym WHERE file_path LIKE 'supplier/n1%')", "fwd(file, other, depth) AS (SELECT file, file, CAST(0 AS BIGINT) FROM files UNION SELECT file, dst, depth + 1 FROM fwd JOIN modules ON src = other WHERE depth < 3)", "bwd(file, other, depth) AS (SELECT file, file, CAST(0 AS BIGINT) FROM files UNION SELECT file, src, depth + 1 FROM bwd JOIN modules ON dst = other WHERE depth < 3)"))
def file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return A.file_dependencies(g, g.files.where("path LIKE 'supplier/n1%'").select(F.col("path").alias("file")), 3)


@query(with_graph("SELECT section, kind, count(*) AS n FROM (SELECT 'symbols' AS section, kind FROM sym UNION ALL SELECT 'edges', kind FROM edge UNION ALL SELECT DISTINCT 'files', file_path FROM sym) WHERE section <> 'files' GROUP BY ALL UNION ALL SELECT 'files', 'Rust', count(DISTINCT file_path) FROM sym"))
def stats_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stats(derived(spark, sf_dir))


@query(with_graph("SELECT uid, in_degree, out_degree, in_degree + out_degree AS degree, in_degree + out_degree > 5 AS coupled FROM degrees ORDER BY degree DESC, uid LIMIT 25", DEGREES))
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.god_nodes(derived(spark, sf_dir), 25, 5)


@query(with_graph("SELECT uid, in_degree, out_degree, in_degree + out_degree AS degree FROM degrees", DEGREES))
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.degrees(derived(spark, sf_dir), "CALLS")


@query(with_graph("SELECT uid, name, file_path FROM sym WHERE kind IN ('Function', 'Method') AND NOT contains(name, '9') AND uid NOT IN (SELECT dst FROM edge WHERE kind = 'CALLS')"))
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dead_code(derived(spark, sf_dir), ("9",))


@query(with_graph("SELECT * FROM coupling", MODULES, COUPLING))
def module_coupling_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.module_coupling(derived(spark, sf_dir))


@query(with_graph("SELECT * FROM coupling", MODULES.replace("a.file_path", "regexp_extract(a.file_path, '^(.*)/[^/]*$', 1)").replace("b.file_path", "regexp_extract(b.file_path, '^(.*)/[^/]*$', 1)"), COUPLING))
def module_coupling_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.module_coupling(derived(spark, sf_dir), by_directory=True)


@query(with_graph("SELECT community, members, internal, CASE WHEN members < 2 THEN 1.0 ELSE round(CAST(internal AS DOUBLE) / (members * (members - 1) / 2), 6) END AS cohesion FROM (SELECT community, count(*) AS members, (SELECT count(*) FROM placed WHERE kind IN ('CALLS', 'IMPORTS') AND a = b AND a = c.community) AS internal FROM community c GROUP BY community)", PLACED))
def community_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.community_cohesion(g := derived(spark, sf_dir), A.path_community(g))


@query(with_graph("SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS edges FROM placed WHERE kind IN ('CALLS', 'IMPORTS') AND a <> b GROUP BY least(a, b), greatest(a, b)", PLACED))
def community_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.community_coupling(g := derived(spark, sf_dir), A.path_community(g))


WEIGHTS = "weights AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, CAST(sum(CASE kind WHEN 'CALLS' THEN 3 WHEN 'IMPORTS' THEN 2 ELSE 1 END) AS DOUBLE) AS weight FROM link WHERE src <> dst GROUP BY least(src, dst), greatest(src, dst))"


@query(with_graph("SELECT u, v, weight FROM weights", WEIGHTS))
def edge_merge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.merged_weights(derived(spark, sf_dir))


@query(with_graph("SELECT round(sum((weight - x.k * y.k / m2) / m2), 6) AS modularity FROM weights CROSS JOIN (SELECT 2 * sum(weight) AS m2 FROM weights) JOIN k x ON x.uid = u JOIN k y ON y.uid = v WHERE CAST(substr(u, 2) AS BIGINT) % 7 = CAST(substr(v, 2) AS BIGINT) % 7", WEIGHTS, "k AS (SELECT uid, sum(weight) AS k FROM (SELECT u AS uid, weight FROM weights UNION ALL SELECT v, weight FROM weights) GROUP BY uid)"))
def community_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return A.modularity(g, g.symbols.select("uid", F.expr("bigint(substring(uid, 2)) % 7").alias("community")))


@query(with_graph("SELECT src, dst, a, b, score FROM (SELECT *, round(1 - CAST(count(*) OVER (PARTITION BY least(a, b), greatest(a, b)) AS DOUBLE) / count(*) OVER (), 6) AS score FROM placed WHERE kind = 'CALLS' AND a <> b) WHERE score >= 0.1 ORDER BY score DESC, src, dst LIMIT 50", PLACED))
def surprising_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.surprising_connections(g := derived(spark, sf_dir), A.path_community(g))


@query(with_graph("SELECT a, b, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM placed WHERE kind IN ('CALLS', 'IMPORTS') AND a <> b GROUP BY a, b", PLACED))
def service_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.service_connections(g := derived(spark, sf_dir), A.path_community(g))


@query(with_graph("SELECT uid, count(x) AS cross FROM sym LEFT JOIN (SELECT unnest([src, dst]) AS x FROM placed WHERE kind IN ('CALLS', 'IMPORTS') AND a <> b) ON x = uid GROUP BY uid".replace("AS cross", 'AS "cross"'), PLACED))
def cross_community_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cross_edges(g := derived(spark, sf_dir), A.path_community(g))


@query(with_graph("SELECT community, CAST(rank AS INTEGER) AS rank, uid, degree FROM (SELECT community, uid, degree, row_number() OVER (PARTITION BY community ORDER BY degree DESC, uid) AS rank FROM community JOIN (SELECT uid, count(x) AS degree FROM sym LEFT JOIN (SELECT unnest([src, dst]) AS x FROM edge WHERE kind IN ('CALLS', 'IMPORTS')) ON x = uid GROUP BY uid) USING (uid)) WHERE rank <= 5"))
def community_top_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_members(g := derived(spark, sf_dir), A.path_community(g))


@query(with_graph("SELECT community, kind, n FROM (SELECT community, kind, n, row_number() OVER (PARTITION BY community ORDER BY n DESC, kind) AS r FROM (SELECT community, kind, count(*) AS n FROM community JOIN sym USING (uid) GROUP BY community, kind)) WHERE r = 1"))
def community_dominant_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dominant_kind(g := derived(spark, sf_dir), A.path_community(g))


@query(with_graph("""SELECT 'god_node' AS rule, 'Warning' AS severity, uid AS subject, CAST(in_degree + out_degree AS VARCHAR) AS detail FROM degrees WHERE in_degree + out_degree > 6
UNION ALL SELECT 'high_fan_out', 'Warning', uid, CAST(out_degree AS VARCHAR) FROM degrees WHERE out_degree > 4
UNION ALL SELECT 'unstable_dependency', 'Info', src, dst FROM modules JOIN coupling x ON x.module = src JOIN coupling y ON y.module = dst WHERE x.instability < 0.3 AND x.afferent > 0 AND y.instability > 0.7""", DEGREES, MODULES, COUPLING))
def arch_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.arch_lint(derived(spark, sf_dir), god=6, fan_out=4)


@query(with_graph("""SELECT 'untested' AS category, CASE WHEN n > 5 THEN 'high' ELSE 'medium' END AS severity, dst AS subject, n FROM (SELECT dst, count(DISTINCT src) AS n FROM edge JOIN sym ON uid = dst AND sym.kind IN ('Function', 'Method') WHERE edge.kind = 'CALLS' GROUP BY dst) WHERE n > 2 AND dst NOT IN (SELECT dst FROM edge JOIN sym ON uid = src WHERE edge.kind = 'CALLS' AND contains(lower(file_path), 'test'))
UNION ALL SELECT 'isolated', 'medium', community, n FROM sized WHERE n <= 1 AND code > 1
UNION ALL SELECT 'undocumented', CASE WHEN code > 15 THEN 'high' WHEN code > 8 THEN 'medium' ELSE 'low' END, community, code FROM sized WHERE code >= 5
UNION ALL SELECT 'single_point_of_failure', 'high', p || ' - ' || q, n FROM (SELECT least(a, b) AS p, greatest(a, b) AS q, count(*) AS n FROM placed WHERE kind = 'CALLS' AND a <> b GROUP BY 1, 2) WHERE n = 1""", PLACED, "sized AS (SELECT community, count(*) AS code, (SELECT count(*) FROM (SELECT unnest([a, b]) AS x FROM placed WHERE kind = 'CALLS' AND a <> b) WHERE x = c.community) AS n FROM community c GROUP BY community)"))
def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.knowledge_gaps(g := derived(spark, sf_dir), A.path_community(g))


@query(with_graph("""SELECT severity, category, subject, n FROM (
SELECT CASE WHEN n > 20 THEN 'high' ELSE 'medium' END AS severity, 'many_callers' AS category, dst AS subject, n FROM (SELECT dst, count(DISTINCT src) AS n FROM edge JOIN own ON uid = dst WHERE kind = 'CALLS' GROUP BY dst) WHERE n > 10
UNION ALL SELECT 'low', 'cross_directory', o.uid, count(*) FROM own o JOIN edge e ON e.src = o.uid AND e.kind = 'CALLS' JOIN sym s ON s.uid = e.dst WHERE split_part(o.file_path, '/', 1) <> split_part(s.file_path, '/', 1) GROUP BY o.uid
UNION ALL SELECT 'medium', 'large_file', file_path, count(*) FROM sym WHERE file_path IN (SELECT file_path FROM own) GROUP BY file_path HAVING count(*) > 30)
ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, category, n DESC, subject LIMIT 20""", "own AS (SELECT uid, file_path FROM sym WHERE start_line < 60)"))
def suggested_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return A.suggested_questions(g, g.symbols.where("start_line < 60").select("uid"), 20)


@query(with_graph("""SELECT s.uid, round(CAST(in_degree + out_degree AS DOUBLE) * (1 + coalesce(commits, 1) / 100.0::DOUBLE) * (0.5::DOUBLE + coalesce(instability, 0.5::DOUBLE)), 6) AS score FROM sym s JOIN degrees USING (uid)
LEFT JOIN (SELECT 'C' || CAST(user_id AS VARCHAR) AS uid, count(*) AS commits FROM events GROUP BY user_id) c ON c.uid = s.uid LEFT JOIN coupling ON module = s.file_path ORDER BY score DESC, s.uid LIMIT 20""", DEGREES, MODULES, COUPLING))
def hotspots_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    churn = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("uid")).agg(F.count(F.lit(1)).alias("commits"))
    return A.hotspots(g, A.degrees(g, "CALLS").select("uid", F.col("degree").cast("double").alias("centrality")), churn)


RULES = [(1, "*.rs", "@rust"), (2, "part/", "@parts"), (3, "**/lib.rs", "@lib"), (4, "customer/building", "@build"), (5, "part/Brand12/", "@twelve")]


@query(with_graph("""SELECT path, CASE WHEN starts_with(path, 'part/Brand12/') THEN '@twelve' WHEN starts_with(path, 'customer/building/') THEN '@build' WHEN suffix(path, '/lib.rs') THEN '@lib' WHEN starts_with(path, 'part/') THEN '@parts' ELSE '@rust' END AS owner FROM (SELECT DISTINCT file_path AS path FROM sym)"""))
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ownership(derived(spark, sf_dir).files, spark.createDataFrame(RULES, "rule_no int, pattern string, owner string"))


@query(with_graph("""SELECT operation, CASE WHEN exact IS NOT NULL THEN exact ELSE part END AS uid, CASE WHEN exact IS NOT NULL THEN 1.0 WHEN part IS NOT NULL THEN 0.7 END::DOUBLE AS confidence FROM (
SELECT operation, (SELECT min(uid) FROM sym WHERE name = operation OR name = snake) AS exact, (SELECT min(uid) FROM sym WHERE contains(lower(name), lower(operation)) OR contains(lower(name), snake)) AS part FROM ops)""", "ops AS (SELECT operation, lower(regexp_replace(operation, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM (SELECT unnest([(SELECT min(name) FROM sym WHERE kind = 'Class'), 'customer_00', 'getNothing', (SELECT min(name) FROM sym WHERE kind = 'Method')]) AS operation))"))
def contract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    firsts = g.symbols.where("kind IN ('Class', 'Method')").groupBy("kind").agg(F.min("name").alias("operation")).select("operation")
    return A.contract_links(firsts.union(spark.createDataFrame([("customer_00",), ("getNothing",)], "operation string")), g.symbols)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Of the graph without symbols whose line divides by 70, and without those whose line divides by 110."""
    g = derived(spark, sf_dir)

    def without(n: int) -> DataFrame:
        gone = g.symbols.where(f"start_line % {n} = 0").select("uid")
        edges = g.edges.join(gone, F.col("source_uid") == F.col("uid"), "left_anti").join(gone, F.col("target_uid") == F.col("uid"), "left_anti")
        return A.snapshot(Graph(g.symbols.join(gone, "uid", "left_anti"), edges, g.files))

    return without(70), without(110)


def _snapshot_sql(name: str, n: int) -> str:
    return f"""{name} AS (WITH s AS (SELECT * FROM sym WHERE start_line % {n} <> 0), gone AS (SELECT uid FROM sym WHERE start_line % {n} = 0) SELECT 'symbol' AS part, uid, kind || '  ' || qualified_name AS label FROM s
UNION ALL SELECT 'edge', src || '|' || e.kind || '|' || dst, e.kind || '  ' || coalesce(a.qualified_name, '?') || ' -> ' || coalesce(b.qualified_name, '?') FROM edge e LEFT JOIN s a ON a.uid = src LEFT JOIN s b ON b.uid = dst WHERE src NOT IN (SELECT uid FROM gone) AND dst NOT IN (SELECT uid FROM gone))"""


DIFF = "diff AS (SELECT *, 'added' AS change FROM y WHERE (part, uid) NOT IN (SELECT (part, uid) FROM x) UNION ALL SELECT *, 'removed' FROM x WHERE (part, uid) NOT IN (SELECT (part, uid) FROM y))"


@query(with_graph("SELECT part, uid, label, change FROM diff", _snapshot_sql("x", 70), _snapshot_sql("y", 110), DIFF))
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.snapshot_diff(*snapshots(spark, sf_dir))


@query(with_graph("SELECT changes, CAST(total AS BIGINT) AS total, round(greatest(0.0::DOUBLE, 100 - changes::DOUBLE / total * 100), 6) AS score FROM (SELECT count(*) AS changes FROM diff), (SELECT sum(n) AS total FROM (SELECT part, greatest((SELECT count(*) FROM x WHERE x.part = p.part), (SELECT count(*) FROM y WHERE y.part = p.part)) AS n FROM (SELECT unnest(['symbol', 'edge']) AS part) p))", _snapshot_sql("x", 70), _snapshot_sql("y", 110), DIFF))
def drift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drift(*snapshots(spark, sf_dir))


@query(with_graph("SELECT r.item AS rationale, arg_min(uid, (start_line, uid)) AS uid FROM sym s JOIN (SELECT uid AS item, file_path, start_line + 5 AS line FROM sym WHERE kind = 'Method') r ON r.file_path = s.file_path AND s.start_line > r.line GROUP BY r.item"))
def rationale_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return A.rationale_targets(g.symbols.where("kind = 'Method'").select(F.col("uid").alias("rationale"), "file_path", (F.col("start_line") + 5).alias("line")), g.symbols)


@query(with_graph("SELECT uid, count(DISTINCT hash) AS commits, arg_max(author, (ts, author)) AS last_author FROM sym JOIN (SELECT 'supplier/n' || CAST(user_id % 25 AS VARCHAR) || '/lib.rs' AS file_path, event_id % 400 AS line, event_type AS author, ts, event_id % 97 AS hash FROM events) b ON b.file_path = sym.file_path AND line BETWEEN start_line AND end_line GROUP BY uid"))
def blame_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    blame = table(spark, sf_dir, "events").selectExpr("'supplier/n' || user_id % 25 || '/lib.rs' file_path", "event_id % 400 line", "event_type author", "ts", "event_id % 97 hash")
    return A.blame_of(blame, derived(spark, sf_dir).symbols)
