"""Queries of iterative analytics, changes, sources, exports, storage and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .graph import derived, table, with_graph
from .operators import analytics as A
from .operators import builders, catalog, changes, exports
from .operators import iterative as I
from .queries import query
from .sources import content, files
from .streaming import events as S

# --- iterative -------------------------------------------------------------------------------------


@query(with_graph("SELECT a AS node, min(b) AS component FROM (SELECT x.a, x.b FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a) GROUP BY a HAVING count(*) > 1", "walk(a, b) AS (SELECT src, src FROM link WHERE kind = 'CALLS' UNION SELECT a, dst FROM walk JOIN link ON src = b AND kind = 'CALLS')"))
def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.strong_components(derived(spark, sf_dir).inner("CALLS"))


@query(with_graph("SELECT component, count(*) AS size, count(DISTINCT file_path) AS files FROM (SELECT a AS node, min(b) AS component FROM (SELECT x.a, x.b FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a) GROUP BY a HAVING count(*) > 1) JOIN sym ON uid = node GROUP BY component", "walk(a, b) AS (SELECT src, src FROM link WHERE kind IN ('CALLS', 'IMPORTS') UNION SELECT a, dst FROM walk JOIN link ON src = b AND kind IN ('CALLS', 'IMPORTS'))"))
def circular_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cycles(derived(spark, sf_dir))


@query()
def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.eigenvector(A.merged_weights(derived(spark, sf_dir)))


@query()
def betweenness_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.shortest_path_centralities(A.merged_weights(derived(spark, sf_dir)))


@query()
def communities_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.graph_communities(derived(spark, sf_dir))


TREE = """tree(entry, uid, path) AS (SELECT DISTINCT src, src, [src] FROM link WHERE kind = 'CALLS' AND src NOT IN (SELECT dst FROM link WHERE kind = 'CALLS')
UNION ALL SELECT entry, dst, list_append(path, dst) FROM tree JOIN link ON src = uid AND kind = 'CALLS' WHERE len(path) < 10 AND NOT list_contains(path, dst)),
steps AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY path) - 1 AS ordinal, count(*) OVER (PARTITION BY entry) AS n FROM tree)"""


@query(with_graph("SELECT entry, CAST(ordinal AS INTEGER) AS ordinal, CAST(len(path) - 1 AS BIGINT) AS depth, CASE WHEN len(path) > 1 THEN path[-2] END AS parent, uid FROM steps WHERE n > 1 AND ordinal < 100", TREE))
def process_tree_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.process_steps(derived(spark, sf_dir))


@query(with_graph("SELECT entry, count(*) AS steps FROM steps JOIN sym USING (uid) WHERE n > 1 AND ordinal < 100 GROUP BY entry HAVING count(*) >= 3 AND bool_or(contains(lower(name), 'supplier'))", TREE))
def process_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return I.process_filter(I.process_steps(g), g.symbols, "Supplier", 3)


# --- changes ---------------------------------------------------------------------------------------

DIFF = """diff --git a/lib.rs b/lib.rs
--- a/supplier/n1/lib.rs
+++ b/supplier/n1/lib.rs
@@ -10,3 +15,40 @@ fn a
+x
@@ -90 +120,0 @@
@@ -200 +205 @@
--- /dev/null
+++ b/supplier/n2/lib.rs
@@ -0,0 +1,9 @@
--- a/supplier/n3/lib.rs
+++ /dev/null
@@ -1,9 +0,0 @@
--- a/n4.rs
+++ b/n4.rs
@@ -1,5 +1,400 @@"""
HUNKS = [("d", "supplier/n1/lib.rs", "modified", 15, 54), ("d", "supplier/n1/lib.rs", "modified", 205, 205), ("d", "supplier/n2/lib.rs", "added", None, None), ("d", "supplier/n3/lib.rs", "deleted", None, None), ("d", "n4.rs", "modified", 1, 400)]
HUNKS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{p}', '{s}', {'CAST(NULL AS BIGINT)' if a is None else f'CAST({a} AS BIGINT)'}, {'CAST(NULL AS BIGINT)' if b is None else f'CAST({b} AS BIGINT)'})" for d, p, s, a, b in HUNKS) + ") h(diff, file_path, status, \"start\", \"end\")"
CHANGED = f"""hunks AS ({HUNKS_SQL}), changed AS (SELECT DISTINCT uid FROM sym JOIN hunks h ON h.file_path = sym.file_path OR (suffix(sym.file_path, '/' || h.file_path) AND h.file_path NOT IN (SELECT file_path FROM sym))
WHERE h.status <> 'modified' OR (h."start" <= end_line AND h."end" >= start_line))"""
IMPACT = """both_ AS (SELECT src, dst FROM edge WHERE kind IN ('CALLS', 'IMPORTS') UNION SELECT dst, src FROM edge WHERE kind IN ('CALLS', 'IMPORTS')),
walk(uid, depth) AS (SELECT uid, CAST(0 AS BIGINT) FROM changed UNION SELECT dst, depth + 1 FROM walk JOIN both_ ON src = uid WHERE depth < 2), reached AS (SELECT uid, min(depth) AS depth FROM walk JOIN sym USING (uid) GROUP BY uid)"""


def diff(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("d", i, x) for i, x in enumerate(DIFF.split("\n"))], "diff string, line_no int, line string")


@query(HUNKS_SQL)
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff_hunks(diff(spark))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changed_symbols(changes.diff_hunks(diff(spark)), derived(spark, sf_dir).symbols)


@query(with_graph("SELECT uid FROM changed", CHANGED))
def impact_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir)


@query(with_graph("SELECT uid, depth FROM reached", CHANGED, IMPACT))
def impact_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.impact(derived(spark, sf_dir), changed(spark, sf_dir))


@query(with_graph("SELECT direct, indirect, callers, files, round(least(direct + indirect * 0.5::DOUBLE + callers * 0.3::DOUBLE + files * 0.2::DOUBLE, 50) / 50 * 10, 2) AS risk FROM (SELECT count(*) FILTER (WHERE depth = 0) AS direct, count(*) FILTER (WHERE depth > 0) AS indirect, count(DISTINCT file_path) AS files, (SELECT count(*) FROM edge WHERE kind = 'CALLS' AND dst IN (SELECT uid FROM changed)) AS callers FROM reached JOIN sym USING (uid))", CHANGED, IMPACT))
def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.impact_risk(derived(spark, sf_dir), changed(spark, sf_dir))


@query(with_graph("SELECT uid, role, community FROM (SELECT uid, 'changed' AS role FROM changed UNION SELECT src, 'caller' FROM link JOIN changed ON uid = dst WHERE kind = 'CALLS' UNION SELECT dst, 'callee' FROM link JOIN changed ON uid = src WHERE kind = 'CALLS') JOIN community USING (uid)", CHANGED))
def review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return changes.review_context(g, changed(spark, sf_dir), A.path_community(g))


SLICE = """{n}_walk(uid, depth) AS (SELECT uid, CAST(0 AS BIGINT) FROM sym WHERE kind = 'Class' AND start_line = {line} UNION SELECT o, depth + 1 FROM {n}_walk JOIN (SELECT src AS s, dst AS o FROM edge WHERE kind = 'CALLS' UNION SELECT dst, src FROM edge WHERE kind = 'CALLS') ON s = uid WHERE depth < 2),
{n} AS (SELECT uid, min(depth) AS depth FROM {n}_walk JOIN sym USING (uid) GROUP BY uid ORDER BY min(depth), uid LIMIT 50)"""


def intent(spark: SparkSession, sf_dir: str, line: int) -> DataFrame:
    g = derived(spark, sf_dir)
    return changes.intent_slice(g, g.symbols.where(f"kind = 'Class' AND start_line = {line}").select("uid"))


@query(with_graph("SELECT uid, depth FROM a", SLICE.format(n="a", line=10)))
def intent_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent(spark, sf_dir, 10)


DIFFERENT = "different AS (SELECT name, CASE WHEN s AND t THEN 'matched' WHEN s THEN 'source_only' ELSE 'target_only' END AS status FROM (SELECT DISTINCT name, true AS s FROM a JOIN sym USING (uid)) FULL JOIN (SELECT DISTINCT name, true AS t FROM b JOIN sym USING (uid)) USING (name))"


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = derived(spark, sf_dir).symbols.select("uid", "name")
    return changes.differentiate_by_name(*[intent(spark, sf_dir, n).join(names, "uid") for n in (10, 20)])


@query(with_graph("SELECT name, status FROM different", SLICE.format(n="a", line=10), SLICE.format(n="b", line=20), DIFFERENT))
def differentiate_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(spark, sf_dir)


@query(with_graph("SELECT action, n, CASE WHEN n <= 5 THEN 'small' WHEN n <= 15 THEN 'medium' WHEN n <= 40 THEN 'large' ELSE 'very_large' END AS effort FROM (SELECT CASE status WHEN 'matched' THEN 'adapt' WHEN 'source_only' THEN 'create' ELSE 'remove' END AS action, count(*) AS n FROM different GROUP BY 1)", SLICE.format(n="a", line=10), SLICE.format(n="b", line=20), DIFFERENT))
def adaptation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.adaptation_plan(differences(spark, sf_dir))


@query("SELECT 'd' || CAST(doc_id AS VARCHAR) AS file_path, i AS line, l AS before, regexp_replace(l, '\\bthe\\b', 'THE', 'g') AS after FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(l, '\\bthe\\b')")
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renamed(table(spark, sf_dir, "documents"))


def renamed(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.concat(F.lit("d"), "doc_id").alias("file_path"), F.col("text").alias("content"))
    symbols = docs.select(F.col("file_path").alias("uid"), F.when(F.col("file_path") == "d0", "the").otherwise("x").alias("name"), "file_path")
    edges = docs.select(F.col("file_path").alias("source_uid"), F.lit("d0").alias("target_uid"), F.lit("CALLS").alias("kind"))
    plan = A.rename_plan(docs, symbols, edges, "the", "THE")
    return plan.select("file_path", F.col("line").cast("long").alias("line"), "before", "after")


# --- builders, sources, functions -----------------------------------------------------------------


@query(with_graph("SELECT uid AS source_uid, 'F:' || file_path AS target_uid, 'CONTAINED_BY' AS kind FROM sym"))
def contained_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.contained_by(derived(spark, sf_dir).symbols)


@query(with_graph("SELECT s.uid AS source_uid, o.uid AS target_uid, 'MEMBER_OF' AS kind FROM sym s JOIN (SELECT file_path, CASE WHEN uid LIKE '%1' THEN kind ELSE name END AS parent, arg_max(uid, (start_line, uid)) AS uid FROM sym GROUP BY 1, 2) o ON o.file_path = s.file_path AND o.parent = s.kind WHERE s.uid <> o.uid"))
def member_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir).symbols
    named = s.withColumn("name", F.when(F.col("uid").endswith("1"), F.col("kind")).otherwise(F.col("name")))
    return builders.member_of(named.withColumn("qualified_name", F.concat("kind", F.lit("."), "name")))


@query(with_graph("SELECT DISTINCT c.caller AS source_uid, coalesce(q.uid, n.uid) AS target_uid, 'CALLS' AS kind FROM (SELECT src AS caller, CASE WHEN length(dst) % 2 = 0 THEN qualified_name ELSE name END AS target FROM link JOIN sym ON uid = dst WHERE link.kind = 'CALLS' UNION ALL SELECT src, 'nothing' FROM link) c LEFT JOIN (SELECT qualified_name AS target, arg_max(uid, (file_path, start_line, uid)) AS uid FROM sym GROUP BY 1) q USING (target) LEFT JOIN (SELECT name AS target, arg_max(uid, (file_path, start_line, uid)) AS uid FROM sym GROUP BY 1) n USING (target) WHERE coalesce(q.uid, n.uid) IS NOT NULL"))
def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    names = g.symbols.select(F.col("uid").alias("dst"), F.when(F.length("uid") % 2 == 0, F.col("qualified_name")).otherwise(F.col("name")).alias("target"))
    calls = g.inner("CALLS").join(names, "dst").select(F.col("src").alias("caller_uid"), "target")
    lost = g.inner("CALLS", "IMPORTS", "CONTAINED_BY").select(F.col("src").alias("caller_uid"), F.lit("nothing").alias("target"))
    return builders.resolved_calls(calls.unionByName(lost), g.symbols)


MARKDOWN = "'# A' || CAST(doc_id AS VARCHAR) || chr(10) || text || chr(10) || '## ' || lang || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '### ' || source || chr(10) || 'see [x](../y.md), [z](#z), [w](http://w.org)' || chr(10) || '## End'"


def markdown(documents: DataFrame) -> DataFrame:
    n = F.lit("\n")
    return documents.select(F.concat(F.lit("D"), "doc_id").alias("uid"), F.concat(F.lit("# A"), "doc_id", n, "text", F.lit("\n## "), "lang", F.lit("\n```\n# no heading\n```\n### "), "source", F.lit("\nsee [x](../y.md), [z](#z), [w](http://w.org)\n## End")).alias("content"))


@query(f"""WITH l AS (SELECT 'D' || CAST(doc_id AS VARCHAR) AS uid, unnest(string_split({MARKDOWN}, chr(10))) AS line, generate_subscripts(string_split({MARKDOWN}, chr(10)), 1) AS i, len(string_split({MARKDOWN}, chr(10))) AS n FROM documents),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY i) % 2 AS o FROM l),
h AS (SELECT uid, i, n, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_replace(line, '^#+\\s+', '')) AS title FROM f WHERE o = 0 AND regexp_matches(line, '^#{{1,6}}\\s+\\S'))
SELECT uid, title, CAST(level AS INTEGER) AS level, CAST(i AS INTEGER) AS start_line, CAST(coalesce((SELECT min(x.i) - 1 FROM h x WHERE x.uid = h.uid AND x.i > h.i AND x.level <= h.level), n) AS INTEGER) AS end_line FROM h""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.markdown_sections(markdown(table(spark, sf_dir, "documents")))


@query("SELECT 'D' || CAST(doc_id AS VARCHAR) AS uid, '../y.md' AS link FROM documents")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.markdown_links(markdown(table(spark, sf_dir, "documents")))


@query("SELECT event_id, concat_ws(' ', event_type, 'base', 'Public') AS text, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(table(spark, sf_dir, "events"))


def described(rows: DataFrame) -> DataFrame:
    meta = F.to_json(F.struct(F.array("event_type").alias("decorators"), F.array(F.lit("base")).alias("superclasses"), F.lit("Public").alias("visibility")))
    return rows.select("event_id", T.metadata_text(meta).alias("text"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query()
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddable(table(spark, sf_dir, "documents"))


def embeddable(rows: DataFrame) -> DataFrame:
    meta = F.to_json(F.struct(F.expr("cast(array() as array<string>)").alias("decorators")))
    return rows.select("doc_id", T.embedding_text(F.lit("Document"), F.col("source"), F.col("lang"), meta, F.col("text")).alias("text"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE vec_id % 7 <> 0) AS embedded, count(*) FILTER (WHERE vec_id % 7 = 0) AS missing FROM embeddings")
def partial_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("vector"))
    return v.agg(F.count(F.lit(1)).alias("total"), F.count("vector").alias("embedded"), F.count_if(F.col("vector").isNull()).alias("missing"))


@query("SELECT i AS rule_no, w[1] AS pattern, array_to_string(w[2:], ' ') AS owner FROM (VALUES (2, ['*.rs', '@a', '@b']), (4, ['part/', '@c'])) t(i, w)")
def owner_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ["# owners", "", "*.rs  @a @b", "lonely", "part/\t@c"]
    return files.owner_rules(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))


# --- storage, exports ------------------------------------------------------------------------------


@query(with_graph("SELECT uid, name FROM sym WHERE kind <> 'Class' OR start_line >= 100 UNION ALL SELECT uid, 'new' FROM sym WHERE kind = 'Class' AND start_line < 100 UNION ALL SELECT 'X1', 'new'"))
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir).symbols.select("uid", "name")
    new = derived(spark, sf_dir).symbols.where("kind = 'Class' AND start_line < 100").select("uid", F.lit("new").alias("name"))
    return catalog.upserted(s, new.union(spark.createDataFrame([("X1", "new")], "uid string, name string")), "uid")


@query(with_graph("SELECT src AS source_uid, dst AS target_uid, kind FROM edge WHERE NOT starts_with(src, 'S') AND NOT starts_with(dst, 'S') AND NOT starts_with(dst, 'F:supplier')"))
def delete_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    gone = g.files.where("path LIKE 'supplier/%'").select(F.col("path").alias("file_path"))
    return catalog.delete_by_file(g.symbols, g.edges, g.files, gone)[1]


@query(with_graph("""SELECT CAST(0 AS INTEGER) AS part, '' AS uid, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">' AS row UNION ALL SELECT 3, '', '</graph></graphml>'
UNION ALL SELECT 1, uid, '<node id="' || uid || '"><data key="name">' || replace(replace(name, '&', '&amp;'), '''', '&apos;') || '</data><data key="kind">' || kind || '</data></node>' FROM sym
UNION ALL SELECT 2, src || '|' || kind || '|' || dst, '<edge source="' || src || '" target="' || dst || '"><data key="kind">' || kind || '</data></edge>' FROM edge"""))
def export_graphml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.graphml(derived(spark, sf_dir))


@query(with_graph("""SELECT '    ' || a.uid || '["' || a.name || '"] --> ' || b.uid || '["' || b.name || '"]' AS row FROM edge e JOIN sym a ON a.uid = e.src JOIN sym b ON b.uid = e.dst WHERE e.kind = 'CALLS'"""))
def export_mermaid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.mermaid_flow(derived(spark, sf_dir))


@query(with_graph("SELECT 1 AS part, uid, 'CREATE (:' || kind || ' {uid: ''' || uid || ''', name: ''' || name || '''});' AS row FROM sym UNION ALL SELECT 2, src || '|' || kind || '|' || dst, 'MATCH (a {uid: ''' || src || '''}), (b {uid: ''' || dst || '''}) CREATE (a)-[:' || kind || ']->(b);' FROM edge"))
def export_script_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.create_script(derived(spark, sf_dir))


@query(with_graph("SELECT community AS page, '# ' || community || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) AS text FROM (SELECT community, '- **' || name || '** (' || kind || ') `' || file_path || '`' AS line FROM community JOIN sym USING (uid)) GROUP BY community"))
def export_wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return exports.wiki_pages(g, A.path_community(g))


# --- streams ---------------------------------------------------------------------------------------


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_stream(spark, sf_dir, "events.parquet")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS \"start\", event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drained(S.tumbling(stream(spark, sf_dir)))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("""SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drained(S.sessions(stream(spark, sf_dir)))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = S.deduplicated(stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"), "event_id", late="3650 days")
    return S.drained(twice, "append").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))
