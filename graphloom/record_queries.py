"""Queries of stored records, re-indexing, modules, further sources and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import shared_folder
from .graph import Graph, derived, table, with_graph
from .more_queries import DIFFERENT, SLICE, differences, stream
from .operators import analytics as A
from .operators import changes, exports, modules, pictures, records, service
from .operators import retrieval as R
from .operators.catalog import Catalog
from .queries import query
from .retrieval_queries import KNN, vector_queries, vectors
from .sources import content, files, history, mailfiles
from .sources.code import code_facts
from .streaming import events as S
from .streaming import reindex


def store(spark: SparkSession) -> Catalog:
    return Catalog(spark, shared_folder(spark, "graphloom-store"))


# --- stored records --------------------------------------------------------------------------------


@query(with_graph("SELECT uid, CASE kind WHEN 'Method' THEN 'Variable' ELSE kind END AS kind, CASE WHEN kind <> 'Class' THEN '{}' END AS metadata FROM sym"))
def stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols appended in two parts, and scanned."""
    c, s = store(spark), derived(spark, sf_dir).symbols.withColumn("repo_id", F.lit("r"))
    c.append("symbols", s.where("kind = 'Class'").withColumn("metadata", F.lit("")))
    c.append("symbols", s.where("kind <> 'Class'").withColumn("kind", F.when(F.col("kind") == "Method", "Strange").otherwise(F.col("kind"))).withColumn("metadata", F.lit("{}")))
    return records.scanned(c.read("symbols", "r")).select("uid", "kind", "metadata")


@query("SELECT 'model' AS key, 'b' AS value UNION ALL SELECT 'dims', '256'")
def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = store(spark)
    for key, value in (("model", "a"), ("dims", "256"), ("model", "b")):
        c.put_meta(key, value)
    return c.read("index_meta").select("key", "value")


def two_snapshots(spark: SparkSession, sf_dir: str) -> Catalog:
    c, g = store(spark), derived(spark, sf_dir)
    records.save_snapshot(c, g, "r", "2024-05-01T10:00:00+00:00", "abc")
    records.save_snapshot(c, Graph(g.symbols.where("kind <> 'Class'"), g.edges.where("kind = 'CALLS'"), g.files), "r", "2024-05-02T10:00:00+00:00")
    return c


@query(with_graph("SELECT '2024-05-01T10-00-00p00-00' AS snapshot_id, 'abc' AS commit_sha, (SELECT count(*) FROM sym) AS symbol_count, (SELECT count(*) FROM edge) AS edge_count UNION ALL SELECT '2024-05-02T10-00-00p00-00', NULL, (SELECT count(*) FROM sym WHERE kind <> 'Class'), (SELECT count(*) FROM edge WHERE kind = 'CALLS')"))
def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.snapshots(two_snapshots(spark, sf_dir), "r").select("snapshot_id", "commit_sha", "symbol_count", "edge_count")


@query(with_graph("SELECT 'latest' AS which, src AS source_uid, dst AS target_uid, kind FROM edge WHERE kind = 'CALLS' UNION ALL SELECT 'first', src, dst, kind FROM edge"))
def snapshot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = two_snapshots(spark, sf_dir)
    found = {"latest": records.load_snapshot(c, "r"), "first": records.load_snapshot(c, "r", "2024-05-01T10-00-00p00-00")}
    rows = [x[1].select(F.lit(k).alias("which"), "source_uid", "target_uid", "kind") for k, x in found.items()]
    return rows[0].unionByName(rows[1])


@query("SELECT * FROM (VALUES ('1', 'Use tables', 'accepted', 'load,save', 't3'), ('2', 'Use files', 'proposed', '', 't2')) t(id, title, status, linked, updated_at)")
def decision_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = store(spark)
    for at, key, title, status in (("t1", "1", "Use tables", "proposed"), ("t2", "2", "Use files", "proposed"), ("t2", "1", "Use tables", "accepted")):
        records.record_decision(c, "r", key, title, status, "", at, ("load",) if key == "1" else ())
    records.link_decision(c, "r", "1", "save", "t3")
    records.link_decision(c, "r", "1", "load", "t4")  # it is there: nothing changes
    return records.decisions(c, "r").select("id", "title", "status", F.array_join("linked", ",").alias("linked"), "updated_at")


@query(with_graph("SELECT community, CASE community WHEN 'supplier/n1' THEN 'Supply' ELSE community END AS service, count(*) AS n FROM community GROUP BY community"))
def named_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = store(spark)
    for name in ("Wrong", "Supply"):
        records.map_service(c, "r", "supplier/n1", name)
    n = A.path_community(derived(spark, sf_dir)).groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return n.join(records.service_map(c, "r"), "community", "left").select("community", F.coalesce("service", "community").alias("service"), "n")


@query("SELECT s_suppkey AS team_id, s_nationkey AS owner_id FROM supplier WHERE s_nationkey = 3 OR s_suppkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def teams_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_nationkey").alias("owner_id"))
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team_id"), F.col("c_nationkey").alias("user_id"))
    return service.teams_of(own, members, 3)


@query("""WITH r AS (SELECT user_id, CAST(user_id % 120 AS BIGINT) AS age, count(*) AS n, count(*) FILTER (WHERE event_type = 'error' AND event_id % 50 = 0) AS s FROM events GROUP BY user_id)
SELECT user_id AS repo_id, CASE WHEN age > 60 THEN 'age' WHEN s > 0 THEN 'structural' WHEN n > 50 THEN 'many_changes' END AS reason FROM r""")
def stale_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    repos = e.groupBy(F.col("user_id").alias("repo_id")).agg(F.min("ts").alias("indexed_at")).withColumn("checked_at", F.expr("indexed_at + make_dt_interval(0, 0, int(repo_id % 120), 0)"))
    paths = e.select(F.col("user_id").alias("repo_id"), F.expr("if(event_type = 'error' AND event_id % 50 = 0, 'web/package.json', 'a.py')").alias("path"))
    return service.stale(repos, paths)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'rule' ELSE 'model' END AS found_by FROM documents")
def preferred_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return records.preferred(d.where("lang = 'en'").select("doc_id", F.lit("rule").alias("found_by")), d.select("doc_id", F.lit("model").alias("found_by")), "doc_id")


@query(with_graph("SELECT DISTINCT kind, 'unknown type: ' || kind AS problem FROM sym WHERE kind = 'Method'"))
def ontology_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([("Function",), ("Class",)], "name string")
    return records.ontology_problems(derived(spark, sf_dir).symbols, types)


# --- graphs ----------------------------------------------------------------------------------------


@query(with_graph("SELECT DISTINCT a.file_path, b.name AS local, b.uid FROM edge e JOIN sym a ON a.uid = e.src JOIN sym b ON b.uid = e.dst WHERE e.kind = 'IMPORTS' UNION SELECT DISTINCT file_path, 'nothing', CAST(NULL AS VARCHAR) FROM sym WHERE kind = 'Class'"))
def module_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports by module name, found again; one from each file of classes that leads nowhere."""
    g = derived(spark, sf_dir)
    s, none = g.symbols, F.lit(None).cast("string").alias("alias")
    target = s.select(F.col("uid").alias("dst"), "name", F.concat(F.lit("crate::"), F.replace(F.regexp_replace("file_path", r"\.rs$", ""), F.lit("/"), F.lit("::"))).alias("module"))
    wanted = g.kind("IMPORTS").join(s.select(F.col("uid").alias("src"), "file_path"), "src").join(target, "dst").select("file_path", "module", "name", none)
    lost = s.where("kind = 'Class'").select("file_path", F.lit("./no.where").alias("module"), F.lit("nothing").alias("name"), none)
    return modules.resolved_imports(wanted.unionByName(lost), s).select("file_path", "local", "uid").distinct()


@query(with_graph("SELECT src AS uid, dst AS target_uid, name FROM edge JOIN sym ON uid = src WHERE edge.kind = 'IMPORTS'"))
def rationale_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    notes = g.edges.where("kind = 'IMPORTS'").withColumn("kind", F.lit("RATIONALE_FOR"))
    return service.rationale_of(notes, g.symbols)


MERMAID = "regexp_replace({0}, '[^A-Za-z0-9]', '_', 'g')"


@query(with_graph(f"""SELECT 'service' AS part, '  ' || {MERMAID.format('community')} || '["' || community || ' (' || count(*) || ' symbols)"]' AS row FROM community GROUP BY community
UNION ALL SELECT 'connection', '  ' || {MERMAID.format('a')} || ' -->|' || count(*) || ' edges| ' || {MERMAID.format('b')} FROM (SELECT x.community AS a, y.community AS b FROM link JOIN community x ON x.uid = src JOIN community y ON y.uid = dst WHERE kind IN ('CALLS', 'IMPORTS') AND x.community <> y.community) GROUP BY a, b"""))
def architecture_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return pictures.architecture(g, A.path_community(g))


@query(with_graph("SELECT 'symbol' AS part, CAST(json_object('uid', uid, 'name', name, 'qualified_name', qualified_name, 'kind', kind, 'file_path', file_path, 'start_line', start_line, 'end_line', end_line) AS VARCHAR) AS row FROM sym UNION ALL SELECT 'edge', CAST(json_object('source_uid', src, 'target_uid', dst, 'kind', kind) AS VARCHAR) FROM edge"))
def export_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.json_rows(derived(spark, sf_dir))


STEPS = """tally AS (SELECT count(*) FILTER (WHERE status = 'matched') AS a, count(*) FILTER (WHERE status = 'source_only') AS c, count(*) FILTER (WHERE status = 'target_only') AS r FROM different),
part AS (SELECT 1 AS k, 'analyze' AS category, a + c + r AS n FROM tally UNION ALL SELECT 2, 'create', c FROM tally UNION ALL SELECT 3, 'adapt', a FROM tally UNION ALL SELECT 4, 'remove', r FROM tally UNION ALL SELECT 5, 'verify', 0 FROM tally),
step AS (SELECT row_number() OVER (ORDER BY k) AS ordinal, category, n FROM part WHERE n > 0 OR k IN (1, 5))"""


@query(with_graph("""SELECT ordinal, category, n, CASE WHEN ordinal = 1 THEN '' WHEN category = 'adapt' AND ordinal > 2 THEN '1,' || (ordinal - 1) ELSE CAST(ordinal - 1 AS VARCHAR) END AS needs,
CASE WHEN a + c + r <= 5 THEN 'small' WHEN a + c + r <= 15 THEN 'medium' WHEN a + c + r <= 40 THEN 'large' ELSE 'very_large' END AS effort,
concat_ws('; ', CASE WHEN r > 0 THEN 'removal may break callers outside' END, CASE WHEN c + r > a THEN 'more unmatched than matched' END) AS risks FROM step, tally""", SLICE.format(n="a", line=10), SLICE.format(n="b", line=20), DIFFERENT, STEPS))
def adaptation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.adaptation_steps(differences(spark, sf_dir))


@query(f"""WITH {KNN}, rel AS (SELECT q.vec_id AS query_id, q.label AS intent, v.vec_id AS uid FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0),
hit AS (SELECT 'ten' AS mode, * FROM knn WHERE rank <= 10 UNION ALL SELECT 'one', * FROM knn WHERE rank <= 1),
each_ AS (SELECT m.mode, query_id, intent, count(*) AS total, count(*) FILTER (WHERE rank <= 1) AS h1, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, min(rank) AS first FROM (SELECT unnest(['ten', 'one']) AS mode) m CROSS JOIN rel LEFT JOIN (SELECT mode, query_id, uid, rank FROM hit) h USING (mode, query_id, uid) GROUP BY m.mode, query_id, intent)
SELECT mode, CAST(intent AS VARCHAR) AS intent, count(*) AS queries, round(avg(h1::DOUBLE / total), 6) AS recall_at_1, round(avg(h5::DOUBLE / total), 6) AS recall_at_5, round(avg(h10::DOUBLE / total), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM each_ GROUP BY mode, intent""")
def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, near = vectors(spark, sf_dir), R.knn(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10).select("query_id", "uid", "rank")
    relevant = v.where("uid % 100 = 0").select(F.col("uid").alias("query_id"), F.col("label").alias("intent")).join(v.select("uid", F.col("label").alias("intent")), "intent").select("query_id", F.col("intent").cast("string").alias("intent"), "uid")
    ways = near.withColumn("mode", F.lit("ten")).unionByName(near.where("rank <= 1").withColumn("mode", F.lit("one")))
    return R.golden_set(ways, relevant, ("ten", "one"))


# --- sources ---------------------------------------------------------------------------------------


def python_files(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """A file for each customer, whose function calls that of the customer some places on."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "'p/c' || c_custkey || '.py' path", "'Python' language", f"'def f_' || c_custkey || '():\\n    return f_' || (c_custkey + {step}) || '()\\n' content")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 7 <> 0)
SELECT 'f_' || a.k AS caller, 'f_' || b.k AS callee FROM c a JOIN c b ON b.k = a.k + CASE WHEN a.k % 3 = 0 THEN 2 ELSE 1 END""")
def reindexed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls after a third of the files changed and some went."""
    c = store(spark)
    reindex.index(c, python_files(spark, sf_dir, 1).drop("c_custkey"), "r")
    gone = python_files(spark, sf_dir, 1).where("c_custkey % 7 = 0 AND c_custkey % 3 <> 0").select("path")
    reindex.reindex(c, python_files(spark, sf_dir, 2).where("c_custkey % 3 = 0").drop("c_custkey"), gone, "r")
    s = c.read("symbols", "r").select("uid", "name")
    calls = c.read("relationships", "r").where("kind = 'CALLS'")
    return calls.join(s.toDF("source_uid", "caller"), "source_uid").join(s.toDF("target_uid", "callee"), "target_uid").select("caller", "callee")


@query("""SELECT 's' || s_suppkey || '.zig' AS file_path, fact, name, target, line FROM (SELECT s_suppkey, unnest([{'fact': 'symbol', 'name': 'f_' || s_suppkey, 'target': NULL, 'line': 2}, {'fact': 'import', 'name': NULL, 'target': 'std', 'line': 1}, {'fact': 'call', 'name': NULL, 'target': 'g_' || s_nationkey, 'line': 3}], recursive := true) FROM supplier)""")
def rule_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a language that only the rule language knows."""
    code = table(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey || '.zig' path", "'Zig' language", "'const std = @import(\"std\");\\npub fn f_' || s_suppkey || '() void {\\n    g_' || s_nationkey || '();\\n}\\n' content")
    return code_facts(code).select("file_path", "fact", "name", "target", F.coalesce("line", "start_line").alias("line"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Python' WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'Markdown' WHEN 3 THEN 'Zig' END AS language, doc_id % 5 = 1 AS generated, doc_id % 2 = 1 AS skipped,
CASE WHEN strlen(text) > 524288 THEN 'too_large' WHEN text IS NULL THEN 'not_utf8' WHEN list_bool_or(list_transform(string_split(text, chr(10)), lambda x: strlen(x) > 5120)) THEN 'long_line' END AS problem FROM documents""")
def file_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("path", F.expr("if(doc_id % 2 = 1, 'a/node_modules/', 'a/') || doc_id || element_at(array('.py', '.min.js', '.md', '.zig', '.xyz'), int(doc_id % 5) + 1)"))
    path = F.col("path")
    return d.select("doc_id", files.language_of(path).alias("language"), files.generated(path).alias("generated"), files.skipped(path).alias("skipped"), files.problem(F.col("text").cast("binary")).alias("problem"))


@query("""SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(list_transform(l, lambda x: left(sha256(CAST(length(x) % 3 AS VARCHAR)), 40))) AS hash, unnest(list_transform(l, lambda x: 'A' || CAST(length(x) % 3 AS VARCHAR))) AS author, unnest(list_transform(l, lambda x: 1000 + length(x) % 3)) AS ts FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def blame_porcelain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as three commits' work, whose author stands at the first line of each."""
    kinds = "transform(split(text, '\\n'), x -> char_length(x) % 3)"
    block = "left(sha2(string(k[i]), 256), 40) || ' 1 ' || (i + 1) || if(array_position(k, k[i]) = i + 1, '\\nauthor A' || k[i] || '\\nauthor-time ' || (1000 + k[i]), '') || '\\n\\t' || l || '\\n'"
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{kinds} k").selectExpr("doc_id file_path", f"array_join(transform(split(text, '\\n'), (l, i) -> {block}), '') text")
    return history.blame_lines(d).withColumnRenamed("file_path", "doc_id")


@query("""SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS uid, cell, kind, source, first_line FROM (SELECT conv_id, turn, unnest([{'cell': 0, 'kind': 'markdown', 'source': '# ' || role || chr(10) || 'said', 'first_line': 1}, {'cell': 1, 'kind': 'code', 'source': text, 'first_line': 3}], recursive := true) FROM conversations)""")
def notebook_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = "to_json(struct(array(struct('markdown' AS cell_type, array('# ' || role || '\\n', 'said') AS source), struct('code' AS cell_type, array(text) AS source)) AS cells))"
    books = table(spark, sf_dir, "conversations").selectExpr("conv_id || ':' || turn uid", f"{cells} content")
    return content.notebook_cells(books)


@query("""SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS path, 'Turn ' || CAST(turn AS VARCHAR) AS subject, role || '@example.org' AS sender, CASE WHEN turn > 0 THEN CAST(turn - 1 AS VARCHAR) || '@c' END AS in_reply_to, text AS body FROM conversations""")
def mail_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "'From: ' || role || ' <' || role || '@example.org>\\nSubject: Turn ' || turn || '\\nMessage-ID: <' || turn || '@c>\\n' || if(turn > 0, 'In-Reply-To: <' || (turn - 1) || '@c>\\n', '') || 'Content-Type: text/plain; charset=utf-8\\nContent-Transfer-Encoding: 8bit\\n\\n'"
    raw = table(spark, sf_dir, "conversations").selectExpr("conv_id || ':' || turn path", f"binary({head} || text) content")
    return mailfiles.messages(raw).select("path", "subject", "sender", "in_reply_to", "body")


# --- streams ---------------------------------------------------------------------------------------


@query("SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.followed(stream(spark, sf_dir), "click", "purchase", "6 hours"), "append")


@query("SELECT user_id, count(*) AS n, arg_max(event_id, ts) AS last_id FROM events GROUP BY user_id")
def stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drained(S.running(stream(spark, sf_dir)), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("last_id", "n").alias("last_id"))
