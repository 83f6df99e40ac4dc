"""Queries of embeddings, indexes, reports and small functions, each with its SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vector as V
from .graph import derived, table, with_graph
from .more_queries import SLICE, intent
from .operators import analytics as A
from .operators import embedding as E
from .operators import iterative as I
from .operators import reports, service
from .operators import retrieval as R
from .queries import query
from .retrieval_queries import KNN, vector_queries, vectors


@query(f"WITH {KNN} SELECT query_id, uid, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM knn WHERE query_id <> uid AND rank <= 11) WHERE place <= 10")
def semantic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = E.neighbours(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10)
    return near.select("query_id", "uid", F.round("score", 5).alias("score"))


@query()
def hashing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return E.embedded(docs, "doc_id", "text").select("uid", "vector", "identity")


@query()
def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, centres = E.ivf_index(vectors(spark, sf_dir))
    near = E.ivf_search(index, centres, vector_queries(spark, sf_dir), probes=E.enough_probes(index, centres))
    return near.select("query_id", "uid", F.round("score", 5).alias("score"))


@query("SELECT count(*) * 10 AS wanted, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine tenths and more of the ten nearest that the scan of all vectors finds."""
    exact = R.knn(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10).select("query_id", "uid")
    found = exact.join(ann_search(spark, sf_dir).select("query_id", "uid", F.lit(1).alias("hit")), ["query_id", "uid"], "left")
    return found.agg(F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("SELECT vec_id AS uid, list_bool_or(list_transform(embedding, lambda x: x <> 0)) AND vec_id % 7 <> 0 AS known FROM embeddings")
def scan_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("uid") % 7 == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector"))
    return vectors(spark, sf_dir).select("uid", E.known_vector(blank).isNotNull().alias("known"))


@query("SELECT vec_id AS uid, CAST(i AS INTEGER) AS place, round(2 * CAST(embedding[i + 1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: 4 * CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS value FROM embeddings, range(64) t(i) WHERE i < len(embedding)")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.transform("vector", lambda x: x * 2)
    return vectors(spark, sf_dir).select("uid", F.posexplode(V.normalised(doubled)).alias("place", "value")).withColumn("value", F.round("value", 6))


@query("SELECT event_id, greatest(-1, least(1, 1 - value / 2)) AS score FROM events")
def distance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", V.distance_score(F.col("value")).alias("score"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT page_id, regexp_replace(string_split(rtrim(url, '/'), '/')[-1], '[^A-Za-z0-9_-]', '_', 'g') || '-' || left(sha256(url), 8) AS repo FROM pages")
def repo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.repo_id(F.col("url")).alias("repo"))


@query("SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2030-01-01') AS days, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = T.iso_time(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", T.age_days(F.col("ts"), F.lit("2030-01-01").cast("date")).cast("long").alias("days"), iso.alias("iso"))


@query("""WITH s AS (SELECT doc_id, text, position('the' IN text) - 1 AS p, length(text) AS n FROM documents WHERE contains(text, 'the')),
w AS (SELECT *, greatest(p - 40, 0) AS l, least(p + 43, n) AS r FROM s),
x AS (SELECT *, l - length(regexp_extract(left(text, l), '([^ \\t\\n\\x0B\\f\\r]*)$', 1)) AS a, r + length(regexp_extract(substr(text, r + 1), '^([^ \\t\\n\\x0B\\f\\r]*)', 1)) AS b FROM w)
SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || substr(text, a + 1, b - a) || CASE WHEN b < n THEN '...' ELSE '' END AS around FROM x""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the"))).withColumn("p", F.locate("the", "text") - 1)
    return found.select("doc_id", T.context_window(F.col("text"), F.col("p"), F.col("p") + 3).alias("around"))


@query("""WITH s AS (SELECT source, list(DISTINCT lang) AS langs FROM documents GROUP BY source)
SELECT a.source AS a, b.source AS b, array_to_string(list_sort(list_intersect(a.langs, b.langs)), ',') AS both FROM s a JOIN s b ON a.source < b.source WHERE list_has_any(a.langs, b.langs)""".replace("AS both", 'AS "both"'))
def languages_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    a, b = s.select(F.col("source").alias("a"), F.col("langs").alias("x")), s.select(F.col("source").alias("b"), F.col("langs").alias("y"))
    return a.join(b, (F.col("a") < F.col("b")) & F.arrays_overlap("x", "y")).select("a", "b", F.array_join(F.sort_array(F.array_intersect("x", "y")), ",").alias("both"))


DEGREE = "degree AS (SELECT uid, count(*) AS n FROM (SELECT src AS uid FROM link WHERE kind = 'CALLS' UNION ALL SELECT dst FROM link WHERE kind = 'CALLS') GROUP BY uid)"


@query(with_graph("SELECT uid, name, kind, CAST(n AS DOUBLE) AS value FROM degree JOIN sym USING (uid) ORDER BY n DESC, uid LIMIT 15", DEGREE))
def centrality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return reports.centrality_report(A.degrees(g, "CALLS").withColumnRenamed("uid", "node"), g.symbols, "degree")


@query()
def centrality_report_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return reports.centrality_report(I.shortest_path_centralities(A.merged_weights(g)), g.symbols)


@query(with_graph("""SELECT 'total' AS part, 'symbols' AS subject, CAST(count(*) AS DOUBLE) AS value FROM sym UNION ALL SELECT 'total', 'files', count(DISTINCT file_path) FROM sym UNION ALL SELECT 'total', 'edges', count(*) FROM edge
UNION ALL SELECT 'kind', kind, count(*) FROM sym GROUP BY kind UNION ALL SELECT * FROM (SELECT 'community', community, count(*) AS n FROM community GROUP BY community ORDER BY n DESC, community LIMIT 10)
UNION ALL SELECT 'god', * FROM (SELECT uid, n FROM degree ORDER BY n DESC, uid LIMIT 10)
UNION ALL SELECT 'surprising', src || '>' || dst, score FROM (SELECT src, dst, round(1 - n / (SELECT sum(n) FROM pairs), 6) AS score FROM pairs JOIN crossing USING (p, q) WHERE round(1 - n / (SELECT sum(n) FROM pairs), 6) >= 0.1 ORDER BY score DESC, src, dst LIMIT 50)""", DEGREE, "crossing AS (SELECT src, dst, least(x.community, y.community) AS p, greatest(x.community, y.community) AS q FROM link JOIN community x ON x.uid = src JOIN community y ON y.uid = dst WHERE kind = 'CALLS' AND x.community <> y.community)", "pairs AS (SELECT p, q, count(*) AS n FROM crossing GROUP BY p, q)"))
def project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return reports.project_report(g, A.path_community(g))


SIDE = "(SELECT CAST(count(DISTINCT uid) AS DOUBLE) AS symbols, CAST(count(DISTINCT kind) AS DOUBLE) AS kinds, CAST(count(DISTINCT file_path) AS DOUBLE) AS files, round(coalesce(avg(end_line - start_line + 1), 0), 6) AS lines, round(coalesce(count(DISTINCT uid) / nullif(count(DISTINCT file_path), 0), 0), 6) AS per_file FROM {n} JOIN sym USING (uid))"


@query(with_graph(f"""SELECT dimension, source, target, CASE WHEN greatest(source, target) = 0 THEN 'none' WHEN abs(source - target) / greatest(source, target) >= 0.5 THEN 'critical' WHEN abs(source - target) / greatest(source, target) >= 0.25 THEN 'notable' WHEN abs(source - target) / greatest(source, target) >= 0.1 THEN 'minor' ELSE 'none' END AS severity
FROM (UNPIVOT {SIDE.format(n='a')} ON symbols, kinds, files, lines, per_file INTO NAME dimension VALUE source) JOIN (UNPIVOT {SIDE.format(n='b')} ON symbols, kinds, files, lines, per_file INTO NAME dimension VALUE target) USING (dimension)""", SLICE.format(n="a", line=10), SLICE.format(n="b", line=20)))
def slice_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda line: intent(spark, sf_dir, line).join(derived(spark, sf_dir).symbols.select("uid", "kind", "file_path", "start_line", "end_line"), "uid")
    return reports.differing(of(10), of(20))


@query()
def similarity_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of two slices, matched by name, then by the hashed vectors of their names."""
    names = derived(spark, sf_dir).symbols.select("uid", "name", E.encode(F.concat_ws(" ", "name", "kind", "file_path")).alias("vector"))
    return E.matched(*[intent(spark, sf_dir, line).join(names, "uid").select("uid", "name", "vector") for line in (10, 20)])


@query(with_graph("SELECT uid, CASE WHEN kind = 'Class' THEN 'stored' WHEN start_line % 20 = 0 THEN 'found' ELSE community END AS community FROM sym JOIN community USING (uid)"))
def community_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    stored, found = g.symbols.where("kind = 'Class'").select("uid", F.lit("stored").alias("community")), g.symbols.where("start_line % 20 = 0").select("uid", F.lit("found").alias("community"))
    return service.community_fallback(stored, found, A.path_community(g))


SCC = "walk(a, b) AS (SELECT src, src FROM link WHERE kind IN ({kinds}) UNION SELECT a, dst FROM walk JOIN link ON src = b AND kind IN ({kinds})), scc AS (SELECT a AS node, min(b) AS component FROM (SELECT x.a, x.b FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a) GROUP BY a HAVING count(*) > 1)"


@query(with_graph("SELECT node, component FROM scc", SCC.format(kinds="'CALLS'")))
def scc_cycles_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds that spread over tasks, whatever the size."""
    return I.strong_components(derived(spark, sf_dir).inner("CALLS"), small=0)
