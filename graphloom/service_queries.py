"""Queries of lookups, payloads and knowledge, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analytics_queries import PLACED
from .graph import derived, table, with_graph
from .operators import analytics as A
from .operators import retrieval as R
from .operators import service as S
from .queries import query


@query(with_graph("SELECT name, coalesce(q, CASE WHEN n = 1 THEN p END) AS uid, CASE WHEN q IS NOT NULL THEN 1 ELSE n END AS matches FROM (SELECT w.name, (SELECT min(uid) FROM sym WHERE qualified_name = w.name) AS q, (SELECT min(uid) FROM sym WHERE name = w.name) AS p, (SELECT count(*) FROM sym WHERE name = w.name) AS n FROM (SELECT DISTINCT CASE WHEN length(uid) % 2 = 0 THEN name ELSE qualified_name END AS name FROM sym WHERE kind = 'Class' UNION SELECT 'nothing') w)"))
def symbol_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir).symbols
    names = s.where("kind = 'Class'").select(F.when(F.length("uid") % 2 == 0, F.col("name")).otherwise(F.col("qualified_name")).alias("name"))
    return S.resolve_symbols(s, names.union(spark.createDataFrame([("nothing",)], "name string")))


@query(with_graph("SELECT uid, name, start_line, end_line FROM sym WHERE file_path = 'supplier/n1/lib.rs'"))
def file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.file_symbols(derived(spark, sf_dir).symbols, "supplier/n1/lib.rs").select("uid", "name", "start_line", "end_line")


@query(with_graph("SELECT src AS source_uid, dst AS target_uid, kind, CASE WHEN kind = 'CALLS' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM edge"))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.payload_edges(derived(spark, sf_dir))


@query(with_graph("SELECT s.uid, s.name, s.kind, coalesce(d.depth, 0) AS depth, community, s.uid IN (SELECT src FROM edge WHERE kind = 'CALLS') AND s.uid NOT IN (SELECT dst FROM edge WHERE kind = 'CALLS') AS entry FROM sym s JOIN community USING (uid) LEFT JOIN (SELECT node, min(depth) AS depth FROM walk GROUP BY node) d ON d.node = s.uid", "walk(node, depth) AS (SELECT DISTINCT src, CAST(0 AS BIGINT) FROM link WHERE kind = 'CALLS' AND src NOT IN (SELECT dst FROM link WHERE kind = 'CALLS') UNION SELECT dst, depth + 1 FROM walk JOIN link ON src = node AND kind = 'CALLS' WHERE depth < 60)"))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return S.payload_nodes(g, A.path_community(g))


@query(with_graph("SELECT uid, name FROM sym ORDER BY name, uid LIMIT 40 OFFSET 80"))
def node_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page(derived(spark, sf_dir).symbols.select("uid", "name"), 3, 40, "name", "uid")


@query(with_graph("SELECT uid, dst AS other, edge.kind, 'out' AS direction FROM edge JOIN sym ON uid = src WHERE sym.kind = 'Class' UNION ALL SELECT uid, src, edge.kind, 'in' FROM edge JOIN sym ON uid = dst WHERE sym.kind = 'Class'"))
def node_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return S.neighbours(g, g.symbols.where("kind = 'Class'").select("uid"))


@query(with_graph("SELECT community, members, (SELECT count(*) FROM placed WHERE kind IN ('CALLS', 'IMPORTS') AND a = c.community AND b = c.community) AS internal, (SELECT count(*) FROM placed WHERE kind IN ('CALLS', 'IMPORTS') AND a <> b AND (a = c.community OR b = c.community)) AS external FROM (SELECT community, count(*) AS members FROM community GROUP BY community) c", PLACED))
def community_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return S.community_detail(g, A.path_community(g))


@query("WITH files AS (SELECT DISTINCT source FROM documents WHERE doc_id < 5) SELECT CAST(floor(sum(strlen(text)) / 4) AS BIGINT) AS tokens FROM documents WHERE source IN (SELECT source FROM files)")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.col("source").alias("file_path"), F.col("text").alias("content"))
    return S.token_estimate(docs, docs.where("uid < 5").select("uid"))


@query(with_graph("SELECT CAST(o AS INTEGER) AS query_id, target, uid, kind, name FROM (SELECT 1 AS o, b.uid AS target, a.uid AS uid, a.kind, a.name, row_number() OVER (ORDER BY a.name, a.uid, b.uid) AS r FROM edge e JOIN sym a ON a.uid = e.src JOIN sym b ON b.uid = e.dst WHERE e.kind = 'CALLS' AND b.uid IN (SELECT uid FROM sym WHERE kind = 'Class' AND start_line = 10)) WHERE r <= 20"))
def knowledge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls stand for mentions; one word marks the symbols that the question is about."""
    g = derived(spark, sf_dir)
    docs = g.symbols.select("uid", F.when((F.col("kind") == "Class") & (F.col("start_line") == 10), "wanted").otherwise("other").alias("text"))
    post, lengths = R.inverted_index(docs, "uid", "text")
    mentions = g.kind("CALLS").select(F.col("src").alias("uid"), F.col("dst").alias("target"))
    return S.knowledge_query(post, lengths, mentions, g.symbols, spark.createDataFrame([(1, "wanted")], "query_id int, text string"))
