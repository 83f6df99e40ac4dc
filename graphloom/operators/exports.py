"""Exports as rows of text, one or more per node and edge, to be written by any text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escaped
from ..graph import Graph


def graphml(graph: Graph) -> DataFrame:
    """(part, uid, row): the XML of nodes and edges; part orders head, nodes, edges and end."""
    spark = graph.symbols.sparkSession
    x = lambda c: xml_escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    node = F.concat(F.lit('<node id="'), x("uid"), F.lit('"><data key="name">'), x("name"), F.lit('</data><data key="kind">'), x("kind"), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), x("source_uid"), F.lit('" target="'), x("target_uid"), F.lit('"><data key="kind">'), x("kind"), F.lit("</data></edge>"))
    ends = spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "", "</graph></graphml>")], "part int, uid string, row string")
    nodes = graph.symbols.select(F.lit(1).alias("part"), "uid", node.alias("row"))
    edges = graph.edges.select(F.lit(2).alias("part"), F.concat_ws("|", "source_uid", "kind", "target_uid").alias("uid"), edge.alias("row"))
    return ends.unionByName(nodes).unionByName(edges)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def create_script(graph: Graph) -> DataFrame:
    """(part, uid, row): statements that create the nodes and then the edges in a graph database."""
    node = F.concat(F.lit("CREATE (:"), "kind", F.lit(" {uid: "), _quoted(F.col("uid")), F.lit(", name: "), _quoted(F.col("name")), F.lit("});"))
    edge = F.concat(F.lit("MATCH (a {uid: "), _quoted(F.col("source_uid")), F.lit("}), (b {uid: "), _quoted(F.col("target_uid")), F.lit("}) CREATE (a)-[:"), "kind", F.lit("]->(b);"))
    return graph.symbols.select(F.lit(1).alias("part"), "uid", node.alias("row")).unionByName(graph.edges.select(F.lit(2).alias("part"), F.concat_ws("|", "source_uid", "kind", "target_uid").alias("uid"), edge.alias("row")))


def mermaid_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "_")


def mermaid_flow(graph: Graph, kinds: tuple[str, ...] = ("CALLS",), arrow: str = " --> ") -> DataFrame:
    """(row): the edges of a flowchart between symbols, by their names."""
    of = lambda side: graph.symbols.select(F.col("uid").alias(side), F.col("name").alias(f"{side}_name"))
    e = graph.edges.where(F.col("kind").isin(*kinds)).join(of("source_uid"), "source_uid").join(of("target_uid"), "target_uid")
    end = lambda side: F.concat(mermaid_id(F.col(side)), F.lit('["'), F.replace(F.col(f"{side}_name"), F.lit('"'), F.lit("'")), F.lit('"]'))
    return e.select(F.concat(F.lit("    "), end("source_uid"), F.lit(arrow), end("target_uid")).alias("row"))


def mermaid_classes(graph: Graph) -> DataFrame:
    """(uid, row): a class and its members by MEMBER_OF."""
    members = graph.kind("MEMBER_OF").join(graph.symbols.select(F.col("uid").alias("src"), "name"), "src").groupBy(F.col("dst").alias("uid")).agg(F.sort_array(F.collect_list("name")).alias("members"))
    own = graph.symbols.where("kind IN ('Class', 'Interface')").join(members, "uid", "left")
    body = F.array_join(F.transform(F.coalesce("members", F.array()), lambda m: F.concat(F.lit("        +"), m, F.lit("()"))), "\n")
    return own.select("uid", F.concat(F.lit("    class "), mermaid_id(F.col("name")), F.lit(" {\n"), body, F.lit("\n    }")).alias("row"))


def json_rows(graph: Graph) -> DataFrame:
    """(part, row): symbols and edges as JSON lines."""
    rows = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("row"))
    return rows(graph.symbols, "symbol").unionByName(rows(graph.edges, "edge"))


def wiki_pages(graph: Graph, members: DataFrame) -> DataFrame:
    """(page, text): one page of Markdown for each community, its symbols listed by kind and name."""
    line = F.concat(F.lit("- **"), "name", F.lit("** ("), "kind", F.lit(") `"), "file_path", F.lit("`"))
    rows = members.join(graph.symbols, "uid").select("community", "name", line.alias("line"))
    pages = rows.groupBy("community").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return pages.select(F.col("community").alias("page"), F.concat(F.lit("# "), "community", F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))
