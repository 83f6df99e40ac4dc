"""Lookups and payloads of the query service: symbols, files, neighbours, communities, knowledge; decisions,
teams, ontology and freshness as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..graph import Graph
from .analytics import degrees
from .paths import call_depths
from .retrieval import bm25


def resolve_symbols(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(name, uid, matches) of each wanted name: the first symbol (by uid) with that qualified name, else the only
    one with that name; uid is null where none or several (matches) have it."""
    q = symbols.groupBy(F.col("qualified_name").alias("name")).agg(F.min("uid").alias("qualified"))
    n = symbols.groupBy("name").agg(F.min("uid").alias("plain"), F.count(F.lit(1)).alias("matches"))
    own = names.select("name").distinct().join(q, "name", "left").join(n, "name", "left")
    uid = F.coalesce("qualified", F.when(F.col("matches") == 1, F.col("plain")))
    return own.select("name", uid.alias("uid"), F.when(F.col("qualified").isNotNull(), 1).otherwise(F.coalesce("matches", F.lit(0))).cast("long").alias("matches"))


def file_symbols(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == path).orderBy("start_line", "uid")


def token_estimate(symbols: DataFrame, changed: DataFrame, content: str = "content") -> DataFrame:
    """(tokens): a quarter of the bytes of all symbols in the files of the changed ones (uid)."""
    files = symbols.join(changed, "uid", "left_semi").select("file_path").distinct()
    return symbols.join(files, "file_path", "left_semi").agg(F.floor(F.coalesce(F.sum(F.octet_length(content)), F.lit(0)) / 4).alias("tokens"))


def rationale_of(edges: DataFrame, symbols: DataFrame, uid: str | None = None, path: str | None = None) -> DataFrame:
    """(uid, target_uid, name): rationales linked to a symbol, in a file, or all."""
    rows = edges.where("kind = 'RATIONALE_FOR'").select(F.col("source_uid").alias("uid"), "target_uid").join(symbols.select("uid", "name", "file_path"), "uid")
    rows = rows if uid is None else rows.where(F.col("target_uid") == uid)
    return (rows if path is None else rows.where(F.col("file_path") == path)).select("uid", "target_uid", "name")


def edge_weight(kind: Column) -> Column:
    return F.when(kind == "CALLS", 1.0).when(kind == "STEP_IN_PROCESS", 2.0).otherwise(0.5)


def payload_nodes(graph: Graph, members: DataFrame) -> DataFrame:
    """(uid, name, kind, depth, community, entry) of every symbol, to draw."""
    d = degrees(graph, "CALLS").select("uid", ((F.col("in_degree") == 0) & (F.col("out_degree") > 0)).alias("entry"))
    return graph.symbols.select("uid", "name", "kind").join(call_depths(graph), "uid").join(members, "uid", "left").join(d, "uid")


def payload_edges(graph: Graph) -> DataFrame:
    """(source_uid, target_uid, kind, weight) of every edge, to draw."""
    return graph.edges.select("source_uid", "target_uid", "kind", edge_weight(F.col("kind")).alias("weight"))


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """A page from 1 of 1 to 500 rows."""
    size = max(1, min(size, 500))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def neighbours(graph: Graph, uids: DataFrame) -> DataFrame:
    """(uid, other, kind, direction): what edges join to each of some symbols (uid)."""
    e = graph.edges.select("source_uid", "target_uid", "kind")
    out = e.join(uids, F.col("source_uid") == F.col("uid")).select("uid", F.col("target_uid").alias("other"), "kind", F.lit("out").alias("direction"))
    into = e.join(uids, F.col("target_uid") == F.col("uid")).select("uid", F.col("source_uid").alias("other"), "kind", F.lit("in").alias("direction"))
    return out.unionByName(into)


def community_detail(graph: Graph, members: DataFrame) -> DataFrame:
    """(community, members, internal, external): each community's size and its edges within and across."""
    of = lambda side, name: members.select(F.col("uid").alias(side), F.col("community").alias(name))
    e = graph.kind("CALLS", "IMPORTS").join(of("src", "a"), "src").join(of("dst", "b"), "dst")
    ends = e.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("community"), (F.col("a") == F.col("b")).alias("inside"))
    n = ends.groupBy("community").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return members.groupBy("community").agg(F.count(F.lit(1)).alias("members")).join(n, "community", "left").select("community", "members", zero("internal"), zero("external"))


def community_fallback(stored: DataFrame, found: DataFrame, by_path: DataFrame) -> DataFrame:
    """(uid, community): what is stored, else what was found, else the path's."""
    s, f = stored.select("uid", F.col("community").alias("s")), found.select("uid", F.col("community").alias("f"))
    return by_path.join(s, "uid", "left").join(f, "uid", "left").select("uid", F.coalesce("s", "f", "community").alias("community"))


def knowledge_query(postings: DataFrame, lengths: DataFrame, mentions: DataFrame, content: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, target, uid, kind, name): the content (uid, kind, name) that mentions (uid, target) any symbol
    that matches a query; mail first, then documents and sections, then the rest, by name and uid; at most 100 a query."""
    hits = bm25(postings, lengths, queries, None).select("query_id", F.col("uid").alias("target"))
    rows = hits.join(mentions.select("uid", "target").distinct(), "target").join(content.select("uid", "kind", "name"), "uid")
    kind = F.when(F.col("kind") == "Email", 0).when(F.col("kind") == "Document", 1).when(F.col("kind") == "Section", 2).otherwise(3)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(kind, "name", "uid", "target"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= min(limit, 100)).drop("rank")


def ontology_schema(types: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(name, properties) of entity types (name, extends, properties), those of all ancestors included."""
    parent = types.select(F.col("name").alias("up"), F.col("extends").alias("next"), F.col("properties").alias("more"))
    level = types.where(F.lower("name").isin(*[n.lower() for n in names])).select("name", F.col("extends").alias("up"), F.array("name").alias("seen"), "properties")
    found = level.select("name", "properties")
    while not (level := cut(level.where(F.col("up").isNotNull() & ~F.array_contains("seen", F.col("up"))))).isEmpty():  # a circle ends where it began
        level = level.join(parent, "up").select("name", F.col("next").alias("up"), F.concat("seen", F.array("up")).alias("seen"), F.col("more").alias("properties"))
        found = found.unionByName(level.select("name", "properties"))
    return found.groupBy("name").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("properties")))).alias("properties"))


def teams_of(teams: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """Teams (team_id, owner_id) that a user owns or is a member (team_id, user_id) of."""
    mine = members.where(F.col("user_id") == user).select("team_id").union(teams.where(F.col("owner_id") == user).select("team_id")).distinct()
    return teams.join(mine, "team_id", "left_semi")


def stale(repos: DataFrame, changes: DataFrame, minutes: int = 60, most_changes: int = 50) -> DataFrame:
    """(repo_id, reason) of indexed repositories (repo_id, indexed_at, checked_at): too old, a structural file
    changed, or many files; changes: (repo_id, path). Null is fresh."""
    structural = F.col("path").rlike(r"(^|/)(package\.json|Cargo\.toml|pyproject\.toml|go\.mod|pom\.xml)$")
    n = changes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.max(structural).alias("structural"))
    age = (F.unix_timestamp("checked_at") - F.unix_timestamp("indexed_at")) / 60
    reason = F.when(age > minutes, "age").when(F.col("structural"), "structural").when(F.col("n") > most_changes, "many_changes")
    return repos.join(n, "repo_id", "left").select("repo_id", reason.alias("reason"))
