"""Records beside a graph: snapshots by id, decisions, the service map, teams; symbols as they are scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..schema import NODE_KINDS
from .catalog import Catalog

SNAPSHOT = "repo_id string, snapshot_id string, created_at string, commit_sha string, symbol_count long, edge_count long"
DECISION = "repo_id string, id string, title string, status string, text string, linked array<string>, created_at string, updated_at string"


def scanned(symbols: DataFrame) -> DataFrame:
    """Stored symbols as queries see them: empty metadata is null, a kind that isn't known is Variable."""
    kind = F.when(F.col("kind").isin(*NODE_KINDS), F.col("kind")).otherwise("Variable")
    return symbols.withColumn("metadata", F.nullif("metadata", F.lit(""))).withColumn("kind", kind)


def _table(catalog: Catalog, name: str, schema: str) -> DataFrame:
    df = catalog.read(name)
    return df if df.columns else catalog.spark.createDataFrame([], schema)


def save_snapshot(catalog: Catalog, graph: Graph, repo: str, created_at: str, commit: str | None = None) -> str:
    """Stores symbols and edges under an id made of the time; returns the id. The summary is written last, so a
    snapshot that is listed is whole."""
    key = created_at.replace(":", "-").replace("+", "p")
    own = (F.lit(repo).alias("repo_id"), F.lit(key).alias("snapshot_id"))
    symbols, edges = graph.symbols.select("uid", "name", "kind", "file_path", *own), graph.edges.select("source_uid", "target_uid", "kind", *own)
    catalog.append("snapshot_symbols", symbols)
    catalog.append("snapshot_edges", edges)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = count(symbols, "symbol_count").crossJoin(count(edges, "edge_count")).select(*own, F.lit(created_at).alias("created_at"), F.lit(commit).cast("string").alias("commit_sha"), "symbol_count", "edge_count")
    catalog.append("snapshots", row)
    return key


def snapshots(catalog: Catalog, repo: str) -> DataFrame:
    """A repository's snapshots, the newest first."""
    return _table(catalog, "snapshots", SNAPSHOT).where(F.col("repo_id") == repo).orderBy(F.desc("created_at"), F.desc("snapshot_id"))


def load_snapshot(catalog: Catalog, repo: str, key: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(symbols, edges) of a snapshot by its id, or of the latest; None if there is none."""
    listed = snapshots(catalog, repo)
    row = (listed if key is None else listed.where(F.col("snapshot_id") == key)).first()
    if row is None:
        return None
    own = (F.col("repo_id") == repo) & (F.col("snapshot_id") == row["snapshot_id"])
    return catalog.read("snapshot_symbols").where(own), catalog.read("snapshot_edges").where(own)


def decisions(catalog: Catalog, repo: str) -> DataFrame:
    return _table(catalog, "decisions", DECISION).where(F.col("repo_id") == repo)


def record_decision(catalog: Catalog, repo: str, key: str, title: str, status: str, text: str, at: str, linked: tuple[str, ...] = ()) -> None:
    """Stores a decision; the same id in the same repository is replaced."""
    row = catalog.spark.createDataFrame([(repo, key, title, status, text, list(linked), at, at)], DECISION)
    catalog.upsert("decisions", row, "repo_id", "id")


def link_decision(catalog: Catalog, repo: str, key: str, symbol: str, at: str) -> None:
    """Links a decision to a symbol's name, once; an error if there is no such decision."""
    own = decisions(catalog, repo).where(F.col("id") == key)
    if own.isEmpty():
        raise KeyError(f"no decision {key} in {repo}")
    new = ~F.array_contains("linked", symbol)
    changed = own.withColumn("updated_at", F.when(new, F.lit(at)).otherwise(F.col("updated_at"))).withColumn("linked", F.array_union("linked", F.array(F.lit(symbol))))
    catalog.upsert("decisions", changed, "repo_id", "id")


def map_service(catalog: Catalog, repo: str, community: str, service: str) -> None:
    """Names the service that a community is; a community's earlier name is replaced."""
    row = catalog.spark.createDataFrame([(repo, community, service)], "repo_id string, community string, service string")
    catalog.upsert("services", row, "repo_id", "community")


def service_map(catalog: Catalog, repo: str) -> DataFrame:
    return _table(catalog, "services", "repo_id string, community string, service string").where(F.col("repo_id") == repo).select("community", "service")


def create_team(catalog: Catalog, team: str, name: str, owner: str) -> None:
    catalog.upsert("teams", catalog.spark.createDataFrame([(team, name, owner)], "team_id string, name string, owner_id string"), "team_id")


def add_member(catalog: Catalog, team: str, user: str, role: str = "member") -> None:
    catalog.upsert("team_members", catalog.spark.createDataFrame([(team, user, role)], "team_id string, user_id string, role string"), "team_id", "user_id")


def teams(catalog: Catalog) -> DataFrame:
    return _table(catalog, "teams", "team_id string, name string, owner_id string")


def team_members(catalog: Catalog, team: str | None = None) -> DataFrame:
    rows = _table(catalog, "team_members", "team_id string, user_id string, role string")
    return rows if team is None else rows.where(F.col("team_id") == team)


def ontology_problems(used: DataFrame, types: DataFrame) -> DataFrame:
    """(kind, problem): kinds in use (kind) that no type (name) defines."""
    return used.select("kind").distinct().join(types.select(F.col("name").alias("kind")), "kind", "left_anti").select("kind", F.concat(F.lit("unknown type: "), "kind").alias("problem"))


def preferred(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose keys it hasn't."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))
