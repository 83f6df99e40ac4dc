"""A code graph in a catalog: a repository written whole once, then kept up to date by the files that change.

Beside symbols, files and relationships the catalog holds every file's calls and imports as they stand in its
text, so that callers in files that didn't change find a symbol's new id, and lose one that is gone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators.builders import contained_by, import_edges, member_of, resolved_calls
from ..operators.catalog import Catalog
from ..sources.code import code_facts, symbols_of
from .events import follow_changes

COLUMNS = {
    "symbols": "uid string, name string, qualified_name string, kind string, file_path string, start_line long, end_line long, signature string, repo_id string, metadata string",
    "files": "uid string, path string, language string, num_symbols long, repo_id string",
    "relationships": "source_uid string, target_uid string, kind string, repo_id string",
    "calls": "caller_uid string, target string, file_path string, repo_id string",
    "imports": "file_path string, target string, repo_id string",
}


def parsed(files: DataFrame, repo: str, rules: str = "") -> dict[str, DataFrame]:
    """The tables of files (path, language, content) but for relationships. Files are read by Python once."""
    facts = cut(code_facts(files, rules))
    symbols = symbols_of(facts, repo)
    owner = symbols.groupBy("file_path", "qualified_name").agg(F.max(F.struct("start_line", "uid")).alias("x")).select("file_path", "qualified_name", F.col("x.uid").alias("caller_uid"))
    calls = facts.where("fact = 'call'").select("file_path", "qualified_name", "target").join(owner, ["file_path", "qualified_name"])
    n = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("num_symbols"))
    rows = files.select("path", "language").join(n, "path", "left").select(F.concat(F.lit("F:"), "path").alias("uid"), "path", "language", F.coalesce("num_symbols", F.lit(0)).alias("num_symbols"))
    own = F.lit(repo).alias("repo_id")
    out = {"symbols": symbols, "files": rows.select("*", own), "calls": calls.select("caller_uid", "target", "file_path", own), "imports": facts.where("fact = 'import'").select("file_path", "target", own)}
    return {k: v.select(*[c.split()[0] for c in COLUMNS[k].split(", ")]) for k, v in out.items()}


def _stored(catalog: Catalog, name: str, repo: str) -> DataFrame:
    """A repository's rows, or an empty table."""
    df = catalog.read(name, repo) if not catalog.versions(name).isEmpty() else catalog.spark.createDataFrame([], COLUMNS[name])
    return df.select(*[c.split()[0] for c in COLUMNS[name].split(", ")])


def _put(catalog: Catalog, name: str, repo: str, rows: DataFrame) -> None:
    """The rows instead of a repository's old ones; other repositories keep theirs."""
    if not catalog.versions(name).isEmpty():
        rows = catalog.read(name).where(F.col("repo_id") != repo).unionByName(rows, allowMissingColumns=True)
    catalog.replace(name, rows)


def _inner(symbols: DataFrame, repo: str) -> DataFrame:
    return contained_by(symbols).unionByName(member_of(symbols)).withColumn("repo_id", F.lit(repo))


def _outer(calls: DataFrame, imports: DataFrame, importing: DataFrame, symbols: DataFrame, repo: str) -> DataFrame:
    """Edges of calls and of the files that import, found among all symbols; ``imports`` are all of the repository's."""
    return resolved_calls(calls.select("caller_uid", "target"), symbols, imports).unionByName(import_edges(importing, symbols)).withColumn("repo_id", F.lit(repo))


def index(catalog: Catalog, files: DataFrame, repo: str, rules: str = "") -> None:
    """Writes a repository's tables anew."""
    new = parsed(files, repo, rules)
    edges = _inner(new["symbols"], repo).unionByName(_outer(new["calls"], new["imports"], new["imports"], new["symbols"], repo))
    for name, df in (new | {"relationships": edges}).items():
        _put(catalog, name, repo, df)


def reindex(catalog: Catalog, files: DataFrame, gone: DataFrame, repo: str, rules: str = "") -> None:
    """Takes files that changed or are new (path, language, content), and drops those of ``gone`` (path).

    Only the changed files are parsed. Calls and imports are resolved again where their file changed or where a
    name that they use stood, or stands now, in a changed file; all other edges stay. The tables are then
    what ``index`` makes of all files; running a batch twice changes nothing.
    """
    old = {k: _stored(catalog, k, repo) for k in COLUMNS}
    new = parsed(files, repo, rules)
    touched = cut(files.select("path").union(gone.select("path")).distinct()).select(F.col("path").alias("file_path"))
    kept = {k: old[k].join(touched, "file_path", "left_anti").unionByName(new[k]) for k in ("symbols", "calls", "imports")}
    kept["files"] = old["files"].join(touched.withColumnRenamed("file_path", "path"), "path", "left_anti").unionByName(new["files"])
    lost = old["symbols"].join(touched, "file_path", "left_semi")
    names = cut(lost.unionByName(new["symbols"]).select(F.explode(F.array("name", "qualified_name")).alias("target")).distinct())
    stir = lambda df, key: df.join(touched, "file_path", "left_semi").select(key).union(df.join(names, "target", "left_semi").select(key)).distinct()
    callers = cut(stir(kept["calls"], "caller_uid"))
    last = F.element_at(F.split("target", r"[./:]+"), -1)
    importers = cut(stir(kept["imports"].withColumn("target", last), "file_path"))
    again = kept["calls"].join(callers, "caller_uid", "left_semi")
    importing = kept["imports"].join(importers, "file_path", "left_semi")
    edges = _outer(again, kept["imports"], importing, kept["symbols"], repo)
    # what goes: all edges of symbols that are gone, the calls of those callers, the imports of those files
    of_files = old["symbols"].join(importers, "file_path", "left_semi").select("uid")
    out = old["relationships"]
    out = out.join(lost.select(F.col("uid").alias("source_uid")), "source_uid", "left_anti")
    for kind, sources in (("CALLS", callers.withColumnRenamed("caller_uid", "uid")), ("IMPORTS", of_files)):
        marked = sources.select(F.col("uid").alias("source_uid"), F.lit(kind).alias("kind")).distinct()
        out = out.join(marked, ["source_uid", "kind"], "left_anti")
    kept["relationships"] = out.unionByName(_inner(new["symbols"], repo)).unionByName(edges)
    for name, df in kept.items():
        _put(catalog, name, repo, df)


def watch(changes: DataFrame, catalog: Catalog, read: Callable[[DataFrame], DataFrame], repo: str, checkpoint: str, every: str = "500 milliseconds", rules: str = ""):
    """Follows a stream of (path, removed, ts): ``read`` gives (path, language, content) of the paths that changed."""
    return follow_changes(changes, lambda changed, removed: reindex(catalog, read(changed), removed, repo, rules), checkpoint, every)
