"""Edges from facts: containment, membership, calls, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent_name(qualified: Column) -> Column:
    """The last part of what stands before the last "::" or "." of a qualified name."""
    return F.regexp_extract(qualified, r"([^.:]+)(?:::|\.)[^.:]*$", 1)


def contained_by(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("uid").alias("source_uid"), F.concat(F.lit("F:"), "file_path").alias("target_uid"), F.lit("CONTAINED_BY").alias("kind"))


def member_of(symbols: DataFrame) -> DataFrame:
    """(source_uid, target_uid, kind): a symbol and the one of the same file with its parent's name, the last
    by line (then uid) of several, never itself."""
    owners = symbols.groupBy("file_path", F.col("name").alias("parent")).agg(F.max(F.struct("start_line", "uid")).alias("x")).select("file_path", "parent", F.col("x.uid").alias("target_uid"))
    own = symbols.select(F.col("uid").alias("source_uid"), "file_path", parent_name(F.col("qualified_name")).alias("parent")).where("parent <> ''")
    return own.join(owners, ["file_path", "parent"]).where("source_uid <> target_uid").select("source_uid", "target_uid", F.lit("MEMBER_OF").alias("kind"))


def resolved_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(source_uid, target_uid, kind): calls (caller_uid, target) by qualified name first, then by name; with
    imports (file_path, target) a name prefers a file that the caller's file imports. The last symbol of a
    name counts; calls that find none are dropped, and each pair is kept once."""
    last = lambda key: symbols.groupBy(F.col(key).alias("target")).agg(F.max(F.struct("file_path", "start_line", "uid")).alias("x")).select("target", F.col("x.uid").alias(f"by_{key}"))
    found = calls.join(last("qualified_name"), "target", "left").join(last("name"), "target", "left")
    ways = [F.col("by_qualified_name"), F.col("by_name")]
    if imports is not None:
        files = symbols.select(F.col("uid").alias("caller_uid"), F.col("file_path").alias("own_path"))
        stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[./]+", ""), r"[./:]+", "/")
        reached = imports.select(F.col("file_path").alias("own_path"), stem(F.col("target")).alias("module"))
        homes = symbols.select(F.col("name").alias("target"), F.col("uid").alias("by_import"), stem(F.regexp_replace("file_path", r"\.[A-Za-z0-9]+$", "")).alias("home"))
        named = calls.join(files, "caller_uid").join(reached, "own_path").join(homes, "target").where((F.col("module") == F.col("home")) | F.col("home").endswith(F.concat(F.lit("/"), "module")) | F.col("module").startswith(F.concat("home", F.lit("/"))))
        found = found.join(named.groupBy("caller_uid", "target").agg(F.max("by_import").alias("by_import")), ["caller_uid", "target"], "left")
        ways.insert(1, F.col("by_import"))
    return found.select(F.col("caller_uid").alias("source_uid"), F.coalesce(*ways).alias("target_uid")).where("target_uid IS NOT NULL").distinct().withColumn("kind", F.lit("CALLS"))


def import_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_uid, target_uid, kind): from the symbols of a file to what it imports by its last name part."""
    name = F.element_at(F.split("target", r"[./:]+"), -1)
    wanted = imports.select("file_path", name.alias("name"))
    target = symbols.groupBy("name").agg(F.max(F.struct("file_path", "uid")).alias("x")).select("name", F.col("x.uid").alias("target_uid"), F.col("x.file_path").alias("home"))
    first = symbols.groupBy("file_path").agg(F.min(F.struct("start_line", "uid")).alias("x")).select("file_path", F.col("x.uid").alias("source_uid"))
    return wanted.join(target, "name").join(first, "file_path").where("home <> file_path").select("source_uid", "target_uid").distinct().withColumn("kind", F.lit("IMPORTS"))
