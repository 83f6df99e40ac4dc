"""Unified diffs and their blast radius; intents and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..graph import Graph
from .paths import reach


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(diff, file_path, status, start, end) of unified diffs (diff, line_no, line): a hunk's range in the new
    file; an empty range has no hunk; of an added or deleted file the status says so and the range is null."""
    order = Window.partitionBy("diff").orderBy("line_no")
    x = F.col("line")
    path = lambda c: F.regexp_replace(F.regexp_extract(c, r"^(?:---|\+\+\+) (\S+)", 1), "^[ab]/", "")
    carried = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    old = carried(F.when(x.startswith("--- "), path(x)))
    new = carried(F.when(x.startswith("+++ "), path(x)))
    rows = lines.select("diff", "line_no", "line", old.alias("old"), new.alias("new")).where(x.startswith("@@"))
    start = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("long")
    count = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1)
    n = F.when(count == "", 1).otherwise(count.try_cast("long"))
    status = F.when(F.col("new") == "/dev/null", "deleted").when(F.col("old") == "/dev/null", "added").otherwise("modified")
    rows = rows.select("diff", F.when(F.col("new") == "/dev/null", F.col("old")).otherwise(F.col("new")).alias("file_path"), status.alias("status"), start.alias("start"), n.alias("n"))
    whole = F.col("status") != "modified"
    rows = rows.where(whole | (F.col("n") > 0))
    return rows.select("diff", "file_path", "status", F.when(~whole, F.col("start")).alias("start"), F.when(~whole, F.col("start") + F.col("n") - 1).alias("end")).distinct()


def changed_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(uid): symbols that a hunk (file_path, status, start, end) overlaps, all those of added and deleted files.
    A path that no symbol has stands for those that end with it, or that it ends with."""
    paths = symbols.select("file_path").distinct()
    exact = hunks.join(paths, "file_path", "left_semi").withColumn("own", F.col("file_path"))
    rest = hunks.join(paths, "file_path", "left_anti")
    name = lambda c: F.element_at(F.split(c, "/"), -1)  # noqa: E731  files of another name can't be meant
    near = rest.withColumn("base", name(F.col("file_path"))).join(paths.select(F.col("file_path").alias("own"), name(F.col("file_path")).alias("base")), "base").where(F.col("own").endswith(F.concat(F.lit("/"), "file_path")) | F.col("file_path").endswith(F.concat(F.lit("/"), "own"))).drop("base")
    found = exact.unionByName(near).select("own", "status", "start", "end")
    rows = symbols.select("uid", F.col("file_path").alias("own"), "start_line", "end_line").join(found, "own")
    return rows.where((F.col("status") != "modified") | (F.col("start") <= F.col("end_line")) & (F.col("end") >= F.col("start_line"))).select("uid").distinct()


def impact(graph: Graph, changed: DataFrame, depth: int = 2) -> DataFrame:
    """(uid, depth): what calls or imports lead to or from ``changed`` (uid), the changed ones at depth 0."""
    e = graph.kind("CALLS", "IMPORTS")
    both = e.union(e.select("dst", "src"))
    # one search from all changed symbols together
    seeds = changed.select(F.lit(0).alias("seed"), F.col("uid").alias("node"))
    both, frontier = cut(both.distinct()), cut(seeds)
    seen = frontier.withColumn("depth", F.lit(0).cast("long"))
    for i in range(1, depth + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(i).cast("long")))
    own = graph.symbols.select(F.col("uid").alias("node"))
    return seen.join(own, "node", "left_semi").select(F.col("node").alias("uid"), "depth")


def risk(direct: Column, indirect: Column, callers: Column, files: Column) -> Column:
    """0 to 10: changed symbols, half of those reached, three tenths of direct callers, a fifth of files."""
    return F.round(F.least(direct + indirect * 0.5 + callers * 0.3 + files * 0.2, F.lit(50.0)) / 50 * 10, 2)


def impact_risk(graph: Graph, changed: DataFrame, depth: int = 2) -> DataFrame:
    """(direct, indirect, callers, files, risk) of a change."""
    reached = impact(graph, changed, depth).join(graph.symbols.select("uid", "file_path"), "uid")
    callers = graph.kind("CALLS").join(changed.select(F.col("uid").alias("dst")), "dst", "left_semi").agg(F.count(F.lit(1)).alias("callers"))
    sums = reached.agg(F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") > 0).alias("indirect"), F.count_distinct("file_path").alias("files"))
    return sums.crossJoin(callers).select("direct", "indirect", "callers", "files", risk(F.col("direct"), F.col("indirect"), F.col("callers"), F.col("files")).alias("risk"))


def review_context(graph: Graph, changed: DataFrame, members: DataFrame) -> DataFrame:
    """(uid, role, community): changed symbols, their callers and their callees, each with its community."""
    calls = graph.inner("CALLS")
    own = changed.select("uid", F.lit("changed").alias("role"))
    to = changed.select(F.col("uid").alias("own"))
    callers = calls.join(to, F.col("dst") == F.col("own")).select(F.col("src").alias("uid"), F.lit("caller").alias("role"))
    callees = calls.join(to, F.col("src") == F.col("own")).select(F.col("dst").alias("uid"), F.lit("callee").alias("role"))
    return own.union(callers).union(callees).distinct().join(members, "uid", "left").select("uid", "role", "community")


def intent_slice(graph: Graph, seeds: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """(uid, depth): symbols within ``depth`` calls of ``seeds`` (uid) in either direction, the nearest first."""
    calls = graph.kind("CALLS")
    own = reach(calls.union(calls.select("dst", "src")), seeds.select(F.col("uid").alias("seed")), depth)
    near = own.groupBy(F.col("node").alias("uid")).agg(F.min("depth").alias("depth")).join(graph.symbols.select("uid"), "uid", "left_semi")
    return near.orderBy("depth", "uid").limit(most)


def differentiate_by_name(source: DataFrame, target: DataFrame) -> DataFrame:
    """(name, status) of two slices (name): in both, only in the source, or only in the target."""
    both = source.select("name", F.lit(True).alias("s")).distinct().join(target.select("name", F.lit(True).alias("t")).distinct(), "name", "full")
    return both.select("name", F.when(F.col("s") & F.col("t"), "matched").when(F.col("s"), "source_only").otherwise("target_only").alias("status"))


def adaptation_plan(differences: DataFrame) -> DataFrame:
    """(action, n, effort): what to create, adapt and remove so that the target gets the source's intent."""
    action = F.when(F.col("status") == "matched", "adapt").when(F.col("status") == "source_only", "create").otherwise("remove")
    n = F.col("n")
    effort = F.when(n <= 5, "small").when(n <= 15, "medium").when(n <= 40, "large").otherwise("very_large")
    return differences.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n")).withColumn("effort", effort)


def adaptation_steps(differences: DataFrame, critical: bool = False, languages_differ: bool = False) -> DataFrame:
    """(ordinal, category, n, needs, effort, risks) of a plan's steps, those without symbols left out: analyze, create,
    adapt, remove, verify. Each needs the one before it, adapting also the analysis; effort and risks are the plan's."""
    of = lambda status: F.count_if(F.col("status") == status).alias(status)
    n = differences.agg(of("matched"), of("source_only"), of("target_only"))
    c, a, r = F.col("source_only"), F.col("matched"), F.col("target_only")
    total = c + a + r
    effort = F.when(total <= 5, "small").when(total <= 15, "medium").when(total <= 40, "large").otherwise("very_large")
    risks = F.array_compact(F.array(F.when(r > 0, "removal may break callers outside"), F.when(F.lit(languages_differ), "languages differ"), F.when(c + r > a, "more unmatched than matched"), F.when(F.lit(critical), "critical structural differences")))
    step = lambda category, size: F.struct(F.lit(category).alias("category"), size.cast("long").alias("n"))
    steps = F.filter(F.array(step("analyze", total), step("create", c), step("adapt", a), step("remove", r), step("verify", F.lit(0))), lambda x: (x["n"] > 0) | x["category"].isin("analyze", "verify"))
    rows = n.select(F.posexplode(steps).alias("at", "x"), effort.alias("effort"), F.array_join(risks, "; ").alias("risks"))
    needs = F.when(F.col("at") == 0, "").when((F.col("x.category") == "adapt") & (F.col("at") > 1), F.concat(F.lit("1,"), F.col("at").cast("string"))).otherwise(F.col("at").cast("string"))
    return rows.select((F.col("at") + 1).cast("long").alias("ordinal"), "x.category", "x.n", needs.alias("needs"), "effort", "risks")
