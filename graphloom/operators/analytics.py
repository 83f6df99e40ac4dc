"""Relational graph analytics: degrees, coupling, communities' figures, rules and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..graph import Graph
from .paths import reach

CODE_KINDS = ("Function", "Method", "Class", "Interface", "TypeAlias", "Variable", "Constant", "Enum", "Module")
DOC_KINDS = ("Document", "Section", "Rationale")


def directory_of(path: Column | str) -> Column:
    """What stands before the last slash, else "."."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def path_community(graph: Graph) -> DataFrame:
    """(uid, community): the first two components of a symbol's path."""
    return graph.symbols.select("uid", F.concat_ws("/", F.split_part("file_path", F.lit("/"), F.lit(1)), F.split_part("file_path", F.lit("/"), F.lit(2))).alias("community"))


def stats(graph: Graph) -> DataFrame:
    """(section, kind, n): symbols by kind, edges by kind, files by language, and totals."""
    counts = lambda df, section, by: df.groupBy(F.col(by).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "kind", "n")
    return counts(graph.symbols, "symbols", "kind").unionByName(counts(graph.edges, "edges", "kind")).unionByName(counts(graph.files, "files", "language"))


def degrees(graph: Graph, *kinds: str) -> DataFrame:
    """(uid, in_degree, out_degree, degree) of every symbol, over edges of some kinds."""
    edges = graph.kind(*kinds)
    ends = edges.select(F.col("src").alias("uid"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("uid"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    each = ends.groupBy("uid").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return graph.symbols.select("uid").join(each, "uid", "left").select("uid", zero("i").alias("in_degree"), zero("o").alias("out_degree"), (zero("i") + zero("o")).alias("degree"))


def god_nodes(graph: Graph, top: int = 10, threshold: int = 20) -> DataFrame:
    """The symbols with the most calls in and out; ``coupled`` marks those above the threshold."""
    return degrees(graph, "CALLS").withColumn("coupled", F.col("degree") > threshold).orderBy(F.desc("degree"), "uid").limit(top)


def dead_code(graph: Graph, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Functions and methods that nothing calls, without names that contain an excluded part."""
    own = graph.symbols.where(F.col("kind").isin("Function", "Method"))
    for part in exclude:
        own = own.where(~F.col("name").contains(part))
    return own.join(graph.kind("CALLS").select(F.col("dst").alias("uid")), "uid", "left_anti").select("uid", "name", "file_path")


def module_edges(graph: Graph, by_directory: bool = False) -> DataFrame:
    """(src, dst): distinct pairs of modules (files, or their directories) of which one imports the other."""
    module = directory_of("file_path") if by_directory else F.col("file_path")
    of = lambda side: graph.symbols.select(F.col("uid").alias(f"{side}_uid"), module.alias(side))
    edges = graph.kind("IMPORTS").select(F.col("src").alias("a_uid"), F.col("dst").alias("b_uid"))
    return edges.join(of("a"), "a_uid").join(of("b"), "b_uid").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def module_coupling(graph: Graph, by_directory: bool = False) -> DataFrame:
    """(module, afferent, efferent, instability): who imports it, whom it imports, and the latter's share."""
    edges = module_edges(graph, by_directory)
    out = edges.groupBy(F.col("src").alias("module")).agg(F.count(F.lit(1)).alias("e"))
    into = edges.groupBy(F.col("dst").alias("module")).agg(F.count(F.lit(1)).alias("a"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = into.join(out, "module", "full").select("module", zero("a").alias("afferent"), zero("e").alias("efferent"))
    return both.withColumn("instability", F.round(F.col("efferent") / (F.col("afferent") + F.col("efferent")), 6))


def file_dependencies(graph: Graph, files: DataFrame, depth: int | None = None) -> DataFrame:
    """(file, other, depth, direction): files that ``files`` (file) import, and that import them, in steps."""
    edges = cut(module_edges(graph))
    seeds = files.select(F.col("file").alias("seed"))
    near = lambda e, name: reach(e, seeds, depth).where("depth > 0").select(F.col("seed").alias("file"), F.col("node").alias("other"), "depth", F.lit(name).alias("direction"))
    return near(edges, "imports").unionByName(near(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "imported_by"))


# --- communities ---------------------------------------------------------------------------------


def placed_edges(graph: Graph, members: DataFrame, *kinds: str) -> DataFrame:
    """(src, dst, a, b): edges with the communities of both ends; members: (uid, community)."""
    of = lambda side, name: members.select(F.col("uid").alias(side), F.col("community").alias(name))
    return graph.kind(*kinds).join(of("src", "a"), "src").join(of("dst", "b"), "dst")


def merged_weights(graph: Graph) -> DataFrame:
    """(u, v, weight): unordered pairs of symbols with summed weights: calls 3, imports 2, containment 1."""
    weight = F.when(F.col("kind") == "CALLS", 3).when(F.col("kind") == "IMPORTS", 2).otherwise(1)
    own = graph.symbols.select(F.col("uid").alias("own_uid"))
    e = graph.edges.where(F.col("kind").isin("CALLS", "IMPORTS", "CONTAINED_BY") & (F.col("source_uid") != F.col("target_uid")))
    e = e.join(own, F.col("source_uid") == F.col("own_uid"), "left_semi").join(own, F.col("target_uid") == F.col("own_uid"), "left_semi")
    return e.groupBy(F.least("source_uid", "target_uid").alias("u"), F.greatest("source_uid", "target_uid").alias("v")).agg(F.sum(weight).cast("double").alias("weight"))


def community_cohesion(graph: Graph, members: DataFrame) -> DataFrame:
    """(community, members, internal, cohesion): internal edges over the pairs there could be; 1 for one member."""
    inside = placed_edges(graph, members, "CALLS", "IMPORTS").where("a = b").groupBy(F.col("a").alias("community")).agg(F.count(F.lit(1)).alias("internal"))
    n, internal = F.col("members"), F.coalesce("internal", F.lit(0))
    sized = members.groupBy("community").agg(F.count(F.lit(1)).alias("members")).join(inside, "community", "left")
    return sized.select("community", "members", internal.alias("internal"), F.when(n < 2, 1.0).otherwise(F.round(internal / (n * (n - 1) / 2), 6)).alias("cohesion"))


def community_coupling(graph: Graph, members: DataFrame) -> DataFrame:
    """(a, b, edges): edges across each unordered pair of communities."""
    cross = placed_edges(graph, members, "CALLS", "IMPORTS").where("a <> b")
    return cross.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("edges"))


def modularity(graph: Graph, members: DataFrame) -> DataFrame:
    """(modularity): the sum over merged edges within a community of (w - k_i k_j / 2m) / 2m."""
    w = cut(merged_weights(graph))
    m2 = w.agg(F.coalesce(F.sum("weight"), F.lit(0.0)) * 2).first()[0] or 1.0
    k = w.select(F.col("u").alias("uid"), "weight").unionByName(w.select(F.col("v").alias("uid"), "weight")).groupBy("uid").agg(F.sum("weight").alias("k")).join(members, "uid")
    of = lambda side: k.select(F.col("uid").alias(side), F.col("k").alias(f"k_{side}"), F.col("community").alias(f"c_{side}"))
    inside = w.join(of("u"), "u").join(of("v"), "v").where("c_u = c_v")
    return inside.agg(F.round(F.coalesce(F.sum((F.col("weight") - F.col("k_u") * F.col("k_v") / m2) / m2), F.lit(0.0)), 6).alias("modularity"))


def surprising_connections(graph: Graph, members: DataFrame, least: float = 0.1, limit: int = 50) -> DataFrame:
    """Calls across communities by surprise: 1 less the pair's share of all such calls."""
    cross = placed_edges(graph, members, "CALLS").where("a <> b").withColumns({"p": F.least("a", "b"), "q": F.greatest("a", "b")})
    pairs = cross.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n").alias("total"))
    scored = pairs.crossJoin(F.broadcast(total)).select("p", "q", F.round(1 - F.col("n") / F.col("total"), 6).alias("score"))
    return cross.join(scored, ["p", "q"]).where(F.col("score") >= least).select("src", "dst", "a", "b", "score").orderBy(F.desc("score"), "src", "dst").limit(limit)


def service_connections(graph: Graph, members: DataFrame) -> DataFrame:
    """(a, b, n, kinds): directed pairs of communities, their edges and kinds of edges."""
    each = [placed_edges(graph, members, k).where("a <> b").select("a", "b", F.lit(k).alias("kind")) for k in ("CALLS", "IMPORTS")]
    return each[0].unionByName(each[1]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def cross_edges(graph: Graph, members: DataFrame) -> DataFrame:
    """(uid, cross): edges that lead from or to another community, of every symbol."""
    cross = placed_edges(graph, members, "CALLS", "IMPORTS").where("a <> b")
    n = cross.select(F.explode(F.array("src", "dst")).alias("uid")).groupBy("uid").agg(F.count(F.lit(1)).alias("cross"))
    return graph.symbols.select("uid").join(n, "uid", "left").select("uid", F.coalesce("cross", F.lit(0)).alias("cross"))


def top_members(graph: Graph, members: DataFrame, n: int = 5) -> DataFrame:
    """(community, rank, uid, degree): the best connected members of each community."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "uid"))
    return members.join(degrees(graph, "CALLS", "IMPORTS"), "uid").withColumn("rank", rank).where(F.col("rank") <= n).select("community", "rank", "uid", "degree")


def dominant_kind(graph: Graph, members: DataFrame) -> DataFrame:
    """(community, kind, n): the most frequent kind of each community, the smallest name of equals."""
    n = members.join(graph.symbols.select("uid", "kind"), "uid").groupBy("community", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("x")).select("community", "x.kind", (-F.col("x.n")).alias("n"))


# --- rules, gaps, questions ----------------------------------------------------------------------


def arch_lint(graph: Graph, cycles: DataFrame | None = None, god: int = 20, fan_out: int = 10) -> DataFrame:
    """(rule, severity, subject, detail): cycles if given (component, size), god nodes, high fan-out, and
    stable modules that import unstable ones."""
    row = lambda df, rule, severity, subject, detail: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(subject).alias("subject"), detail.cast("string").alias("detail"))
    d = degrees(graph, "CALLS")
    out = row(d.where(F.col("degree") > god), "god_node", "Warning", "uid", F.col("degree"))
    out = out.unionByName(row(d.where(F.col("out_degree") > fan_out), "high_fan_out", "Warning", "uid", F.col("out_degree")))
    c = module_coupling(graph)
    of = lambda side: c.select(F.col("module").alias(side), F.col("afferent").alias(f"{side}_a"), F.col("instability").alias(f"{side}_i"))
    bad = module_edges(graph).join(of("src"), "src").join(of("dst"), "dst").where("src_i < 0.3 AND src_a > 0 AND dst_i > 0.7")
    out = out.unionByName(row(bad, "unstable_dependency", "Info", "src", F.col("dst")))
    return out if cycles is None else out.unionByName(row(cycles, "circular_dependency", "Error", "component", F.col("size")))


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "high", 0).when(F.col(c) == "medium", 1).otherwise(2)


def knowledge_gaps(graph: Graph, members: DataFrame, category: str | None = None) -> DataFrame:
    """(category, severity, subject, n): code called but not from tests, communities with one external call
    at most, communities of five and more code symbols without documents, and single links between two."""
    calls = graph.kind("CALLS")
    tests = graph.symbols.where(F.lower("file_path").contains("test")).select(F.col("uid").alias("src"))
    code = graph.symbols.where(F.col("kind").isin("Function", "Method")).select(F.col("uid").alias("dst"))
    called = calls.join(code, "dst").groupBy("dst").agg(F.count_distinct("src").alias("n")).where("n > 2")
    untested = called.join(calls.join(tests, "src").select("dst"), "dst", "left_anti")
    out = untested.select(F.lit("untested").alias("category"), F.when(F.col("n") > 5, "high").otherwise("medium").alias("severity"), F.col("dst").alias("subject"), "n")
    sized = members.join(graph.symbols.select("uid", "kind"), "uid").groupBy("community").agg(F.count_if(F.col("kind").isin(*CODE_KINDS)).alias("code"), F.count_if(F.col("kind").isin(*DOC_KINDS)).alias("docs"))
    cross = placed_edges(graph, members, "CALLS").where("a <> b")
    outside = cross.select(F.explode(F.array("a", "b")).alias("community")).groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    few = sized.join(outside, "community", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <= 1 AND code > 1")
    out = out.unionByName(few.select(F.lit("isolated").alias("category"), F.lit("medium").alias("severity"), F.col("community").alias("subject"), "n"))
    bare = sized.where("code >= 5 AND docs = 0")
    out = out.unionByName(bare.select(F.lit("undocumented").alias("category"), F.when(F.col("code") > 15, "high").when(F.col("code") > 8, "medium").otherwise("low").alias("severity"), F.col("community").alias("subject"), F.col("code").alias("n")))
    single = cross.groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    out = out.unionByName(single.select(F.lit("single_point_of_failure").alias("category"), F.lit("high").alias("severity"), F.concat_ws(" - ", "p", "q").alias("subject"), "n"))
    out = out if category is None else out.where(F.col("category") == category)
    return out.orderBy(severity_rank(), "category", "subject")


def suggested_questions(graph: Graph, changed: DataFrame, limit: int = 5) -> DataFrame:
    """(severity, category, subject, n) about ``changed`` (uid) symbols: many callers, calls across top
    directories, large files."""
    own = changed.join(graph.symbols, "uid").select("uid", "file_path")
    n = own.join(graph.kind("CALLS").select(F.col("dst").alias("uid"), "src"), "uid").groupBy("uid").agg(F.count_distinct("src").alias("n"))
    out = n.where("n > 10").select(F.when(F.col("n") > 20, "high").otherwise("medium").alias("severity"), F.lit("many_callers").alias("category"), F.col("uid").alias("subject"), "n")
    top = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    to = graph.symbols.select(F.col("uid").alias("dst"), top(F.col("file_path")).alias("to"))
    cross = own.join(graph.kind("CALLS"), F.col("uid") == F.col("src")).join(to, "dst").where(top(F.col("file_path")) != F.col("to")).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(cross.select(F.lit("low").alias("severity"), F.lit("cross_directory").alias("category"), F.col("uid").alias("subject"), "n"))
    large = own.select("file_path").distinct().join(graph.symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")), "file_path").where("n > 30")
    out = out.unionByName(large.select(F.lit("medium").alias("severity"), F.lit("large_file").alias("category"), F.col("file_path").alias("subject"), "n"))
    return out.orderBy(severity_rank(), "category", F.desc("n"), "subject").limit(limit)


def hotspots(graph: Graph, betweenness: DataFrame, churn: DataFrame, top: int = 20) -> DataFrame:
    """(uid, score): betweenness x (1 + commits / 100) x (0.5 + instability of the file); betweenness: (uid,
    centrality), churn: (uid, commits); without commits 1, without imports an instability of 0.5."""
    c = module_coupling(graph).select(F.col("module").alias("file_path"), "instability")
    rows = graph.symbols.select("uid", "file_path").join(betweenness, "uid", "left").join(churn, "uid", "left").join(c, "file_path", "left")
    score = F.coalesce("centrality", F.lit(0.0)) * (1 + F.coalesce("commits", F.lit(1)) / 100) * (0.5 + F.coalesce("instability", F.lit(0.5)))
    return rows.select("uid", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "uid").limit(top)


# --- owners, contracts, changes ------------------------------------------------------------------


def ownership(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, owner): of the rules (rule_no, pattern, owner) that match a file, the last; null if none does.

    A pattern is a directory "x/", "*.ext", "**/suffix", or a path or the beginning of one. Rules are few
    (a file's lines), so they are compared with every path."""
    p, f = F.col("pattern"), F.col("path")
    match = (
        F.when(p == "*", F.lit(True))
        .when(p.startswith("**/"), f.endswith(F.expr("substring(pattern, 3)")) | (f == F.expr("substring(pattern, 4)")))
        .when(p.startswith("*."), f.endswith(F.expr("substring(pattern, 2)")))
        .when(p.endswith("/"), f.startswith(F.ltrim(p, F.lit("/"))) | f.contains(F.concat(F.lit("/"), F.ltrim(p, F.lit("/")))))
        .otherwise((f == F.ltrim(p, F.lit("/"))) | f.startswith(F.concat(F.ltrim(p, F.lit("/")), F.lit("/"))))
    )
    won = files.join(rules, match).groupBy("path").agg(F.max_by("owner", "rule_no").alias("owner"))
    return files.select("path").join(won, "path", "left")


def contract_links(endpoints: DataFrame, symbols: DataFrame) -> DataFrame:
    """(operation, uid, confidence): the best symbol for each endpoint: the same name or its snake case 1.0,
    a name that contains it 0.7; the smallest uid of equals; no match, no uid."""
    snake = F.lower(F.regexp_replace("operation", "([a-z0-9])([A-Z])", "$1_$2"))
    own = endpoints.select("operation", snake.alias("snake")).distinct()
    s = symbols.select("uid", F.lower("name").alias("low"), "name")
    exact = own.select("operation", F.explode(F.array_distinct(F.array("operation", "snake"))).alias("name")).join(s.select("uid", "name"), "name").select("operation", "uid", F.lit(1.0).alias("confidence"))
    part = own.join(exact.select("operation"), "operation", "left_anti").join(s, F.col("low").contains(F.lower("operation")) | F.col("low").contains(F.col("snake"))).select("operation", "uid", F.lit(0.7).alias("confidence"))
    best = exact.unionByName(part).groupBy("operation").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "uid")).alias("x"))
    return own.select("operation").join(best, "operation", "left").select("operation", "x.uid", (-F.col("x.c")).alias("confidence"))


def snapshot(graph: Graph) -> DataFrame:
    """(part, uid, label): symbols as "kind  qualified name", edges as "kind  source -> target"."""
    s = graph.symbols.select(F.lit("symbol").alias("part"), "uid", F.concat_ws("  ", "kind", "qualified_name").alias("label"))
    of = lambda side: graph.symbols.select(F.col("uid").alias(side), F.col("qualified_name").alias(f"{side}_name"))
    e = graph.edges.join(of("source_uid"), "source_uid", "left").join(of("target_uid"), "target_uid", "left")
    name = lambda c: F.coalesce(c, F.lit("?"))
    uid = F.concat_ws("|", "source_uid", "kind", "target_uid")
    return s.unionByName(e.select(F.lit("edge").alias("part"), uid.alias("uid"), F.concat("kind", F.lit("  "), name("source_uid_name"), F.lit(" -> "), name("target_uid_name")).alias("label")))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(part, uid, label, change): what one of two snapshots has and the other doesn't."""
    one = lambda x, y, change: x.join(y.select("part", "uid"), ["part", "uid"], "left_anti").withColumn("change", F.lit(change))
    return one(after, before, "added").unionByName(one(before, after, "removed"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(changes, total, score): 100 less the percentage of changes, at least 0; 100 if both are empty."""
    size = before.groupBy("part").agg(F.count(F.lit(1)).alias("b")).join(after.groupBy("part").agg(F.count(F.lit(1)).alias("a")), "part", "full").agg(F.coalesce(F.sum(F.greatest("a", "b")), F.lit(0)).alias("total"))
    changes = snapshot_diff(before, after).agg(F.count(F.lit(1)).alias("changes"))
    score = F.when(F.col("total") == 0, 100.0).otherwise(F.round(F.greatest(F.lit(0.0), 100 - F.col("changes") / F.col("total") * 100), 6))
    return changes.crossJoin(size).select("changes", "total", score.alias("score"))


def community_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(label, was, is, change) of communities (label, n): added, removed, grown, shrunk or stable."""
    both = before.select("label", F.col("n").alias("was")).join(after.select("label", F.col("n").alias("is")), "label", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("is") > F.col("was"), "grown").when(F.col("is") < F.col("was"), "shrunk").otherwise("stable")
    return both.select("label", "was", "is", change.alias("change"))


def rationale_targets(rationales: DataFrame, symbols: DataFrame) -> DataFrame:
    """(rationale, uid): the first symbol of the same file below each rationale (rationale, file_path, line)."""
    none = F.lit(None).cast("string")
    marks = rationales.where("line IS NOT NULL").select("file_path", F.col("line").cast("long").alias("at"), F.col("rationale").cast("string").alias("rationale"), none.alias("uid"))
    both = marks.unionByName(symbols.select("file_path", F.col("start_line").cast("long").alias("at"), none.alias("rationale"), "uid"))
    # from a file's end upwards; a symbol of the rationale's own line comes after it
    upwards = Window.partitionBy("file_path").orderBy(F.desc("at"), F.col("rationale").isNull(), F.desc("uid")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = both.where("file_path IS NOT NULL AND at IS NOT NULL").withColumn("uid", F.last("uid", ignorenulls=True).over(upwards))
    return below.where("rationale IS NOT NULL AND uid IS NOT NULL").select("rationale", "uid")


def blame_of(blame: DataFrame, symbols: DataFrame) -> DataFrame:
    """(uid, commits, last_author): of blame lines (file_path, line, author, ts, hash) within each symbol."""
    rows = blame.join(symbols.select("uid", "file_path", "start_line", "end_line"), "file_path").where("line BETWEEN start_line AND end_line")
    return rows.groupBy("uid").agg(F.count_distinct("hash").alias("commits"), F.max(F.struct("ts", "author")).alias("x")).select("uid", "commits", F.col("x.author").alias("last_author"))


def rename_plan(sources: DataFrame, symbols: DataFrame, edges: DataFrame, old: str, new: str) -> DataFrame:
    """(file_path, line, before, after): lines of the files of the symbol and of those that call or import it
    where the name stands as a word; sources: (file_path, content)."""
    target = symbols.where(F.col("name") == old).select("uid", "file_path")
    users = edges.where(F.col("kind").isin("CALLS", "IMPORTS")).join(target.select(F.col("uid").alias("target_uid")), "target_uid", "left_semi").select(F.col("source_uid").alias("uid"))
    files = target.select("file_path").union(users.join(symbols, "uid").select("file_path")).distinct()
    word = rf"\b{old}\b"
    lines = sources.join(files, "file_path", "left_semi").select("file_path", F.posexplode(F.split("content", "\n")).alias("i", "before")).where(F.col("before").rlike(word))
    return lines.select("file_path", (F.col("i") + 1).alias("line"), "before", F.regexp_replace("before", word, new).alias("after"))
