"""Pattern queries and graph operators on small known graphs, against plain Python where that is simple."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import analytics, builders, catalog, changes, exports, iterative, mail, paths
from graphloom.operators import retrieval as R
from graphloom.plans.planner import cypher
from graphloom.plans.syntax import QueryError, parse

SYMBOLS = "uid string, name string, qualified_name string, kind string, file_path string, start_line long, end_line long"


def graph_of(spark, edges, nodes=None):
    names = nodes or sorted({x for a, b, _ in edges for x in (a, b)})
    symbols = spark.createDataFrame([(n, n, f"m.{n}", "Function", f"src/{n}.ts", i, i + 5) for i, n in enumerate(names)], SYMBOLS)
    e = spark.createDataFrame(edges or [("", "", "")], "source_uid string, target_uid string, kind string").where("kind <> ''")
    return Graph(symbols, e, spark.createDataFrame([], "uid string, path string"))


@pytest.fixture(scope="module")
def known(spark):
    rows = [("u_main", "main", "Function", "src/app.ts", 1), ("u_helper", "helper", "Function", "src/app.ts", 20), ("u_leaf", "leaf", "Function", "src/util.ts", 3), ("u_widget", "Widget", "Class", "src/widget.ts", 1)]
    symbols = spark.createDataFrame([(u, n, n, k, f, s, s + 5) for u, n, k, f, s in rows], SYMBOLS)
    edges = spark.createDataFrame([("u_main", "u_helper", "CALLS"), ("u_helper", "u_leaf", "CALLS"), ("u_main", "u_widget", "CALLS"), ("u_main", "F:src/app.ts", "CONTAINED_BY")], "source_uid string, target_uid string, kind string")
    return Graph(symbols, edges, spark.createDataFrame([("F:src/app.ts", "src/app.ts")], "uid string, path string"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_known_answers(known):
    assert [r[0] for r in cypher(known, "MATCH (n) RETURN n.name ORDER BY n.name").collect()] == ["Widget", "helper", "leaf", "main"]
    assert rows(cypher(known, "MATCH (n) WHERE n.kind = 'Function' RETURN n.name")) == [("helper",), ("leaf",), ("main",)]
    assert rows(cypher(known, "MATCH (a)-[:CALLS]->(b) RETURN a.name, b.name")) == [("helper", "leaf"), ("main", "Widget"), ("main", "helper")]
    assert cypher(known, "MATCH (n) RETURN n.name LIMIT 2").count() == 2
    assert rows(cypher(known, "MATCH (s)-[:CONTAINED_BY]->(f:File) RETURN s.name, f.path")) == [("main", "src/app.ts")]
    assert rows(cypher(known, "MATCH (n) RETURN n.kind AS k, count(*) AS n")) == [("Class", 1), ("Function", 3)]
    p = cypher(known, "MATCH p = shortestPath((a)-[*..5]->(b)) WHERE a.name = 'main' AND b.name = 'leaf' RETURN p, length(p) AS n").collect()
    assert len(p) == 1 and p[0].n == 2 and p[0].p.nodes == ["u_main", "u_helper", "u_leaf"]
    assert rows(cypher(known, "MATCH (n) RETURN plus(n.start_line) AS x LIMIT 1", functions={"plus": lambda c: c * 0 + 7})) == [(7,)]


@pytest.mark.parametrize("text", ["MATCH (n) DELETE n", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n:Function) RETURN n", "MATCH (n)", "MATCH (n) RETURN n LIMIT 2 nonsense", "MATCH (n) RETURN n ; x"])
def test_refused(known, text):
    with pytest.raises(QueryError):
        cypher(known, text)


def test_compatible_dialect(known):
    assert rows(cypher(known, "MATCH (n) RETURN count(*) AS n", compat=True)) == [(0,)]
    assert cypher(known, "MATCH (a)-[:CALLS]->(b), (c)-[:CALLS]->(b) RETURN a.name, c.name", compat=True).count() == 9
    assert cypher(known, "MATCH (a)-[:CALLS]-(b) RETURN a.name, b.name", compat=True).count() == 3
    for text in ("MATCH (n) RETURN DISTINCT n.kind", "MATCH (n {kind: 'Class'}) RETURN n.name"):
        with pytest.raises(QueryError):
            cypher(known, text, compat=True)


def test_parser_keeps_precedence():
    e = parse("MATCH (n) WHERE n.a = 1 OR n.b = 2 AND NOT n.c IS NULL RETURN n").where
    assert e.name == "or" and e.args[1].name == "and" and e.args[1].args[1].name == "not"


def random_edges(seed, n=14, m=30):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}", "CALLS") for _ in range(m)})


def reachable(edges):
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
    out = {}
    for s in {x for a, b, _ in edges for x in (a, b)}:
        dist, level = {s: 0}, [s]
        while level:
            level = [w for v in level for w in near[v] if w not in dist and not dist.update({w: dist[v] + 1})]
        out[s] = dist
    return out


def test_closures_components_and_depths(spark):
    edges = random_edges(1)
    g, want = graph_of(spark, edges), reachable(edges)
    seeds = g.symbols.select(F.col("uid").alias("seed"))
    got = {(r.seed, r.node): r.depth for r in paths.reach(g.kind("CALLS"), seeds, None).collect()}
    assert got == {(s, n): d for s, dist in want.items() for n, d in dist.items()}
    scc = defaultdict(set)
    for a in want:
        scc[min(b for b in want if b in want[a] and a in want[b])].add(a)
    strong = {n: c for c, own in scc.items() if len(own) > 1 for n in own}
    for small in (0, 500_000):  # the distributed way, and the one for a small rest
        assert {r.node: r.component for r in iterative.strong_components(g.inner("CALLS"), small=small).collect()} == strong


def test_betweenness_of_a_path_and_eigenvector(spark):
    w = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "u string, v string, weight double")
    got = {r.node: r for r in iterative.shortest_path_centralities(w).collect()}
    assert got["b"].betweenness == pytest.approx(2 / 3) and got["a"].betweenness == 0 and got["b"].closeness == pytest.approx(3 / 4)
    x = {r.node: r.value for r in iterative.eigenvector(w, 60).collect()}
    assert x["b"] == pytest.approx(x["c"], abs=1e-4) and x["b"] / x["a"] == pytest.approx(1.618, abs=1e-2)


def test_communities_find_two_cliques(spark):
    pairs = [(f"{s}{i}", f"{s}{j}", 1.0) for s in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 1.0)]
    got = {r.node: r.community for r in iterative.communities(spark.createDataFrame(pairs, "u string, v string, weight double")).collect()}
    assert got == {f"{s}{i}": f"{s}0" for s in "ab" for i in range(5)}


def test_parallel_and_mutual_edges_do_no_harm(spark):
    g = graph_of(spark, [("f", "g", "CALLS"), ("g", "f", "CALLS"), ("f", "g", "CALLS"), ("f", "g", "IMPORTS")])
    assert rows(analytics.merged_weights(g)) == [("f", "g", 11.0)]
    assert {r.uid: r.degree for r in analytics.degrees(g, "CALLS").collect()} == {"f": 3, "g": 3}


def test_hunks_and_changed_symbols(spark):
    from graphloom.more_queries import HUNKS, diff

    assert sorted(map(str, (tuple(r) for r in changes.diff_hunks(diff(spark)).collect()))) == sorted(map(str, HUNKS))


def test_threads_merge_groups(spark):
    empty = "cast(array() as array<string>) refs"
    m = spark.createDataFrame([("1", "a", None), ("2", "b", "a"), ("3", "c", None), ("4", "d", "c"), ("5", "e", None)], "uid string, message_id string, in_reply_to string").selectExpr("*", empty)
    assert rows(mail.threads(m)) == [("1", "1"), ("2", "1"), ("3", "3"), ("4", "3")]
    link = m.union(spark.createDataFrame([("6", "f", "b", ["d"])], "a string, b string, c string, d array<string>"))
    assert {r.thread for r in mail.threads(link).collect()} == {"1"}


def test_bm25_repeats_count_twice_and_empty_documents_count(spark):
    docs = spark.createDataFrame([("a", "red blue"), ("b", "red"), ("c", "")], "uid string, text string")
    post, dl = R.inverted_index(docs, "uid", "text")
    q = spark.createDataFrame([(1, "red"), (2, "red red")], "query_id int, text string")
    s = {(r.query_id, r.uid): r.score for r in R.bm25(post, dl, q).collect()}
    import math

    assert s[1, "b"] == pytest.approx(math.log((3 - 2 + 0.5) / 2.5 + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / 1)))
    assert s[2, "b"] == pytest.approx(2 * s[1, "b"])


def test_store(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}")
    assert c.read("symbols").count() == 0
    s = spark.createDataFrame([("1", "x", "a.py", "r"), ("2", "y", "b.py", "r"), ("3", "z", "c.py", "q")], "uid string, name string, file_path string, repo_id string")
    c.append("symbols", s)
    c.append("relationships", spark.createDataFrame([("e", "1", "2", "CALLS", "r")], "uid string, source_uid string, target_uid string, kind string, repo_id string"))
    c.append("files", spark.createDataFrame([("F:a.py", "a.py", "r")], "uid string, path string, repo_id string"))
    c.upsert("symbols", spark.createDataFrame([("1", "new", "a.py", "r")], "uid string, name string, file_path string, repo_id string"), "uid")
    assert rows(c.read("symbols", "r").select("uid", "name")) == [("1", "new"), ("2", "y")]
    c.delete_file("a.py")
    assert rows(c.read("symbols").select("uid")) == [("2",), ("3",)] and c.read("relationships").count() == 0
    c.delete_repo("r")
    assert rows(c.read("symbols").select("uid")) == [("3",)]


def test_class_diagram_and_json(spark):
    g = graph_of(spark, [("m", "k", "MEMBER_OF")])
    own = Graph(g.symbols.withColumn("kind", F.when(F.col("uid") == "k", "Class").otherwise("Method")), g.edges, g.files)
    assert exports.mermaid_classes(own).first().row == "    class k {\n        +m()\n    }"
    assert exports.json_rows(own).count() == 3


def test_member_of_takes_the_last_owner(spark):
    s = spark.createDataFrame([("1", "A", "A", "f", 1), ("2", "A", "A", "f", 9), ("3", "m", "A.m", "f", 10), ("4", "n", "A::n", "g", 1)], "uid string, name string, qualified_name string, file_path string, start_line long")
    assert rows(builders.member_of(s)) == [("3", "2", "MEMBER_OF")]


def plain_centralities(pairs, sources):
    """Betweenness (summed over sources) and closeness by counting shortest paths between all pairs."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def search(s):
        dist, ways, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], ways[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
        return dist, ways

    found, n = {v: search(v) for v in near}, len(near)
    between = {v: sum(found[s][1][v] * found[v][1][t] / found[s][1][t] for s in sources if s != v for t in found[s][0] if t not in (s, v) and v in found[s][0] and found[s][0][v] + found[v][0][t] == found[s][0][t]) for v in near}
    close = {s: (len(found[s][0]) - 1) ** 2 / sum(found[s][0].values()) / (n - 1) for s in sources}
    return {v: x / ((n - 1) * (n - 2)) for v, x in between.items()}, close


def test_centralities_of_all_sources_and_of_a_sample(spark):
    pairs = sorted({tuple(sorted((a, b))) for a, b, _ in random_edges(3, 24, 34) if a != b})
    w = spark.createDataFrame([(*p, 1.0) for p in pairs], "u string, v string, weight double")
    nodes = sorted({x for p in pairs for x in p})
    for sample in (nodes, nodes[::3]):
        between, close = plain_centralities(pairs, sample)
        some = None if sample is nodes else spark.createDataFrame([(x,) for x in sample], "node string")
        got = {r.node: r for r in iterative.shortest_path_centralities(w, some).collect()}
        assert {k: r.betweenness for k, r in got.items()} == pytest.approx({k: x * len(nodes) / len(sample) for k, x in between.items()})
        assert {k: r.closeness for k, r in got.items()} == {k: pytest.approx(close[k]) if k in close else None for k in nodes}


def test_registered_centralities_run_all_sources_of_larger_graphs(spark, monkeypatch):
    from graphloom import more_queries

    g = graph_of(spark, [(f"a{i}", f"b{i}", "CALLS") for i in range(2100)])
    monkeypatch.setattr(more_queries, "derived", lambda *_: g)
    got = more_queries.betweenness_closeness(spark, "").collect()
    assert len(got) == 4200 and all(r.closeness == pytest.approx(1 / 4199) for r in got)


def plain_steps(edges, roots, depth, budget):
    near, out = defaultdict(list), []
    for a, b, _ in sorted(edges):
        near[a].append(b)

    def walk(path, own):
        if len(own) < budget:
            own.append((path[0], len(own), len(path) - 1, path[-2] if len(path) > 1 else None, path[-1]))
            for x in near[path[-1]] if len(path) < depth else ():
                if x not in path:
                    walk([*path, x], own)

    for r in roots:
        own = []
        walk([r], own)
        out += own if len(own) > 1 else []
    return sorted(out, key=str)


def test_process_steps_spend_the_budget_while_expanding(spark, monkeypatch):
    from graphloom import more_queries

    names = [f"n{i:02}" for i in range(14)]
    chain = [(f"c{i}", f"c{i + 1}", "CALLS") for i in range(12)]
    every = [(a, b, "CALLS") for a in names for b in names if a != b] + [("m", "n00", "CALLS")]  # more than 10^9 paths of ten levels
    g = graph_of(spark, chain + every + [("z", "y", "CALLS")])
    monkeypatch.setattr(more_queries, "derived", lambda *_: g)
    want = plain_steps(chain + every + [("z", "y", "CALLS")], ["c0", "m", "z"], 10, 100)
    got = more_queries.process_tree_steps_whole(spark, "")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert max(x[2] for x in want) == 9 and sum(x[0] == "m" for x in want) == 100
    some = random_edges(5, 10, 25)
    roots = sorted({a for a, b, _ in some} - {b for a, b, _ in some}) or ["n00"]
    entries = spark.createDataFrame([(r,) for r in roots], "entry string")
    for budget in (1, 3, 20):
        got = iterative.process_steps(graph_of(spark, some), 6, budget, entries).collect()
        assert sorted((tuple(r) for r in got), key=str) == (plain_steps(some, roots, 6, budget) if budget > 1 else [(r, 0, 0, None, r) for r in roots if any(a == r for a, b, _ in some)])


def test_all_paths_take_halves_and_not_a_walk_for_every_pair(spark, monkeypatch):
    def plain(steps, pairs, depth):
        out = []

        def walk(a, b, nodes, edges):
            if nodes[-1] == b:
                out.append((a, b, nodes, edges))
            elif len(edges) < depth:
                for src, dst, kind in steps:
                    if src == nodes[-1] and dst not in nodes:
                        walk(a, b, (*nodes, dst), (*edges, kind))

        for a, b in pairs:
            walk(a, b, (a,), ())
        return sorted(out)

    rng, names = random.Random(11), [f"n{i}" for i in range(9)]
    edges = [(rng.choice(names), rng.choice(names), k) for k in ("e0", "e1") for _ in range(9)] + [("n0", "n1", "p"), ("n0", "n1", "q")]
    pairs = [(a, b) for a in names[:4] for b in names if rng.random() < 0.6] + [("n0", "n0"), ("n0", "n1"), ("n0", "n1"), ("n8", "elsewhere")]
    for both in (True, False):
        ways = [(a, b, f"{a}{k}{b}") for a, b, k in edges] + [(b, a, f"{a}{k}{b}") for a, b, k in edges if both]
        steps = spark.createDataFrame([(a, b, (a, b, k)) for a, b, k in ways], "src string, dst string, step struct<source:string,target:string,relationship:string>")
        for depth in (1, 2, 5):
            found = paths.all_paths(steps, spark.createDataFrame(pairs, "a string, b string"), depth).collect()
            got = sorted((r.a, r.b, tuple(r.nodes), tuple(e.relationship for e in r.edges)) for r in found)
            assert got == plain(ways, sorted(set(pairs)), depth)

    written, cut = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: [x := cut(df), written.append(x.count())][0])
    star = [(f"a{i}", f"h{i % 5}") for i in range(30)] + [("h0", "m"), ("m", "b0")] + [(f"b{i}", f"k{i}") for i in range(30)]
    steps = spark.createDataFrame([(x, y, (a, b, "E")) for a, b in star for x, y in ((a, b), (b, a))], steps.schema)
    pairs = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(30) for j in range(30)], "a string, b string")
    assert paths.all_paths(steps, pairs, 4).count() == 6
    assert written.pop(1) == 900 and max(written) < 200  # the pairs; no step has a row for each of them


def test_centralities_of_what_hangs_on_the_rest(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted((a, b))) for a, b, _ in random_edges(9, 12, 18) if a != b}
    pairs |= {(f"n{rng.randrange(12):02}", f"t{i}") for i in range(6)} | {(f"t{rng.randrange(i)}", f"t{i}") for i in range(6, 16)}  # trees on some of them
    pairs |= {("x0", "x1"), ("x1", "x2"), ("x2", "x3"), ("x3", "x0"), ("x3", "x4"), ("y0", "y1")}  # others: a ring with a tail, a pair
    nodes = sorted({x for p in pairs for x in p})
    w = spark.createDataFrame([(*p, 1.0) for p in sorted(pairs)], "u string, v string, weight double")
    for sample in (nodes, nodes[::3], ["t15", "elsewhere"]):
        own = [x for x in sample if x in nodes]
        between, close = plain_centralities(pairs, own)
        got = {r.node: r for r in iterative.shortest_path_centralities(w, None if sample is nodes else spark.createDataFrame([(x,) for x in sample], "node string")).collect()}
        assert {k: r.betweenness for k, r in got.items()} == pytest.approx({k: x * len(nodes) / len(own) for k, x in between.items()})
        assert {k: r.closeness for k, r in got.items()} == {k: pytest.approx(close[k]) if k in close else None for k in nodes}
    assert iterative.shortest_path_centralities(w.limit(0)).collect() == []


def test_centralities_of_trees_need_no_search(spark):
    import time

    chain, leaves = 2_500, 30_000  # a search from every node takes more than a minute
    w = spark.range(chain - 1).selectExpr("'c' || id u", "'c' || (id + 1) v").unionByName(spark.range(leaves).selectExpr("'hub' u", "'l' || id v"))
    began, n = time.monotonic(), chain + leaves + 1
    got = {r.node: r for r in iterative.shortest_path_centralities(w).collect()}
    assert time.monotonic() - began < 60 and len(got) == n
    assert got["hub"].betweenness == pytest.approx(leaves * (leaves - 1) / (n - 1) / (n - 2)) and got["l7"].betweenness == 0
    assert got["hub"].closeness == pytest.approx(leaves / (n - 1)) and got["l7"].closeness == pytest.approx(leaves / (2 * leaves - 1) * leaves / (n - 1))
    assert [got[f"c{i}"].betweenness for i in range(chain)] == pytest.approx([2 * i * (chain - 1 - i) / (n - 1) / (n - 2) for i in range(chain)])
    assert got["c0"].closeness == pytest.approx(2 / chain * (chain - 1) / (n - 1))


def test_centrality_report_breaks_ties_by_uid_and_not_by_rounding(spark):
    from graphloom.operators import reports

    g = graph_of(spark, [], ["a", "b", "c", "d", "e"])
    values = spark.createDataFrame([("a", 0.1 + 0.2), ("b", 0.3), ("c", 0.1 + 0.1 + 0.1), ("d", 0.3000001), ("e", None)], "node string, betweenness double")
    assert [r.uid for r in reports.centrality_report(values.where("node <> 'a'").unionByName(values.where("node = 'a'")), g.symbols, limit=5).collect()] == ["d", "a", "b", "c", "e"]
    exact = spark.createDataFrame([("a", 0.3), ("b", 0.1 + 0.2)], values.schema)
    assert [r.uid for r in reports.centrality_report(exact, g.symbols).collect()] == ["a", "b"]


def test_centralities_take_the_pairs_of_a_gigabyte_of_tables(spark):
    n = 2_151_481  # 60 copies of sf0.1 have 2,151,480 pairs; a bound of 2,000,000 refused them
    w = spark.range(n - 1).selectExpr("'hub' u", "'l' || id v")
    got = iterative.shortest_path_centralities(w).selectExpr("count(*)", "sum(betweenness)", "max(closeness)").first()
    assert got[0] == n and got[1:] == (pytest.approx(1), pytest.approx(1))
    with pytest.raises(ValueError, match="more than 4 pairs"):
        iterative.shortest_path_centralities(w.limit(5), most_edges=4)


def test_sources_passed_together_are_as_passed_one_by_one(spark):
    import time

    import numpy as np

    rng = np.random.default_rng(5)

    def adjacency(pairs):
        pairs = np.array(sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]}))
        tail, head = np.concatenate([pairs, pairs[:, ::-1]]).T
        return np.concatenate([[0], np.cumsum(np.bincount(tail))]), head[np.lexsort((head, tail))].astype(np.int32)

    tree = lambda n: [(i, int(rng.integers(i))) for i in range(1, n)]
    more = lambda n, k: [(int(a), int(b)) for a, b in rng.integers(n, size=(k, 2))]
    ring = lambda n: [(i, (i + 1) % n) for i in range(n)]
    for pairs, k in ((tree(2), 2), (tree(9) + more(9, 5), 7), (tree(70) + more(70, 60), 70), (tree(200) + more(200, 900), 131), (ring(40), 5), (ring(2 * iterative.DEEP), 9), (ring(2 * iterative.DEEP + 2), 9), (tree(20_000) + more(20_000, 20_000), 5), (tree(70_000), 4)):
        first, ends = adjacency(pairs)
        n = len(first) - 1
        size, own, times = rng.integers(1, 5, n).astype(float), np.sort(rng.permutation(n)[:k]), rng.integers(1, 4, k).astype(float)
        between, total = iterative.sweeps(first, ends, size, own, times)
        one = [iterative.sweep(first, ends, size, s) for s in own]
        want = sum(t * share for t, (share, _) in zip(times, one, strict=True))
        assert np.allclose(between, want, rtol=1e-12, atol=0) and list(total) == [t for _, t in one]
        assert not between[want == 0].any()  # no rest of a rounding where no path passes

    first, ends = adjacency(tree(6_000) + more(6_000, 5_000))  # 3.8 ms a source one by one, 1.2 together
    size, own = np.ones(6_000), np.arange(64)
    took = {}
    for name, f in (("one", lambda: [iterative.sweep(first, ends, size, s) for s in own]), ("all", lambda: iterative.sweeps(first, ends, size, own, np.ones(64)))) * 3:
        began = time.perf_counter()
        f()
        took[name] = min(took.get(name, 9.0), time.perf_counter() - began)
    assert took["all"] < 0.75 * took["one"]

    pairs = [(f"n{a:03}", f"n{b:03}") for a, b in tree(150) + more(150, 150) if a != b]
    pairs += [(f"r{a:03}", f"r{b:03}") for a, b in ring(2 * iterative.DEEP + 6)] + [("x", "y"), ("y", "z"), ("x", "z")]
    w = spark.createDataFrame([(min(p), max(p), 1.0) for p in set(map(frozenset, pairs)) for p in [tuple(p)]], "u string, v string, weight double")
    nodes = {x for p in pairs for x in p}
    between, close = plain_centralities([tuple(r)[:2] for r in w.collect()], sorted(nodes))
    got = {r.node: r for r in iterative.shortest_path_centralities(w).collect()}
    assert {k: r.betweenness for k, r in got.items()} == pytest.approx(between) and {k: r.closeness for k, r in got.items()} == pytest.approx(close)
