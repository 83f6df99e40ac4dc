"""Embeddings, the inverted-file index, matching, and bounds that must not cut anything without a word."""

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.operators import embedding as E
from graphloom.operators import retrieval as R
from graphloom.operators import service
from graphloom.operators.catalog import Catalog
from graphloom.plans.planner import cypher
from graphloom.sources import files


def test_hashed_vectors(spark):
    docs = spark.createDataFrame([(1, "getUser get user"), (2, "user get"), (3, ""), (4, None), (5, "other words")], "id int, text string")
    got = {r.uid: r.vector for r in E.embedded(docs, "id", "text", E.Encoder(dims=64)).collect()}
    assert got[3] is None and got[4] is None and np.isclose(np.dot(got[1], got[1]), 1) and len(got[1]) == 64
    assert np.isclose(np.dot(got[1], got[2]), 1) and abs(np.dot(got[1], got[5])) < 0.9
    a, b = (E.embedded(docs, "id", "text", E.Encoder(dims=d)) for d in (64, 32))
    E.same_identity(a, a)
    with pytest.raises(ValueError, match="different encoders"):
        E.same_identity(a, b)


def test_index_finds_what_the_scan_finds(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=16) + 4 * np.eye(16)[i % 8]).tolist()) for i in range(600)] + [(9000, [0.0] * 16), (9001, None)]
    v = spark.createDataFrame(rows, "uid long, vector array<double>")
    index, centres = E.ivf_index(v)
    assert index.count() == 600
    asked = index.where("uid % 100 = 0").selectExpr("uid AS query_id", "vector")
    exact = {(x.query_id, x.uid) for x in R.knn(index.select("uid", "vector"), asked, 10).collect()}
    probes = E.enough_probes(index, centres)
    got = {(x.query_id, x.uid) for x in E.ivf_search(index, centres, asked, 10, probes).collect()}
    assert probes < len(centres) and len(exact & got) >= 0.9 * len(exact)
    every = {(x.query_id, x.uid) for x in E.ivf_search(index, centres, asked, 10, len(centres)).collect()}
    assert every == exact


def test_matching_is_one_to_one_by_falling_similarity(spark):
    r = np.random.default_rng(3)
    made = lambda tag, n: [(f"{tag}{i}", f"same{i}" if i < 3 else f"{tag}_{i}", (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(r.normal(size=(n, 3)))]
    a, b = made("a", 14), made("b", 11)
    got = {(x.source_uid, x.target_uid, x.way) for x in E.matched(*[spark.createDataFrame(x, "uid string, name string, vector array<double>") for x in (a, b)]).collect()}
    want, used = {(f"a{i}", f"b{i}", "name") for i in range(3)}, {f"{t}{i}" for t in "ab" for i in range(3)}
    for s, x, y in sorted((-round(float(np.dot(x[2], y[2])), 9), x[0], y[0]) for x in a for y in b):
        if -s >= 0.65 and not used & {x, y}:
            want.add((x, y, "vector"))
            used |= {x, y}
    assert got == want and any(w == "vector" for *_, w in want)


def test_large_files_keep_their_row(spark, tmp_path):
    for name, size in (("big.py", 700_000), ("small.py", 10), ("lib/a.zig", 5), ("lib/x.min.js", 5), ("lib/deep/b.dart", 5)):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n" * (size // 6 + 1))
    got = {r.path: (r.language, r.problem, r.content is None) for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got == {"big.py": ("Python", "too_large", True), "small.py": ("Python", None, False), "lib/a.zig": ("Zig", None, False), "lib/deep/b.dart": ("Dart", None, False)}
    some = files.source_files(spark, str(tmp_path), include=("lib/**",), exclude=("**/*.dart",))
    assert [r.path for r in some.collect()] == ["lib/a.zig"]


def test_specifications_of_another_form_are_passed_over(spark):
    specs = [("a", "paths: [1, 2]"), ("b", "paths: {/x: [1]}"), ("c", "paths: {/y: {get: {operationId: op}, post: null}}"), ("d", "- x")]
    got = files.openapi_endpoints(spark.createDataFrame(specs, "path string, content string")).collect()
    assert sorted((r.path, r.operation, r.method) for r in got) == [("c", "op", "GET"), ("c", "post_/y", "POST")]


def test_long_chains_of_types_and_circles(spark, tmp_path):
    rows = [(f"t{i}", f"t{i + 1}", [f"p{i}"]) for i in range(14)] + [("x", "y", ["px"]), ("y", "x", ["py"])]
    types = spark.createDataFrame(rows, "name string, extends string, properties array<string>")
    got = {r.name: r.properties for r in service.ontology_schema(types, ("t0", "X")).collect()}
    assert got == {"t0": sorted(f"p{i}" for i in range(14)), "x": ["px", "py"]}
    (tmp_path / "o.yaml").write_text("entity_types:\n- name: A\n  extends: B\n  properties: [{name: p}, q]\n- name: B\n")
    assert {(r.name, r.extends, tuple(r.properties)) for r in files.ontology_types(spark, str(tmp_path)).collect()} == {("A", "B", ("p", "q")), ("B", None, ())}


def test_walks_of_any_length(spark):
    n = 15
    symbols = spark.createDataFrame([(f"s{i}", f"s{i}", f"s{i}", "Function", "f", i, i) for i in range(n)], "uid string, name string, qualified_name string, kind string, file_path string, start_line long, end_line long")
    edges = spark.createDataFrame([(f"s{i}", f"s{i + 1}", "CALLS") for i in range(n - 1)], "source_uid string, target_uid string, kind string")
    g = Graph(symbols, edges, spark.createDataFrame([], "uid string, path string, language string, num_symbols long"))
    ask = lambda hops: {(int(r.a[1:]), int(r.b[1:])) for r in cypher(g, f"MATCH (a)-[:CALLS{hops}]->(b) RETURN a.uid AS a, b.uid AS b").collect()}
    want = lambda low, high: {(i, j) for i in range(n) for j in range(n) if low <= j - i <= high}
    for hops, low, high in (("*1..12", 1, 12), ("*", 1, n), ("*3..", 3, n), ("*7..9", 7, 9), ("*2", 2, 2)):
        assert ask(hops) == want(low, high), hops


def test_versions_registry_and_metadata(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    assert c.meta("encoder") is None and c.versions("registry").count() == 0
    for v in ("a", "b"):
        c.put_meta("encoder", v)
    assert c.meta("encoder") == "b" and [r.version for r in c.versions("index_meta").collect()] == [2, 1]
    assert c.read_version("index_meta", 1).first().value == "a"
    with pytest.raises(KeyError):
        c.read_version("index_meta", 7)
    c.register("one", "/src/one")
    c.register("two", "/src/two")
    assert [r.name for r in c.find("two").collect()] == ["two"] and c.find("nothing").count() == 0
    c.unregister("two")
    assert c.find("two").count() == 0
    c.record("decisions", {"id": "d1", "title": "old"})
    c.record("decisions", {"id": "d1", "title": "new"})
    assert [r.title for r in c.read("decisions").collect()] == ["new"]
    rows = spark.createDataFrame([(1, "r1"), (2, "r2")], "n int, repo_id string")
    for _ in range(3):
        c.append("things", rows)
    assert c.read("things").count() == 6 and c.read("things", "r1").count() == 3 and c.versions("things").count() == 3
    c.append("things", spark.createDataFrame([(3, "r1", "x")], "n int, repo_id string, more string"))
    assert sorted((r.n, r.more) for r in c.read("things", "r1").collect())[-1] == (3, "x")
