"""Stored records, re-indexing against indexing anew, the rule language, modules, history, pictures, kept results."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.cache import ResultCache
from graphloom.graph import Graph
from graphloom.operators import changes, modules, pictures, records
from graphloom.operators.catalog import Catalog
from graphloom.sources import history, rules
from graphloom.sources.code import code_facts
from graphloom.streaming import reindex

SAMPLES = {
    "Lua": ("local m = require('net')\nfunction m.load(x)\n  if x then\n    go(x)\n  end\nend\nlocal g = function() return 1 end\n", {("load", "Function", 2, 6), ("g", "Function", 7, 7)}, {("load", "go")}, {"net"}),
    "Bash": ("source lib.sh\n# f() {\nrun() {\n  local x=${1}\n  build all\n}\n", {("run", "Function", 3, 6)}, {("run", "build")}, {"lib.sh"}),
    "Zig": ('const std = @import("std");\npub const P = struct {\n    pub fn at(self: P) u8 {\n        return get(self);\n    }\n};\n', {("P", "Class", 2, 6), ("at", "Method", 3, 5)}, {("P.at", "get")}, {"std"}),
    "PowerShell": ("Import-Module Net\nfunction Get-Page {\n  $x = Read-Site\n}\n", {("Get-Page", "Function", 2, 4)}, {("Get-Page", "Read-Site")}, {"Net"}),
    "Elixir": ("defmodule A.B do\n  alias A.C\n  def f(x), do: x\n  def g(x) do\n    f(x)\n  end\nend\n", {("A.B", "Module", 1, 7), ("f", "Method", 3, 3), ("g", "Method", 4, 6)}, {("A.B.g", "f")}, {"A.C"}),
    "Objective-C": ("#import <A/B.h>\n@implementation Box\n- (void)open:(int)x {\n  [self close];\n}\n@end\n", {("Box", "Class", 2, 6), ("open", "Method", 3, 5)}, {("Box.open", "close")}, {"A/B.h"}),
    "Dart": ("import 'a.dart';\nclass Box {\n  int size(int x) {\n    return count(x);\n  }\n}\nint one() => two();\n", {("Box", "Class", 2, 6), ("size", "Method", 3, 5), ("one", "Function", 7, 7)}, {("Box.size", "count"), ("one", "two")}, {"a.dart"}),
    "SQL": ("CREATE TABLE t (\n  a int\n);\ncreate view v as select 1;\n", {("t", "Class", 1, 3), ("v", "Class", 4, 4)}, set(), set()),
    "Vue": ("<template><p/></template>\n<script>\nimport x from './x'\nfunction f() {\n  g()\n}\n</script>\n<style>a(){}</style>\n", {("f", "Function", 4, 6)}, {("f", "g")}, {"./x"}),
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_rules_of_languages(language):
    text, symbols, calls, imports = SAMPLES[language]
    got = list(rules.facts(text, rules.parse_rules(rules.RULE_TEXT)[language]))
    assert {(f["name"], f["kind"], f["start_line"], f["end_line"]) for f in got if f["fact"] == "symbol"} == symbols
    assert {(f["qualified_name"], f["target"]) for f in got if f["fact"] == "call"} == calls
    assert {f["target"] for f in got if f["fact"] == "import"} == imports


@pytest.mark.parametrize("text", ["scope Function (x)", "language A\nscope Thing (x)", "language A\nscope Function x", "language A\nblock until", "language A\nnothing x", "language A\nlike B", "language A\nimport (", "language A\nblock sideways"])
def test_rules_that_are_wrong_name_their_line(text):
    with pytest.raises(ValueError, match="rule line"):
        rules.parse_rules(text)


def test_own_rules_replace_what_is_built_in(spark):
    files = spark.createDataFrame([("a.py", "Python", "task one\n  use two\n"), ("b.py", "Python", ""), ("c.py", "Python", None)], "path string, language string, content string")
    own = "language Python\nblock line\nscope Function ^task (\\w+)\ncall use (\\w+)\n"
    assert [(r.fact, r.name) for r in code_facts(files, own).collect()] == [("symbol", "one")]
    assert code_facts(files).count() == 0


def tables(catalog, repo):
    out = {}
    for name, columns in reindex.COLUMNS.items():
        names = [c.split()[0] for c in columns.split(", ")]
        out[name] = sorted(map(str, catalog.read(name, repo).select(*names).collect()))
    return out


def test_reindexing_gives_what_indexing_gives(spark, tmp_path):
    r = np.random.default_rng(5)
    schema = "path string, language string, content string"
    text = lambda k: f"from m{r.integers(6)} import f{r.integers(6)}\n" * int(r.integers(2)) + "".join(f"def f{r.integers(6)}():\n    f{r.integers(6)}()\n    x.f{r.integers(6)}()\n" for _ in range(r.integers(1, 3)))
    files = {f"m{k}.py": text(k) for k in range(6)}
    df = lambda own: spark.createDataFrame([(p, "Python", t) for p, t in own.items()], schema)
    c = Catalog(spark, str(tmp_path / "a"))
    reindex.index(c, df({"o.py": "def o():\n    o()\n"}), "other")
    other = tables(c, "other")
    reindex.index(c, df(files), "r")
    changed = {"m1.py": text(1), "m4.py": "def f9():\n    f0()\n", "new.py": text(9)}
    files = {p: t for p, t in (files | changed).items() if p != "m2.py"}
    gone = spark.createDataFrame([("m2.py",)], "path string")
    reindex.reindex(c, df(changed), gone, "r")
    anew = Catalog(spark, str(tmp_path / "b"))
    reindex.index(anew, df(files), "r")
    want = tables(anew, "r")
    assert tables(c, "r") == want and any("CALLS" in x for x in want["relationships"])
    assert tables(c, "other") == other


def test_a_running_stream_of_changes(spark, tmp_path):
    c, schema = Catalog(spark, str(tmp_path / "c")), "path string, language string, content string"
    texts = {"a.py": "def a():\n    b()\n", "b.py": "def b():\n    pass\n"}
    now = lambda: spark.createDataFrame([(p, "Python", t) for p, t in texts.items()], schema)
    reindex.index(c, now(), "r")
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = spark.readStream.schema("path string, removed boolean, ts timestamp").json(str(feed))
    query = reindex.watch(rows, c, lambda paths: now().join(paths, "path", "left_semi"), "r", str(tmp_path / "k"))
    try:
        texts["a.py"] = "def a2():\n    b()\n"
        (feed / "1.json").write_text('{"path":"a.py","removed":true,"ts":"2024-01-01T00:00:00Z"}\n{"path":"a.py","removed":false,"ts":"2024-01-01T00:00:01Z"}\n{"path":"b.py","removed":true,"ts":"2024-01-01T00:00:00Z"}\n')
        until = time.monotonic() + 90
        while not query.lastProgress or query.lastProgress["batchId"] < 1 and time.monotonic() < until:
            time.sleep(0.5)
            if query.lastProgress and query.lastProgress["numInputRows"] == 0:
                break
        assert query.exception() is None
    finally:
        query.stop()
    assert {x.name for x in c.read("symbols", "r").collect()} == {"a2"}
    assert c.read("relationships", "r").where("kind = 'CALLS'").count() == 0


def test_snapshots_decisions_services_and_teams(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    assert records.snapshots(c, "r").count() == 0 and records.load_snapshot(c, "r") is None and records.decisions(c, "r").count() == 0
    g = Graph(spark.createDataFrame([("a", "a", "Function", "f")], "uid string, name string, kind string, file_path string"), spark.createDataFrame([], "source_uid string, target_uid string, kind string"), None)
    first = records.save_snapshot(c, g, "r", "2024-01-01T00:00:00+00:00")
    records.save_snapshot(c, Graph(g.symbols.where("false"), g.edges, None), "r", "2024-01-02T00:00:00+00:00", "x")
    assert [(s.commit_sha, s.symbol_count, s.edge_count) for s in records.snapshots(c, "r").collect()] == [("x", 0, 0), (None, 1, 0)]
    assert records.load_snapshot(c, "r", first)[0].count() == 1 and records.load_snapshot(c, "r")[0].count() == 0
    assert records.load_snapshot(c, "r", "none") is None and records.load_snapshot(c, "s") is None
    with pytest.raises(KeyError):
        records.link_decision(c, "r", "1", "a", "t")
    records.create_team(c, "t", "Team", "u1")
    records.add_member(c, "t", "u2")
    records.add_member(c, "t", "u2", "lead")
    assert [(x.user_id, x.role) for x in records.team_members(c, "t").collect()] == [("u2", "lead")] and records.teams(c).count() == 1


def test_append_of_other_columns_writes_the_table_anew(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    for rows, schema in (([(1, "a")], "k long, x string"), ([("b", 2)], "x string, k long"), ([(3, 0.5)], "k long, y double")):
        c.append("t", spark.createDataFrame(rows, schema))
    assert sorted((r.k, r.x, r.y) for r in c.read("t").collect()) == [(1, "a", None), (2, "b", None), (3, None, 0.5)]


def test_module_names(spark):
    files = spark.createDataFrame([("src/auth/service.py",), ("src/auth/__init__.py",), ("src/web/index.ts",), ("src/auth/mod.rs",), ("lib/a.go",), ("Makefile",)], "file_path string")
    got = {}
    for r in modules.module_paths(files).collect():
        got.setdefault(r.file_path, set()).add(r.module)
    assert got["src/auth/service.py"] == {"src/auth/service.py", "auth.service", "auth/service", "auth/service.py"}
    assert "auth" in got["src/auth/__init__.py"] and got["src/web/index.ts"] == {"src/web/index.ts", "./web", "web", "web/index.ts"}
    assert got["src/auth/mod.rs"] == {"src/auth/mod.rs", "auth", "crate::auth"} and got["lib/a.go"] == {"lib/a.go", "lib/a"} and got["Makefile"] == {"Makefile"}
    symbols = spark.createDataFrame([("src/auth/service.py", "Login", 1, "u1"), ("src/web/index.ts", "Page", 1, "u2")], "file_path string, name string, start_line long, uid string")
    imports = spark.createDataFrame([("m.py", "auth.service", "Login", "L"), ("m.ts", "./auth/service", "Login", None), ("m.ts", "./web", "Page", None), ("m.ts", "./web", "None", None)], "file_path string, module string, name string, alias string")
    assert {(r.local, r.uid) for r in modules.resolved_imports(imports, symbols).collect()} == {("L", "u1"), ("Login", "u1"), ("Page", "u2"), ("None", None)}


def test_blame(spark):
    h, k = "a" * 40, "b" * 40
    text = f"{h} 1 1 1\nauthor Ann\nauthor-time 7\nsummary x\n\tauthor Bob\n{k} 2 2 1\nauthor Eve\nauthor-time 9\n\t\n{h} 3 3\n\tend"
    rows = spark.createDataFrame([("f", text), ("g", ""), ("n", None)], "file_path string, text string")
    assert sorted((r.file_path, r.line, r.author, r.ts) for r in history.blame_lines(rows).collect()) == [("f", 1, "Ann", 7), ("f", 2, "Eve", 9), ("f", 3, "Ann", 7)]


def test_pictures(spark):
    at = pictures.layout(6, np.array([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]))
    near = lambda a, b: float(np.linalg.norm(at[a] - at[b]))
    assert np.array_equal(at, pictures.layout(6, np.array([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)])))
    assert max(near(0, 1), near(1, 2), near(3, 4)) < min(near(0, 3), near(1, 4), near(2, 5)) and len(pictures.layout(0, np.zeros((0, 2)))) == 0
    g = Graph(spark.createDataFrame([("a", "<a>"), ("b", None)], "uid string, name string"), spark.createDataFrame([("a", "b", "CALLS"), ("a", "a", "CALLS")], "source_uid string, target_uid string, kind string"), None)
    picture = pictures.svg(g, "CALLS")
    assert picture.count("<line") == 1 and picture.count("<circle") == 2 and "&lt;a&gt;" in picture
    with pytest.raises(ValueError, match="at most"):
        pictures.svg(g, "CALLS", most=1)


def test_kept_results(spark):
    now, built = [0.0], []
    cache = ResultCache(most=2, ttl=10, clock=lambda: now[0])

    def get(query, repo="r"):
        return cache.get(query, repo, "c", lambda: built.append(query) or spark.range(1)).count()

    get("a"), get("a")
    now[0] = 1
    get("b"), get("c"), get("b")  # a is the oldest and goes
    get("a")
    now[0] = 20
    get("a")
    cache.invalidate("r")
    get("a")
    assert built == ["a", "b", "c", "a", "a", "a"] and (cache.hits, cache.misses) == (2, 6)


def test_steps_of_an_empty_plan(spark):
    none = spark.createDataFrame([], "name string, status string")
    assert [(r.ordinal, r.category, r.needs, r.effort, r.risks) for r in changes.adaptation_steps(none).orderBy("ordinal").collect()] == [(1, "analyze", "", "small", ""), (2, "verify", "1", "small", "")]
    one = none.unionByName(spark.createDataFrame([("a", "source_only"), ("b", "matched"), ("c", "target_only")], "name string, status string"))
    got = changes.adaptation_steps(one, critical=True).orderBy("ordinal").collect()
    assert [(r.category, r.n, r.needs) for r in got] == [("analyze", 3, ""), ("create", 1, "1"), ("adapt", 1, "1,2"), ("remove", 1, "3"), ("verify", 0, "4")]
    assert got[0].risks == "removal may break callers outside; more unmatched than matched; critical structural differences"
    assert records.preferred(one.limit(0), one, "name").agg(F.count(F.lit(1))).first()[0] == 3
