"""Reading source trees, documents and mail."""

from pyspark.sql import functions as F

from graphloom.functions.text import byte_head, tokenize
from graphloom.operators.builders import resolved_calls
from graphloom.sources import code, content, files, mailfiles

PY = '''import os
from .db import Database

class Service(Base):
    """Uses it."""
    @cached
    def load(self, key) -> int:
        # NOTE: slow
        return helper(self.db.find(key))

def helper(x):
    return x
'''
TS = """import { Database } from './db';
export class UserService {
  constructor(db) {
    this.db = db;
  }
  find(id) {
    return lookup(id);
  }
}
function lookup(id) { return id; }
"""


def test_identifiers(spark):
    cases = {"getUserById": "get user by id", "HTTPResponse2Go": "http response 2 go", "parse2JSONFast": "parse 2 json fast", "user_name": "user name", "ümlautCase": "ümlaut case", "": ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string")
    assert df.where(F.array_join(tokenize("x"), " ") != F.col("want")).count() == 0


def test_byte_head(spark):
    row = spark.createDataFrame([("aé漢🙂",)], "x string").select(*[byte_head(F.col("x"), n).alias(str(n)) for n in (1, 2, 3, 5, 6, 9, 10)]).first()
    assert list(row) == ["a", "a", "aé", "aé", "aé漢", "aé漢", "aé漢🙂"]


def test_code_facts_and_calls(spark):
    df = spark.createDataFrame([("a/s.py", "Python", PY), ("b/u.ts", "TypeScript", TS), ("c.py", "Python", "def broken(:"), ("d.zz", "None", "x")], "path string, language string, content string")
    facts = code.code_facts(df).cache()
    got = {(r.file_path, r.qualified_name, r.kind) for r in facts.where("fact = 'symbol'").collect()}
    assert {("a/s.py", "Service", "Class"), ("a/s.py", "Service.load", "Method"), ("a/s.py", "helper", "Function"), ("b/u.ts", "UserService", "Class"), ("b/u.ts", "UserService.find", "Method"), ("b/u.ts", "lookup", "Function")} <= got
    assert {r.target for r in facts.where("fact = 'import'").collect()} == {"os", ".db.Database", "./db"}
    symbols = code.symbols_of(facts, "r")
    callers = symbols.select(F.col("uid").alias("caller_uid"), "file_path", "qualified_name")
    calls = facts.where("fact = 'call'").select("file_path", "qualified_name", "target").join(callers, ["file_path", "qualified_name"])
    name = {r.uid: r.name for r in symbols.collect()}
    pairs = {(name[r.source_uid], name[r.target_uid]) for r in resolved_calls(calls, symbols, facts.where("fact = 'import'").select("file_path", "target")).collect()}
    assert {("load", "helper"), ("load", "find"), ("find", "lookup")} <= pairs


def test_source_tree(spark, tmp_path):
    for path, text in {"src/a.py": PY, "node_modules/x.js": "x", ".git/y.py": "y", "long.py": "z" * 6000, "bin.dat": "q", "docs/r.md": "# T"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\xfa")
    got = {r.path: (r.language, r.problem) for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": ("Python", None), "long.py": ("Python", "long_line"), "docs/r.md": ("Markdown", None), "bad.py": ("Python", "not_utf8")}


def test_sections_names_and_notebooks(spark):
    md = "intro\n# One\ntext\n## Two\n```\n# not\n```\n### Three\n# Four\n"
    df = spark.createDataFrame([("d", md), ("e", "flat")], "uid string, content string")
    assert sorted((r.title, r.level, r.start_line, r.end_line) for r in content.markdown_sections(df).collect()) == [("Four", 1, 9, 10), ("One", 1, 2, 8), ("Three", 3, 8, 8), ("Two", 2, 4, 8)]
    assert {tuple(r) for r in content.markdown_documents(df).collect()} == {("d", "One"), ("e", "document")}
    nb = '{"cells": [{"cell_type": "code", "source": ["a\\n", "b"]}, {"cell_type": "markdown", "source": ["# T"]}]}'
    got = content.notebook_cells(spark.createDataFrame([("n", nb)], "uid string, content string")).collect()
    assert [(r.cell, r.kind, r.first_line) for r in got] == [(0, "code", 1), (1, "markdown", 3)]


def test_rationales_endpoints_and_rules(spark):
    f = spark.createDataFrame([("a", PY)], "file_path string, content string")
    assert [(r.line, r.kind, r.text) for r in content.rationales(f).collect()] == [(8, "NOTE", "slow")]
    proto = spark.createDataFrame([("p", "service S { rpc Get (Req) returns (stream Res); }")], "path string, content string")
    assert [tuple(r) for r in files.rpc_endpoints(proto).collect()] == [("p", "Get", "Req", "Res")]


def test_mail(spark):
    one = b"From: Ann <ann@x.org>\r\nTo: bob@x.org, Cy <cy@x.org>\r\nSubject: Hi\r\nMessage-ID: <1@x>\r\nIn-Reply-To: <0@x>\r\nReferences: <0@x>\r\nDate: Mon, 1 Jan 2024 10:00:00 +0000\r\nContent-Type: text/html\r\n\r\n<p>Body</p>\r\n"
    box = b"From ann\n" + one.replace(b"\r\n", b"\n") + b"From bob\n" + one.replace(b"\r\n", b"\n").replace(b"<1@x>", b"<2@x>")
    rows = mailfiles.messages(spark.createDataFrame([("a.eml", bytearray(one)), ("b.mbox", bytearray(box))], "path string, content binary")).collect()
    assert [r.message_id for r in sorted(rows, key=lambda r: (r.path, r.message_id))] == ["1@x", "1@x", "2@x"]
    assert rows[0].to == ["bob@x.org", "cy@x.org"] and rows[0].in_reply_to == "0@x" and rows[0].body.strip() == "Body" and rows[0].sender_name == "Ann"
