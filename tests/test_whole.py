"""Queries over whole tables that SQL can't express, or not alone, against plain Python."""

import re
import unicodedata
from collections import defaultdict

from graphloom.operators import retrieval as R
from graphloom.operators import service as S
from graphloom.queries import queries

def test_embedding_text_cuts_long_texts_at_a_character(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {d.doc_id: " ".join(["Document", d.source, d.lang, d.text.encode()[:1792].decode(errors="ignore")]) for d in docs}
    assert any(len(d.text.encode()) > 1792 for d in docs)
    assert {r.doc_id: r.text for r in queries()["embedding_text"](spark, folder).collect()} == want


def test_knowledge_query_reads_mentions_of_all_matching_symbols(spark):
    symbols = [(f"s{i:03}", "wanted " + "other " * i) for i in range(150)]  # the longer, the lower its score
    post, lengths = R.inverted_index(spark.createDataFrame(symbols, "uid string, text string"), "uid", "text")
    mentions = spark.createDataFrame([("d1", "s149"), ("d2", "s120"), ("d3", "s000")], "uid string, target string")
    content = spark.createDataFrame([(f"d{i}", "Document", f"d{i}") for i in (1, 2, 3)], "uid string, kind string, name string")
    got = S.knowledge_query(post, lengths, mentions, content, spark.createDataFrame([(1, "wanted")], "query_id int, text string"))
    assert sorted((r.uid, r.target) for r in got.collect()) == [("d1", "s149"), ("d2", "s120"), ("d3", "s000")]


def test_mentions_of_names_that_occur(spark):
    folder = "/root/testdata/sf0.001"
    want = defaultdict(list)
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        for i, line in enumerate(d.text.split("\n")):
            for w in "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in line).split():
                looks = "_" in w or re.search("[0-9]", w) or re.fullmatch("[A-Z]{3,}", w) or re.search("[a-z]", w) and re.search(".[A-Z]", w)
                if len(w) >= 3 and looks and any(c.isalpha() for c in w):
                    want[f"D{d.doc_id}", f"N{w}"].append(i + 1)
    got = {(r.uid, r.target): (r.n, r.lines) for r in queries()["mentions"](spark, folder).collect()}
    assert got and got == {k: (len(x), ",".join(map(str, sorted(set(x))))) for k, x in want.items()}
