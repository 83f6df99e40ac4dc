"""The pipeline against plain Python, and the training-data queries that have SQL against DuckDB."""

import unicodedata
from collections import Counter, defaultdict

import duckdb
import pytest
from test_dedup import LOW, brute_components
from test_oracles import TABLES, plain

import __spark_entry__
import corpus_pipeline
from graphloom import queries as graph_queries
from graphloom.llm.quality import score_quality, train_quality

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(set(__spark_entry__.oracle_sql()) - set(graph_queries.oracle_sql()))


def test_the_rest_of_the_sql_is_compared_here():
    assert set(NAMES) >= {"op4_line_dedup", "op5_decontaminate", "op8_warc", "op10_exact_dedup"}


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = __spark_entry__.queries()[name](spark, FOLDER).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    fix = lambda df: df.apply(lambda c: c.map(lambda x: float(x) if isinstance(x, int) and not isinstance(x, bool) else x))
    assert len(want) and plain(fix(got)) == plain(fix(want))


def brute_lines(docs):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOW)
    seen = defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            seen[key(x)].add(i)
    return {i: "\n".join(x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 10) for i, t in docs.items()}


def words(text):
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split()


def holds(text, item):
    """Whether any way to lay the item along the text scores enough or agrees enough."""
    own, places, agreed = words(text), defaultdict(list), Counter()
    for i, w in enumerate(own):
        places[w].append(i)
    for j, w in enumerate(item):
        agreed.update(i - j for i in places[w])
    for offset, n in agreed.items():
        now = best = 0
        for j, w in enumerate(item if n >= 8 else ()):
            now = max(now + (1 if 0 <= offset + j < len(own) and own[offset + j] == w else -1), 0)
            best = max(best, now)
        if best >= min(12, max(-(-len(item) * 45 // 100), 8)) or n >= max(-(-len(item) * 6 // 10), 8):
            return True
    return False


def test_pipeline_keeps_the_rows_that_plain_python_keeps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scored = score_quality(docs, train_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))).collect()
    good = {r.doc_id: r.text for r in scored if r.score >= 0.3}
    lines = brute_lines(good)
    components = brute_components(list(lines.items()), 5, 80)
    unique = {i: t for i, t in lines.items() if components[i][1] == i}
    items = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {i: t for i, t in unique.items() if not any(holds(t, x) for x in items)}
    assert docs.count() > len(good) > len(unique) > len(want) and lines != good
    assert {r.doc_id: r.text for r in corpus_pipeline.run(spark, FOLDER).collect()} == want
