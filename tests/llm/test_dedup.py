"""Exact, line and near deduplication, and decontamination."""

import random
from collections import Counter, defaultdict

from graphloom.llm.decontaminate import decontaminate, drop_contaminated
from graphloom.llm.exact_dedup import MisraGries, exact_dedup
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.near_dedup import drop_near_duplicates, near_dedup, sketches

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_misra_gries_never_misses_a_frequent_key():
    r = random.Random(1)
    keys = [r.choice("ab") if r.random() < 0.5 else str(r.random()) for _ in range(5000)]
    m = MisraGries(8)
    for i in range(0, 5000, 100):
        m.add(keys[i : i + 100])
    true = Counter(keys)
    assert len(m.counts) <= 8
    assert all(true[k] - 5000 / 9 <= m.counts[k] <= true[k] for k in "ab")


def test_exact_dedup_cases(odd, none):
    rows = exact_dedup(odd, counters=2).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert (by[1].keep_id, by[1].group_size, by[1].kept) == (7, 4, False)
    assert by[7].kept and by[3].keep_id == 4 and by[4].group_size == 2
    assert by[None].keep_id is None and by[None].kept
    assert exact_dedup(none).count() == 0


def test_exact_dedup_brute_force(spark):
    r = random.Random(2)
    docs = [(i, r.choice(["hot", "HOT", "Éa", "éa", str(r.randrange(40))])) for i in range(600)]
    groups = defaultdict(list)
    for i, t in docs:
        groups[t.translate(LOW)].append(i)
    for row in exact_dedup(spark.createDataFrame(docs, "doc_id long, text string"), counters=4).collect():
        own = groups[dict(docs)[row.doc_id].translate(LOW)]
        assert (row.keep_id, row.group_size, row.kept) == (max(own), len(own), row.doc_id == max(own))


def test_line_dedup_cases(odd, none):
    rows = line_dedup(odd, min_docs=3).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert (by[1].text, by[1].n_lines, by[1].n_dropped) == ("", 2, 2)
    assert (by[3].text, by[3].n_lines, by[3].n_dropped) == ("", 1, 0)
    assert by[8].text == " \n\n " and by[5].text == "word " * 30_000 and by[None].text == "no id"
    assert by[1].ids == "b"  # other columns stay
    assert line_dedup(none).count() == 0


def brute_components(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((top(ids[a]), top(ids[b])))
                low[q] = p
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_corpus(seed):
    """Chains of edits whose ends are not alike, a large group around one text, exact copies, short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs = []
    for _ in range(12):
        text = [word() for _ in range(60)]
        for _ in range(6):
            docs.append(" ".join(text))
            for _ in range(r.randint(0, 3)):
                text[r.randrange(60)] = word()
    hub = [word() for _ in range(80)]
    for k in range(60):
        own = list(hub)
        for _ in range(k % 7):
            own[r.randrange(80)] = word()
        docs.append(" ".join(own).upper() if k % 2 else " ".join(own))
    docs += ["one", "One", "two words", "", None, "a b c d e", "A B C D E f"] * 2
    r.shuffle(docs)
    return list(enumerate(docs))


def test_near_dedup_brute_force(spark):
    for seed, size in ((1, 2), (2, 5)):
        docs = near_corpus(seed)
        want = brute_components(docs, size, 80)
        got = near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), size=size).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_cases(odd, none):
    by = {r.doc_id: r for r in near_dedup(odd, size=2).collect()}
    assert by[7].component_id == 1 and by[2].component_id == 1
    assert by[3].n_shingles == 0 and by[3].kept and by[4].component_id == 4 and by[8].kept
    assert by[5].n_shingles == 1
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 8, None}
    assert near_dedup(none).count() == 0


def test_sketches_fill_and_estimate():
    import numpy as np

    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 2**63, 500).astype(np.uint64))
    b = np.unique(np.concatenate([a[:450], r.integers(0, 2**63, 50).astype(np.uint64)]))
    s = sketches([a, b, a[:1]], 192)
    assert (s != np.iinfo(np.uint64).max).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_decontamination_finds_replaced_words_and_leaves_short_overlaps(spark, odd, none):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(30)]
    around = lambda x: " ".join([word() for _ in range(50)] + x + [word() for _ in range(50)])
    swapped = lambda n: [word() if i % n == n - 1 else w for i, w in enumerate(item)]
    docs = [(0, around(item)), (1, around(swapped(3))), (2, around(swapped(4))), (3, around(swapped(6))), (4, around(item[5:11])), (5, around([])), (6, " ".join(item).upper()), (7, None), (8, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, "short one"), (11, None), (12, "")], "item_id long, text string")
    got = {x.id: x for x in decontaminate(frame, bench).collect()}
    assert {i for i, x in got.items() if x.contaminated} == {0, 2, 3, 6} | ({1} if got[1].best_score >= 12 else set())
    assert got[0].items == "9" and got[0].best_score == 30 and got[4].best_score < 8
    assert drop_contaminated(odd, bench).count() == odd.count()
    assert decontaminate(frame, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(none, bench).count() == 0
    assert drop_contaminated(frame, bench).columns == ["doc_id", "text"]


def test_decontamination_finds_short_items_with_every_third_word_replaced(spark, tmp_path):
    import corpus_pipeline
    import duckdb
    from graphloom.llm.queries import ORACLES, op5_decontaminate

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = {n: [word() for _ in range(n)] for n in (11, 15, 20, 30, 31)}
    around = lambda x: " ".join([word() for _ in range(40)] + x + [word() for _ in range(40)])
    docs = [(100 * n + first, around([word() if i % 3 == first else w for i, w in enumerate(x)])) for n, x in items.items() for first in (0, 1, 2) if n > 11 or first == 2]
    clean = [(1, around(items[20][:8])), (2, around(items[15][:7])), (3, around(items[30][3:11])), (4, around([]))]
    spark.createDataFrame(docs + clean, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in op5_decontaminate(spark, str(tmp_path)).collect()}
    assert {i: x.items for i, x in got.items() if x.contaminated} == {i: str(i // 100) for i, _ in docs}
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = con.sql(f"SELECT doc_id, contaminated, n_items, best_score, items FROM ({ORACLES['op5_decontaminate']})").fetchall()
    assert {tuple(x[c] for c in ("doc_id", "contaminated", "n_items", "best_score", "items")) for x in got.values()} == set(want)
    kept = corpus_pipeline.benchmark(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if not x.contaminated}
