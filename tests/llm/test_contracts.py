"""Contract columns, hot keys, bounds and samples of the training-data operators, against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_components

import corpus_pipeline
from graphloom.llm import near_dedup, pii, queries, toxicity, warc
from graphloom.llm.common import written
from graphloom.llm.labelled import labelled_sample
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.packing import RankTokenizer, pack, read_packed_rows, write_packed


def brute_base(text):
    luhn = lambda d: sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15),
    )
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_spans_and_digests_of_the_query(spark, odd, tmp_path):
    r = random.Random(5)
    texts = ["".join(r.choice(("1", "4", "0", " ", "-", "+", "(", ")", ".", "a", "@", "é", "4539148803436467", "10.0.0.7", "+1 (555) 123-4567", "x.y@z.org", "\n")) for _ in range(r.randint(0, 40))) for _ in range(800)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000, None), (10_001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op2_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = brute_base(t or "")
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        x = got[i]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == y[0] for y in base) for k in pii.KINDS]
        assert x.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        every = x.spans.split(",") if x.spans else []
        assert [s for s in every if s in set(joined)] == joined and len(every) == x.n_spans
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)


def test_planted_secrets_are_found():
    r, found = random.Random(8), 0
    for _ in range(200):
        secret = "".join(r.choice("0123456789abcdef") for _ in range(30)) + "a1"
        text = f"some words before api_key: {secret} and after"
        found += ("secret", 27, 59, False) in pii.all_spans(text, pii.trained())
    assert found > 180


def test_long_tables_of_numbers_pass_in_flat_memory():
    field, peaks = pii.trained(), []
    for n in (1500, 6000):
        text = " ".join(str(random.Random(i).randint(0, 99999)) for i in range(n))
        tracemalloc.start()
        sum(1 for a, b in pii.stretches(text) for _ in field.entities(text, a, b))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 200_000


def test_rare_and_hot_lines_take_ways_of_the_same_result(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(i, f"shared\nown {i}\n" + "hot\n" * (i % 3)) for i in range(40)], "doc_id long, text string"), allowMissingColumns=True)
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(line_dedup(docs, min_docs=3))
    assert plain(line_dedup(docs, min_docs=3, heavy=1)) == want and any("n_dropped=2" in x for x in want)


def test_a_group_of_more_than_a_thousand_near_copies(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(1400):
        own = list(base)
        own[r.randrange(60)] = f"x{i}"
        docs.append((i, " ".join(own)))
    docs += [(5000 + i, " ".join(f"y{r.randrange(4000)}" for _ in range(30))) for i in range(50)]
    want = brute_components(docs, 2, 80)
    got = near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), size=2).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == dict(want)


def test_a_bucket_of_many_components_is_compared_in_blocks(spark):
    r = np.random.default_rng(4)
    sets, group = {}, {}
    for g in range(450):  # triples: two alike, and a third alike to the second only
        a = r.integers(0, 1 << 40, 40)
        b, c = np.concatenate([a[:37], r.integers(0, 1 << 40, 3)]), None
        c = np.concatenate([b[3:], r.integers(0, 1 << 40, 3)])
        for x in (a, b, c):
            own = np.unique(x.astype(np.int64))
            key = near_dedup.fingerprint(own)
            sets[key], group[key] = own, g
    nodes = list(sets)
    hits = written(spark.createDataFrame([(7, bytearray(k), len(nodes)) for k in nodes], "bucket long, node binary, size long"), "hits")
    items = written(spark.createDataFrame([(bytearray(k), x.tolist()) for k, x in sets.items()], "node binary, items array<long>"), "sets")
    got = {bytes(x.node): bytes(x.label) for x in near_dedup.links_of(hits, items, 80, 4).collect()}
    by = {}
    for k in nodes:
        by.setdefault(group[k], set()).add(got.get(k, k))
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == 450


def test_toxicity_gradient():
    texts = ["you are a vile fool", "a calm and quiet day", "what a foul word", "plain text here"] * 8
    y = [1, 0, 1, 0] * 8
    model = toxicity.fit_toxicity(pd.DataFrame({"text": texts, "label": y}), 0.5, rounds=1, least=1)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    words, codes, counts = model.read(texts[:4])
    _, first, length = model.windows(counts)
    number = codes[np.minimum(first + np.arange(model.width)[:, None], len(codes) - 1)]
    own, local = np.unique(number, return_inverse=True)
    names, labels = [words[i] for i in own], np.array(y[:4], np.float64)

    def loss():
        x, _ = model.inputs(names)
        gates = (x @ model.p["x"] + model.p["x0"]).reshape(-1, 2, 3 * model.h)[local.reshape(number.shape)]
        logit, _ = model.run(gates, (np.arange(model.width)[:, None] < length).astype(np.float64))
        return np.logaddexp(0, -logit * (2 * labels - 1)).mean()

    g = model.gradient(names, local.reshape(number.shape), length, labels)
    for k, own_g in g.items():
        at = np.unravel_index(np.abs(own_g).argmax(), own_g.shape)
        before, step = model.p[k][at], 2e-2
        model.p[k][at] = before + step
        up = loss()
        model.p[k][at] = before - step
        down = loss()
        model.p[k][at] = before
        assert own_g[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4), k


def test_labelled_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(3, "a smaller text"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(4, 1), (5, 1), (6, None), (None, 1), (7, 9)], "doc_id long, quality int")
    import zlib

    rows, share = labelled_sample(docs, labels, "quality", 60)
    assert len(rows) == 60 and rows["id"].is_unique and sorted(set(rows["label"])) == [0, 1] and 0.4 < share < 0.6
    assert all(zlib.crc32(str(i).encode()) % 5 for i in rows["id"]) and 4 not in set(rows["id"])
    every, _ = labelled_sample(docs, labels, "quality", 1000)
    assert set(every["id"]) == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 and i != 4}
    assert 3 not in set(every["id"]) or every.set_index("id").loc[3, "text"] == "a smaller text"
    again, _ = labelled_sample(docs.repartition(7), labels.repartition(5), "quality", 60)
    assert rows.equals(again)
    few, _ = labelled_sample(docs, labels, "quality", 60, most_chars=100)
    assert 0 < len(few) < 20 and few["text"].str.len().sum() <= 100
    empty, share = labelled_sample(docs, labels.limit(0), "quality", 60)
    assert len(empty) == 0 and share == 0.5


def test_string_ids_come_back(spark):
    ids = ["a b", "é<1>", "", None, "7"]
    pages = spark.createDataFrame([(x, "http://x", "same" if i % 2 else f"p{i}") for i, x in enumerate(ids)], "page_id string, url string, html string")
    got = warc.read_warc(warc.write_warc(pages), "string").collect()
    assert sorted(map(str, (x.page_id for x in got))) == sorted(map(str, ids)) and not any(x.problem for x in got)
    with pytest.raises(ValueError):
        warc.write_warc(pages.withColumn("page_id", F.lit(1.5)))
    import public_tokenizers

    t = RankTokenizer.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    packed = pack(docs, t, width=16)
    back = read_packed_rows(spark, write_packed(packed), 16, id_type="string")
    assert sorted(map(str, packed.collect())) == sorted(map(str, back.collect()))
    assert sorted(str(x) for r in packed.collect() for x in r.doc_ids) == sorted(map(str, ids))


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, none, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    extra = ["__id", "__hash", "__gone", "__k1", "__k2", "__encoded", "k1", "decoded"]
    for docs in (odd, none):
        wide = docs.withColumns({c: F.lit(c) for c in extra}).withColumn("n_chars", F.char_length("text").cast("long"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, wide, str(tmp_path))
            rows = out.collect()
            assert len(rows) <= docs.count()
            if name != "encode":
                assert out.columns == wide.columns
                assert all(r[c] == c for r in rows for c in extra)
            else:
                assert len(rows) == docs.count() and {r.n_tokens for r in rows if not r.text} <= {0}
