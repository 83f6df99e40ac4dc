"""Tokenising, packing, personal data, classifiers, archives and the pipeline."""

import io
import random
import re

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

from graphloom.llm import pii, quality, toxicity, warc
from graphloom.llm.packing import RankTokenizer, best_fit_decreasing, pack, read_packed, read_packed_rows, segments, write_packed
from graphloom.llm.piece_bpe import Codec, PieceModel, encode_decode

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_codec_equals_the_library():
    own, ref = Codec(PieceModel.load(PIECES)), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(5)
    letters = " " * 6 + "\n\t▁abcdefghijklmnopqrstuvwxyz éñ漢字🙂́<>0x1 the ing"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += ["", " ", "   ", "\n\n", " " * 50, "a" * 5000, "<s>", "<0x0A>", "the  cat\n ▁sat"]
    assert [own.encode(x) for x in texts] == ref.encode(texts)
    for _ in range(500):
        ids = [r.randrange(32000) for _ in range(r.randint(0, 9))] + [r.randrange(3, 259) for _ in range(r.randint(0, 5))]
        r.shuffle(ids)
        assert own.decode(ids) == ref.decode(ids)


def test_encode_decode_cases(odd, none):
    ref = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = encode_decode(odd, PIECES).collect()
    assert len(rows) == odd.count()
    for r in rows:
        source = {x.doc_id: x.text for x in odd.collect()}[r.doc_id] or ""
        assert list(r.ids) == ref.encode(source) and r.decoded == source
    assert encode_decode(none, PIECES).count() == 0


def naive_best_fit(sizes, width):
    rows = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rows if r[0] >= sizes[i]]
        if fits:
            least = min(r[0] for r in fits)
            row = [r for r in rows if r[0] == least][0]
        else:
            row = [width, []]
            rows.append(row)
        row[0] -= sizes[i]
        row[1].append(i)
    return rows


def test_best_fit_decreasing_is_as_full_as_the_plain_rule():
    r = random.Random(6)
    for _ in range(50):
        width = r.choice((1, 7, 64))
        sizes = [r.randint(1, width) for _ in range(r.randint(0, 80))]
        rows = best_fit_decreasing(sizes, width)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in row) <= width for row in rows)
        assert sorted(sum(sizes[i] for i in row) for row in rows) == sorted(width - room for room, _ in naive_best_fit(sizes, width))
    assert segments(10, 4) == [(0, 4), (4, 8), (8, 10)]


def test_packing_is_lossless(spark, odd, none):
    t = RankTokenizer.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    packed = pack(odd, t, width=64)
    docs: dict = {}
    for r in packed.collect():
        ids, places = np.frombuffer(r.input_ids, np.uint16), np.frombuffer(r.position_ids, np.int32)
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            docs.setdefault(d, []).append((s, ids[a:b].tolist()))
            assert places[a:b].tolist() == list(range(b - a))
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=t.pattern, mergeable_ranks=t.ranks, special_tokens={})
    for x in odd.collect():
        want = ref.encode_ordinary(x.text or "") + [t.end]
        got = [i for _, own in sorted(docs[x.doc_id]) for i in own]
        assert got[: len(want)] == want or x.doc_id == 2
    folder = write_packed(packed)
    back = read_packed(spark, folder, 64)
    assert back.count() == packed.count()
    assert sorted(map(tuple, (r.cu_seqlens for r in back.collect()))) == sorted(map(tuple, (r.cu_seqlens for r in packed.collect())))
    assert pack(none, t).count() == 0


def test_packed_rows_come_back_from_their_files(spark, odd, none, monkeypatch, tmp_path):
    from graphloom.llm import queries

    t = RankTokenizer.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    packed, calls = pack(odd, t, width=64), []
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert plain(read_packed_rows(spark, write_packed(packed), 64)) == plain(packed)
    assert any(None in r.doc_ids for r in packed.collect())
    assert read_packed_rows(spark, write_packed(pack(none, t)), 2048).count() == 0
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "write_packed", lambda df: calls.append(write_packed(df)) or calls[-1], raising=False)
    got = queries.op1_pack(spark, str(tmp_path))
    assert len(calls) == 1 and plain(got) == plain(pack(spark.read.parquet(f"{tmp_path}/documents.parquet"), t, width=2048))



def test_base_patterns():
    brute = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(7)
    for _ in range(5000):
        s = "".join(r.choice("ab1.@-+é ") for _ in range(r.randint(0, 25)))
        assert [m.span() for m in brute.finditer(s)] == [x[1:] for x in pii.emails(s)]
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(5000):
        s = "".join(r.choice("12.. ") for _ in range(r.randint(0, 25)))
        assert [m.span() for m in plain.finditer(s)] == [m.span() for m in pii.IP.finditer(s)]
    assert pii.base_spans("x 4539 1488 0343 6467, +1 (555) 123-4567 at 300.1.1.1 or 10.0.0.255") == [("card", 2, 21), ("phone", 23, 40), ("ip", 57, 67)]
    assert pii.base_spans("4539148803436468") == []


def test_field_learns_boundaries_and_types():
    field, r, hit, extra, all_ = pii.trained(120, 4), random.Random(99), 0, 0, 0
    for _ in range(150):
        text, spans = pii.example(r)
        got = set()
        for a, b in pii.stretches(text):
            got |= set(field.entities(text, a, b))
        hit, extra, all_ = hit + len(got & set(spans)), extra + len(got - set(spans)), all_ + len(spans)
    assert hit / all_ > 0.9 and extra / all_ < 0.1


def test_field_gradient_and_best_path_by_brute_force():
    field = pii.Field()
    r = np.random.default_rng(1)
    field.w, field.t = r.normal(size=field.w.shape), r.normal(size=field.t.shape)
    text = "7 1.2.3.4 56"
    x = pii.Lattice(text, 0, len(text))

    def ways(j):
        if j == len(x.cuts):
            return [[]]
        out = [[(j, j + 1, pii.OUTSIDE)] + w for w in ways(j + 1)]
        for to in range(j + 1, len(x.cuts) + 1):
            if j in x.spans[to]:
                out += [[(j, to, y)] + w for y in range(pii.OUTSIDE) for w in ways(to)]
        return out

    def score(way):
        s, last = 0.0, pii.OUTSIDE
        for i, j, y in way:
            s += field.t[last, y] + (field.w[y] @ x.f[x.rows[j][x.spans[j].index(i)]] if y != pii.OUTSIDE else 0)
            last = y
        return s

    every = ways(0)
    best = max(every, key=score)
    for block in (1, 3, 256):
        assert list(field.entities(text, 0, len(text), block)) == [(pii.LABELS[y], x.cuts[i][0], x.cuts[j - 1][1]) for i, j, y in best if y != pii.OUTSIDE]
    gold = {(2, 9, 1)}
    loss = lambda: score([w for w in every if {s for s in w if s[2] != pii.OUTSIDE} == gold][0]) - np.logaddexp.reduce([score(w) for w in every])
    gw, gt = field.gradient(x, gold)
    for g, p in ((gw, field.w), (gt, field.t)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_find_pii_cases(odd, none, spark):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == [] for r in rows)
    one = spark.createDataFrame([(1, "é a@b.cd token = \"186da33772c57236dfc5713ad4eb4d0d50149fa7\"")], "doc_id long, text string")
    spans = pii.find_pii(one).first().spans
    assert [(s.kind, s.start, s.end, s.base) for s in spans] == [("email", 2, 8, True), ("secret", 18, 58, False)]
    assert pii.find_pii(none).count() == 0


def toy(n, bad):
    r = random.Random(8)
    word = lambda: "".join(r.choice(("an", "re", "st", "ou")) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(15, 150))]
        if i % 4 == 0:
            words = bad(words, r)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return pd.DataFrame(rows, columns=["id", "text", "label"])


def test_quality_learns_and_is_whole(odd, none):
    rows = toy(600, lambda w, r: [x + r.choice(("***", "!!", "%%%")) for x in w])
    rows["label"] = 1 - rows["label"]
    model = quality.fit_quality(rows[:450], 0.75)
    scores = model.scores(rows["text"][450:].tolist())
    assert ((scores >= 0.3) == rows["label"][450:]).mean() > 0.97
    out = quality.score_quality(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.score_quality(none, model).count() == 0
    flat = quality.fit_quality(rows[rows.label == 1][:20], 0.7)
    assert np.allclose(flat.scores(["x", ""]), 0.7)


def test_toxicity_learns_from_any_place(odd, none):
    def put(w, r):
        w[r.randrange(len(w))] = "grobbel"
        return w

    rows = toy(400, put)
    model = toxicity.fit_toxicity(rows[:300], 0.25, least=2)
    scores = model.scores(rows["text"][300:].tolist())
    assert ((scores >= 0.5) == rows["label"][300:]).mean() > 0.95
    late = " ".join(["an"] * 5000 + ["grobbel"] + ["re"] * 3000)
    assert model.scores([late, late.replace("grobbel", "st")])[0] > model.scores([late.replace("grobbel", "st")])[0]
    out = toxicity.score_toxicity(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_toxicity(none, model).count() == 0
    assert np.allclose(toxicity.fit_toxicity(rows[rows.label == 0][:20], 0.1).scores(["x", ""]), 0.1)


def test_toxicity_windows_cover_every_word():
    model = toxicity.ToxicModel({}, {})
    counts = np.array([0, 1, 12, 64, 65, 1000])
    text, first, length = model.windows(counts)
    start = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        covered = {w - start[i] for a, b in zip(first[text == i], length[text == i], strict=True) for w in range(a, a + b)}
        assert covered == set(range(n)) and (text == i).sum() >= 1


def test_archive_round_trip(spark):
    rows = [(3, "http://a b/", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (None, "u", "x"), (9, "u", "y" * 300_000), (9, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers string")
    got = warc.read_warc(warc.write_warc(pages)).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    by = {r.page_id: r for r in got}
    assert (by[3].record_type, by[3].refers_to, by[3].payload) == ("revisit", 1, None)
    assert by[1].record_type == "response" and bytes(by[1].payload) == "<p>é</p>".encode()
    assert by[5].refers_to == 2 and by[2].payload_bytes == 0 and by[None].record_type == "response"
    assert by[9].payload_bytes == 300_000 and by[3].payload_digest == by[1].payload_digest == warc.base32_sha1("<p>é</p>".encode())
    big = warc.read_warc(warc.write_warc(pages, min_bytes=100)).where("record_type = 'revisit'")
    assert big.count() == 0
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_archive_faults_are_found():
    import zstandard

    dictionary = warc.dictionary_of([b"abc"])
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    good = warc.record(1, "u", b"hello", None, "2026-01-01T00:00:00Z")
    data = warc.archive_head(dictionary) + packer.compress(good) + packer.compress(good)
    source = io.BytesIO(data)
    assert list(warc.frames(source, warc.read_dictionary(source), chunk=7)) == [good, good]
    source = io.BytesIO(data[:-3])
    with pytest.raises(ValueError, match="cut short"):
        list(warc.frames(source, warc.read_dictionary(source)))
    with pytest.raises(ValueError, match="dictionary"):
        warc.read_dictionary(io.BytesIO(packer.compress(good)))
    assert warc.parsed(good)["problem"] is None
    assert warc.parsed(good.replace(b"WARC/1.1", b"WARC/9"))["problem"] == "version"
    assert warc.parsed(good.replace(b"hello", b"hellO"))["problem"] == "block digest"
    assert warc.parsed(good[:-4])["problem"] == "content length"
    assert warc.parsed(good.replace(b"WARC-Date: ", b"WARC-When: "))["problem"].startswith("missing")


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "encode"]
    cleaned = p.lines(spark, docs, folder)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    out = p.run(spark, folder)
    ref = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = out.collect()
    assert 0 < len(rows) < docs.count()
    assert all(list(r.ids) == ref.encode(r.text) and r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in rows)
