"""Toxicity, licences, URL lists, WARC, packing, search and the pipeline."""

import datetime
import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quartzite.llm import licenses, packing, topk, toxicity, url_filter, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


# Toxicity.


def _labelled(n=600, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ta", "ro", "mi", "sel", "kun", "ve") for b in ("len", "dor", "sha", "pim", "gat")]
    endings = ["ig", "ung", "en", "er", "t", "los", "heit"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.25
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "m0ron", "You pathetic", "blurk" + rng.choice(endings), "blurk" + rng.choice(endings)]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_unseen_rows(spark):
    rows = _labelled()
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(9001, None, 1.0), (9002, "", 1.0), (None, "idiot", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(5, 0, 0), (None, 1, 0), (9001, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "score_"]
    got = out.withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    truth = {i: y for i, _, y in rows}
    unseen = [(r.score_ >= 0.5, truth[r.doc_id]) for r in got if r.held and r.doc_id in truth]
    assert len(unseen) > 80 and np.mean([a == b for a, b in unseen]) > 0.95
    assert {round(r.score_, 9) for r in got if not r.text} == {round(next(r.score_ for r in got if r.doc_id == 9001), 9)}
    assert all(0 <= r.score_ <= 1 for r in got) and next(r.held for r in got if r.doc_id is None) is False


def test_toxicity_lexicon():
    lexicon = toxicity._lexicon({"blurk*": 3.0})
    found = {w: lexicon.look(w.encode()) for w in ("idiot", "idiots", "id1ot", "idot", "idioot", "stupid", "stupld", "scum", "skum", "blurkheit", "blurrkt", "house", "")}
    assert found["idiot"] == ("idiot", 0) and found["id1ot"] == found["idot"] == found["idioot"] == found["idiots"] == ("idiot", 1)
    assert found["scum"] == ("scum", 0) and found["skum"] is None  # short terms must be exact
    assert found["blurkheit"] == ("blurk*", 0) and found["blurrkt"] == ("blurk*", 1) and found["house"] is None and found[""] is None
    abuse, quote = lexicon.features("you idiot"), lexicon.features('the paper printed "idiot" there')
    assert abuse[0] > lexicon.features("an idiot")[0] > quote[0] and quote[-1] > 0 and lexicon.features("he said idiot")[-1] > 0


def test_toxicity_sees_long_and_joined_words_and_long_quotations():
    lexicon = toxicity._lexicon({"blurk*": 3.0})
    assert lexicon.look(b"blurk" + b"x" * 100) == ("blurk*", 0)
    assert toxicity.words("an\u00a0idiot\u2014you\u3002Öl") == [b"an", b"idiot", b"you", "öl".encode()]
    long = "ta " * 300
    assert lexicon.features(f'"{long} idiot"')[-1] > 0 and lexicon.features(f"“{long}\u00a0idiot” ")[-1] > 0
    assert lexicon.features(f'"{long}\n idiot"')[-1] == 0


def test_levenshtein_is_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(8)
    lexicon = toxicity.Lexicon({"abcab": 1.0, "bbbaa": 1.0, "acacac": 1.0})
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 8)))
        least = min(distance(w, t) for t in lexicon.terms)
        got = lexicon.look(w.encode())
        assert (got is None) == (least > 1) and (got is None or got[1] == least)


def test_automaton_forgets_and_meets_strange_letters(monkeypatch):
    whole = toxicity.Lexicon({"abcab": 1.0, "bbb*": 2.0})
    words = ["".join(random.Random(i).choices("abcé語", k=i % 9)).encode() for i in range(800)]
    want = [whole.look(w) for w in words]
    assert any(want) and not whole.look("é語é語é".encode()) and whole.look("abcéb".encode()) == ("abcab", 1)
    monkeypatch.setattr(toxicity, "CACHED_STATES", 3)
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 5)
    small = toxicity.Lexicon(whole.terms)
    assert [small.look(w) for w in words] == want and len(small.states) < 20 and len(small.known) <= 5


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()}
    assert got[1] > got[2]
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


# Licences.


@pytest.fixture(scope="module")
def licence_model():
    rng = random.Random(1)
    return licenses.Classifier([" ".join(rng.choice("some plain text to see in this line of the work here".split()) for _ in range(12)) for _ in range(200)])


def test_licences(spark):
    clean = ["The licence of the driver was old.", "Nothing here.", "a version of the work", ""]
    rows = [(1, "intro\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (3, "\n".join(clean)), (4, None), (5, "x " * 50_000), (5, "SPDX-License-Identifier: MPL-2.0"), (6, "")]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, licences string")
    model = licenses.train(docs)
    got = sorted((r.doc_id, r.licences, [p.line for p in r.paragraphs]) for r in licenses.scan(docs, model).collect())
    assert [g[:2] for g in got] == [(1, ["MIT"]), (2, ["Apache-2.0", "CC-BY-NC-4.0"]), (3, []), (4, []), (5, []), (5, ["MPL-2.0"]), (6, [])]
    assert got[0][2] == [1] and licenses.scan(docs.limit(0), model).count() == 0
    assert licenses.train(docs.limit(0)).licences("Released under the MIT License.")[0] == ["MIT"]


def test_every_template_is_its_family(licence_model):
    wrong = [(f, n, got) for f, ns in licenses.templates().items() for n in ns if (got := licence_model.classify(licenses.words(n)[: licenses.WINDOW])) is None or got[0] != f]
    assert not wrong
    rng = random.Random(1)
    plain = [[rng.choice("the of work under public version free license all person software".split()) for _ in range(9)] for _ in range(300)]
    assert np.mean([licence_model.classify(p) is not None for p in plain]) < 0.02


def test_licence_versions_denials_and_places(licence_model):
    old = "This {} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {}\nas published by the Free Software Foundation; either\nversion {} of the License, or (at your option) any later version."
    cases = {
        old.format("library", "Lesser General Public License", "2.1"): ["LGPL-2.1"],
        old.format("program", "General Public License", "2"): ["GPL-2.0"],
        old.format("program", "General Public License", "3"): ["GPL-3.0"],
        "\n".join(licenses.TEXTS["BSD"][:3]): ["BSD-2-Clause"],
        "\n\n".join(licenses.TEXTS["BSD"][:3] + licenses.TEXTS["BSD-3-Clause"][:1]): ["BSD-3-Clause"],
        "This work is not licensed under the MIT License.": [],
        "It is no longer licensed under the Apache License, Version 2.0.": [],
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,\nEXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY': ["MIT"],
        "Apache License\nVersion 2.0, January 2004": ["Apache-2.0"],
        "GNU GENERAL PUBLIC LICENSE\nVersion 3": ["GPL-3.0"],
        "plain words here " * 90 + "Released under the MIT License. " + "and more of them " * 90: ["MIT"],
        "Licensed under the Apache License,\nVersion 2.0.": ["Apache-2.0"],
        "Licensed under the Apache License, Version 1.1.": [],
    }
    assert {t: licence_model.licences(t)[0] for t in cases} == cases


def test_template_comparison_is_brute_force():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(1, 14))] for _ in range(2))
        t = licenses.Template(" ".join(a))
        both = sum((x, y) in {(b[i], b[i + 1]) for i in range(len(b) - 1)} for x, y in {(a[i], a[i + 1]) for i in range(len(a) - 1)})
        every = len({(a[i], a[i + 1]) for i in range(len(a) - 1)})
        assert t.share(b) == both / max(1, every)
        if t.share(b) >= licenses.CONFIRMED:
            assert t.met(b) == (t.share(b), 2 * both)
    version = licenses.Template("Apache License, Version 2.0, January 2004")
    assert version.met(licenses.words("the Apache License, Version 2.0, January 2004"))[1] == 10 and version.met(licenses.words("Apache License, Version 1.1, January 2004")) == (0.0, 0)


def test_licence_bound_is_exact(licence_model):
    rng = random.Random(3)
    known = sorted(licence_model.vocabulary)
    for _ in range(300):
        w = " ".join(rng.choice(known) for _ in range(rng.randrange(1, 12))).split()
        p = licenses._softmax(licence_model._logits(w)[None] / licence_model.heat)[0]
        if 1 - p[-1] >= min(licence_model.least.values()):
            assert licence_model.base + sum(licence_model.gain.get(g, 0.0) for g in licenses.grams(w)) >= licence_model.need


# URL lists.


def test_url_filter(spark):
    day = datetime.date.fromisoformat
    entries = [("Example.net", "2024-01-01", "block"), ("example.net", "2024-03-01", "remove"), ("example.net", "2024-05-01", "block"), ("example.net/en", "2024-01-01", "allow"), ("example.net/en/a", "2024-02-01", "block"), (None, "2024-01-01", "block"), ("x.org", None, "block"), ("tie.org", "2024-01-01", "allow"), ("tie.org", "2024-01-01", "block")]
    e = spark.createDataFrame([(k, d and day(d), a) for k, d, a in entries], "key string, listed_at date, action string")
    cases = [
        ("https://a.example.net/x", "2024-01-01", True, "example.net"), ("https://a.example.net/x", "2024-02-29", True, "example.net"), ("https://a.example.net/x", "2024-03-01", False, None), ("https://a.example.net/x", "2024-06-01", True, "example.net"),
        ("https://example.net/en?x=/de", "2024-01-05", False, "example.net/en"), ("http://user@example.net:80/en/a/b#f", "2024-01-05", False, "example.net/en"), ("http://example.net./en/a/b#f", "2024-02-05", True, "example.net/en/a"),
        ("https://badexample.net/", "2024-01-05", False, None), ("https://tie.org", "2024-01-05", True, "tie.org"), ("https://tie.org", "2023-01-05", False, None), ("no url", "2024-01-05", False, None), ("", "2024-01-05", False, None), (None, "2024-01-05", False, None), ("https://tie.org", None, False, None),
    ]
    captures = spark.createDataFrame([(i, u, d and day(d), "x", 1) for i, (u, d, _, _) in enumerate(cases * 2)], "id long, url string, fetched_at date, blocked string, u int")
    out = url_filter.filter_urls(captures, e)
    assert out.columns == ["id", "url", "fetched_at", "blocked", "u", "n_active", "list_key", "list_action", "blocked_"]
    assert [(r.blocked_, r.list_key) for r in out.orderBy("id").collect()] == [(b, k) for _, _, b, k in cases * 2]
    assert url_filter.filter_urls(captures.limit(0), e).count() == 0 and url_filter.filter_urls(captures, e.limit(0)).where("blocked_").count() == 0


def test_url_filter_matches_paths_of_any_depth_and_case(spark):
    day = datetime.date(2024, 1, 1)
    e = spark.createDataFrame([(k, day, a) for k, a in (("Example.com/a/b/c", "block"), ("example.com/a/b/c/d/e", "allow"), ("x.org/Up/", "block"), ("0.1", "block"), ("10.0.0.7", "block"), ("[2001:db8::1]", "block"), ("LocalHost", "block"), ("tld", "block"))], "key string, listed_at date, action string")
    want = {"http://example.com/a/b": False, "http://example.com/a/b/c": True, "http://www.example.com/a/b/c/d?q": True, "http://example.com/a/b/c/d/e/f": False, "http://X.org/Up/1": True, "http://x.org/up": False, "http://x.org/": False,
            "http://10.0.0.1/x": False, "http://10.0.0.7:8080/x": True, "http://[2001:DB8::1]:80/a": True, "http://localhost/z": True, "http://a.localhost/": False, "http://only.tld/": False, "x.org/Up/" + "long/" * 3000: True, "http:///Up": False}
    captures = spark.createDataFrame([(u, day) for u in want], "url string, fetched_at date")
    assert {r.url: r.blocked for r in url_filter.filter_urls(captures, e).collect()} == want


# WARC.


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 9000)
    big, small = "é" * 60, "tiny"
    rows = [(i, f"http://h/{i}", random.Random(i).choice([big, small, None, "", "x\r\n\r\ny" * 40, "z" * 5000, str(i) * 99])) for i in range(120)] + [(None, None, big), (0, "again", None), (500, "u\r\nWARC-Type: x", "q" * 100), (501, "v", "q" * 100), (501, "v", "q" * 100)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(index).collect()
    assert len(got) == len(rows)
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = least.get(h)
        again = first is not None and i != first
        want.append((i, "revisit" if again else "response", first if again else None, len(b), hashlib.sha256(b).hexdigest(), None if again else b))
    key = lambda r: (str(r[0]), r[4])
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got), key=key) == sorted(want, key=key)
    bundles = sorted({r.bundle for r in index.collect()})
    assert len(bundles) > 3 and len(os.listdir(tmp_path / "w")) == len(bundles)
    reader = warc.BundleReader(bundles[0])
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(open(bundles[0].removeprefix("file://"), "rb"), read_across_frames=True).read()
    assert whole == b"".join(reader.frame(i) for i in range(len(reader.sizes)))
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and whole.count(b"\r\nWARC-Date: ") == whole.count(b"WARC/1.1\r\n") > 1
    assert all(r.verified for r in got)
    ids = [r.record_id for r in index.collect() if r.page_id != 501]
    assert len(set(ids)) == len(ids)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


# Packing.


def test_packing_is_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(6)
    signs = " abcXYZ'’éÉŠİı0129²½ªº́ \x0b\x1c\t\n<|endoftext|>漢字ΑΣς🎉-_.,!?s't"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(200)))) for i in range(300)] + [(900, None), (901, ""), (902, "tok " * 30_000), (903, "a" * 5000), (None, "none"), (5, "again"), (5, "again"), (904, "The end. the END, don't Don'T.")]
    rows += [(1000 + i, "".join(rng.choice("THJWYAthjwya \u0308\u0331\u030c\u030a\u0301\u0323.,") for _ in range(60))) for i in range(200)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    pieces = packing.pack(docs, TOKENIZER)
    got: dict = {}
    for r in pieces.collect():
        assert r.offset + r.length <= 4096 and len(r.ids) == 4 * r.length and r.length > 0
        got.setdefault((r.sequence_id), []).append(r)
    for s, rs in got.items():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
        assert sum(r.length for r in rs) == 4096 or s == max(got)
    stream = [r for s in sorted(got) for r in got[s]]
    texts: list = []
    for r in stream:
        if r.start == 0:
            texts.append([r.doc_id, r.doc_tokens, b""])
        assert texts[-1][0] == r.doc_id and len(texts[-1][2]) == 4 * r.start
        texts[-1][2] += bytes(r.ids)
    want = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in rows]
    assert sorted(((d, b) for d, _, b in texts), key=str) == sorted(want, key=str) and all(n == len(b) // 4 for _, n, b in texts)
    whole = packing.sequences(pieces).collect()
    assert {len(r.ids) for r in whole} == {4 * 4096} and sum(r.n_tokens for r in whole) == sum(len(b) // 4 for _, b in want)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_packing_with_another_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.splits_in_pieces(TOKENIZER) and not packing.splits_in_pieces(path)
    texts = ["a  b", " Two  words\n", "", "<|endoftext|> x"]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path)
    whole = Tokenizer.from_file(path)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in pieces.collect()} == {i: [*whole.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


# Search.


def brute_top(rows, k):
    v = {i: [int(np.floor(256 * float(x))) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in (i for i in v if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=False)), i) for i in v if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["gauss", "ties", "equal", "sparse"])
def test_top_k_is_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "FIRST_DEPTH", 2)
    rng = np.random.default_rng(3)
    make = {
        "gauss": lambda: rng.normal(size=8), "ties": lambda: rng.integers(-1, 2, 8) / 4.0, "equal": lambda: np.ones(8) if rng.random() < 0.6 else rng.normal(size=8), "sparse": lambda: rng.normal(size=8) * (rng.random(8) < 0.2),
    }[kind]
    rows = [(int(i), [float(np.float32(x)) for x in make()]) for i in rng.permutation(700)]
    rows += [(5000, None), (5050, [0.1, None]), (5100, [float("nan")] * 8), (5150, [float("inf")] + [0.0] * 7), (None, [0.5] * 8), (5200, []), (5250, [0.5, 0.5]), (5251, [9.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 5)


def test_top_k_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 2)
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (50, [2.0]), (100, [3.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 3).collect()}
    assert got == {(0, 1): 100, (0, 2): 50, (0, 3): 1, (50, 1): 100, (50, 2): 0, (50, 3): 1, (100, 1): 50, (100, 2): 0, (100, 3): 1}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e6, 1e6]), (1, [1e6, 1e6 + 1]), (2, [1e6, -1e6])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(huge, huge.where("vec_id = 0"), 2).orderBy("rank").collect()] == [1, 2]


def test_top_k_counts_rows_repeated_across_blocks_once(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 4)
    rows = [(0, [1.0]), (1, [9.0]), (2, [5.0]), (3, [4.0]), (1, [9.0]), (4, [3.0]), (2, [5.0]), (5, [2.0]), (1, [9.0]), (2, [5.0]), (6, [8.0]), (7, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = topk.top_k(df, df.where("vec_id = 0"), 4).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 6), (3, 2), (4, 3)]


# The pipeline.


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["ta", "ro", "mi", "sel"]) + rng.choice(["len", "dor", "sha", "pim"]) + str(rng.randrange(50)) for _ in range(n))
    passage, item = text(60), text(20)
    near = text(200).split()
    docs = [(1, text(50)), (2, f"{text(30)}\n{passage}\n{text(30)}"), (3, f"{text(30)}\n{passage}\n{text(30)}"), (4, "you idiot " + text(20)), (5, " ".join(near)), (6, " ".join([*near[:100], "changed", *near[101:]]))]
    docs += [(7, f"{text(10)} {item} {text(5)}"), (8, f"{text(900)} {item} {text(5)}"), (9, None), (10, ""), (11, docs[0][1])]
    docs += [(i, text(40) + (" idiot scum" if i % 3 == 0 else "")) for i in range(100, 220)]
    folder = str(tmp_path)
    spark.createDataFrame([(*d, "en", "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(100, 220)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, got, folder)
        assert out.columns == got.columns, name
        out.write.parquet(f"{folder}/{name}")
        got = spark.read.parquet(f"{folder}/{name}")
        kept.append({r.doc_id: r.text for r in got.collect()})
    toxic, lines, copies, clean = kept
    assert 4 not in toxic and {1, 2, 3, 5, 6, 7, 8, 9, 10, 11} <= set(toxic) and not any(i % 3 == 0 for i in toxic if i >= 100)
    assert passage in lines[2] and passage not in lines[3] and 11 not in lines and lines[1] == docs[0][1] and lines[9] is None and lines[10] == ""
    assert 5 in copies and 6 not in copies and set(lines) - set(copies) == {6}
    assert 7 not in clean and item not in clean[8] and set(copies) - set(clean) == {7}
    pieces = corpus_pipeline.STAGES[-1][1](spark, got, folder).collect()
    assert {r.doc_id for r in pieces} == set(clean)
