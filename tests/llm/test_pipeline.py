"""The score of toxicity and the whole pipeline against brute force."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quartzite.llm import toxicity

from .test_model_operators import _labelled
from .test_text_operators import WORD, _words, brute_components, brute_maximal

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_look(word, terms):
    """(edits, term): every term is compared with the word or, for a stem, with all that the word begins with."""
    found = []
    for term, weight in terms.items():
        letters = term.rstrip("*")
        heads = [word[:n] for n in range(1, len(word) + 1)] if term.endswith("*") else [word]
        edits = min(distance(h, letters) for h in heads)
        if edits <= (len(letters) >= 5):
            found.append((edits, -weight, term))
    return min(found)[::2] if found else None


def brute_score(text, model):
    """The score of a text, letter by letter and word by word."""
    terms = {s: 4.0 for s in toxicity.SEED} | {t: round(v, 4) for t, v in model["terms"].items()}
    low = (text or "").lower()
    apart = [(c.isascii() and not c.isalnum()) or (not c.isascii() and unicodedata.category(c)[0] in "ZP") for c in low]
    starts = [i for i, c in enumerate(apart) if not c and (i == 0 or apart[i - 1])]
    found = [re.split(r"\s", "".join(" " if a else c for c, a in zip(low[i:], apart[i:], strict=True)), maxsplit=1)[0] for i in starts]
    inside, i = set(), 0
    while i < len(low):
        closed = {'"': '"', "“": "”", "«": "»", "„": "“"}.get(low[i])
        end = low.find(closed, i + 1) if closed else -1
        if end > i + 1 and "\n" not in low[i:end]:  # the first quotation that opens goes to its end
            inside.update(range(i, end + 1))
            i = end
        i += 1
    exact = fuzzy = top = aside = 0.0
    met = set()
    for i, w in enumerate(found):
        if (got := brute_look(w, terms)) is None:
            continue
        edits, term = got
        weight, before = terms[term], {x.encode() for x in found[max(0, i - 4) : i]}
        if starts[i] in inside or before & toxicity.REPORTING:
            aside += weight
            weight *= 0.3
        elif (before | {x.encode() for x in found[i : i + 5]}) & toxicity.ADDRESSING:
            weight *= 1.5
        if edits:
            fuzzy += weight
        else:
            exact, top = exact + weight, max(top, weight)
            met.add(term)
    n = max(1, len(found))
    x = [math.log1p(v) for v in (exact, fuzzy)] + [top] + [math.log1p(v) for v in (len(met), 1000 * exact / n, 1000 * fuzzy / n, aside)]
    z = model["b"][0] + sum(b * (v - m) / s for b, v, m, s in zip(model["b"][1:], x, model["mean"], model["scale"], strict=True))
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def brute_terms(rows):
    """What (text, toxic) rows teach: every term of every text counted afresh, bounds and odds as exact as floats allow."""
    texts = [({w for w in re.findall(r"[0-9a-z]+", text.lower())}, y) for text, y in rows]
    sets = [(s | {w[:n] + "*" for w in s for n in range(4, min(8, len(w)) + 1)}, y) for s, y in texts]
    n1, n0 = sum(y for _, y in sets), sum(1 - y for _, y in sets)
    count = {t: [sum(t in s for s, y in sets if y == c) for c in (0, 1)] for t in set().union(*(s for s, _ in sets))}
    often = {t: c for t, c in count.items() if c[1] >= max(3, 0.003 * n1) and len(t.replace("*", "")) >= 3}
    share, odds = n1 / (n1 + n0), {}
    for t, (c0, c1) in often.items():
        p = c1 / (c0 + c1)
        gain = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)
        v = math.log((c1 + 0.5) / (n1 + 1) * (n0 + 1) / (c0 + 0.5))
        if p > share and (c0 + c1) * gain >= math.log(max(2, len(often))) and v >= 1.5:
            odds[t] = v
    return {t: v for t, v in odds.items() if not any(s != t and s.endswith("*") and t.startswith(s[:-1]) and odds[s] >= v - 0.7 for s in odds)}


def test_learned_terms_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED_TERMS", 50)  # counts of a task come in many pieces
    rows = _labelled(500, seed=4)
    d = spark.createDataFrame([(t, y, i % 2) for i, t, y in rows], "text string, y int, half int").repartition(5)
    want = brute_terms([(t, y) for _, t, y in rows])
    got = toxicity.fit_model(d, {0: 1.0, 1: 1.0})["terms"]
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in got) and {"blur*", "idio*"} <= got.keys()
    again = toxicity.fit_model(d.repartition(2), {0: 1.0, 1: 1.0})
    assert again["terms"] == got and again["b"] == toxicity.fit_model(d, {0: 1.0, 1: 1.0})["b"]


def test_a_documents_least_text_is_learned_from(spark, monkeypatch):
    rows = _labelled(400, seed=6)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    more = spark.createDataFrame([(i, t + " more") for i, t, _ in rows for _ in range(2)], "doc_id long, text string")
    model = toxicity.train(once, labels)
    assert model["terms"] and toxicity.train(once.unionByName(more), labels) == model
    seen = []
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 10)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 20)
    monkeypatch.setattr(toxicity, "fit_model", lambda rows, weight: seen.append({r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}))
    toxicity.train(once.unionByName(more), labels)
    assert seen == [{0: 20, 1: 10}]


def test_toxicity_score_is_brute_force(spark):
    rows = _labelled(300)
    model = toxicity.fit_model(spark.createDataFrame([(t, y, i % 2) for i, t, y in rows], "text string, y int, half int"), {0: 1.0, 1: 1.0})
    rng = random.Random(5)
    parts = "idiot id1ot idiots scum skum stupidd moron blurkheit blurrkt blurk trash You dein said wrote house über, ta.len kun ro sel—mi \n \" “ ” « » ( ) x".split(" ")
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(250)]
    texts += ["", " ", "Ärger IDIOT", "blurk" + "x" * 200, "idiot " * 3000, '"idiot"', '"an idiot" you', "«you idiot»", "„du idiot“"]
    lexicon = toxicity._lexicon(model["terms"])
    mean, scale, b = (np.array(model[k]) for k in ("mean", "scale", "b"))
    scores = []
    for t in texts:
        z = b[0] + ((np.array(lexicon.features(t)) - mean) / scale) @ b[1:]
        scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        assert abs(scores[-1] - brute_score(t, model)) < 1e-9, t
    assert min(scores) < 0.5 < max(scores)


def brute_clean(text, items):
    """The text without hit words, or None where they are a twentieth of all words or more."""
    windows = set()
    for item in map(_words, items):
        n = min(13, len(item))
        windows.update(tuple(item[j : j + n]) for j in range(len(item) - n + 1) if n)
    w = _words(text)
    hit = {x for n in set(map(len, windows)) for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows for x in range(j, j + n)}
    if hit and 20 * len(hit) >= len(w):
        return None
    at = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    gone = {c for x in hit for c in range(at[x][0], at[x + 1][0] if x + 1 in hit else at[x][1])}
    return "".join(c for i, c in enumerate(text) if i not in gone)


def test_pipeline_is_brute_force(spark, tmp_path):
    rng = random.Random(21)
    pool = [a + b + str(i) for a in ("ta", "ro", "mi") for b in ("len", "sha", "pim") for i in range(40)]
    words = lambda n: [rng.choice(pool) for _ in range(n)]
    lines = lambda n: "\n".join(" ".join(words(rng.randrange(5, 14))) for _ in range(n))
    items = [" ".join(words(20)), " ".join(words(13)), "Short Item " + " ".join(words(3)), None, "?!"]
    passages, base = [lines(6) for _ in range(3)], words(150)
    rows: list = [(i, lines(rng.randrange(1, 9)) + (" you idiot scum" if i % 4 == 0 else "")) for i in range(100, 180)]
    rows += [(200 + i, f"{lines(3)}\n{passages[i % 3]}\n\n{lines(2)}") for i in range(12)]
    rows += [(300 + i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(0, 60, 6)]
    rows += [(400 + i, " ".join([*words(20 if i % 2 else 900), items[i % 3].upper(), *words(4)])) for i in range(9)]
    rows += [(500, rows[90][1]), (501, None), (502, ""), (503, " \n "), (None, lines(3)), (504, "Öl — ünder " + " ".join(words(40))), (505, " ".join(words(6000))), (101, rows[1][1]), (505, rows[0][1])]
    rows[-1] = (502, "")
    folder = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100, 180)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    kept = [(d, t) for d, t in rows if brute_score(t, model) < 0.5]
    assert 15 <= len(rows) - len(kept) <= 25
    cut = brute_maximal(list(dict.fromkeys(kept)), 30)
    kept = [(d, cut[d][0] if t is not None else None) for d, t in kept if t is None or not cut[d][1] or cut[d][0].strip()]
    found = brute_components(kept, 5, 80)
    names = {d for d, _, c in found if d == c}
    kept = [r for r in kept if r[0] in names]
    kept = list(dict.fromkeys(r for r in kept if (r[1] or "").split())) + [r for r in kept if not (r[1] or "").split()]
    kept = [(d, clean) for d, t in kept if (clean := t and brute_clean(t, [x for x in items if x])) is not None or t is None]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter((d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in kept)

    pieces = corpus_pipeline.run(spark, folder).collect()
    got, whole, used = Counter(), b"", Counter()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id] and r.start * 4 == len(whole) and len(r.ids) == 4 * r.length
        used[r.sequence_id] += r.length
        whole += bytes(r.ids)
        if len(whole) == 4 * r.doc_tokens:
            got[(r.doc_id, whole)] += 1
            whole = b""
    assert got == want and not whole and max(used.values()) <= 4096
    assert {501, None} <= {d for d, _ in got} and not any(d in {x for x, _ in got} for d in (306, 354))
