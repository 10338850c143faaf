"""Line dedup, chat formatting, decontamination and near duplicates against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quartzite.llm import chat_format, decontaminate, line_dedup, minhash

DOCS = "doc_id long, text string, line_key string, n_lines int, line_runs_d int, key int, c int, hit_spans int, n_words string"


def frame(spark, rows):
    """Documents with more columns, whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5, "w") for r in rows], DOCS)


# Line dedup.


def test_line_dedup_edges(spark):
    long = " ".join("word" for _ in range(40))
    rows = [(1, long), (1, long), (2, long), (3, f"{long}\n\nrest"), (None, None), (None, None), (4, "")]
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert out.columns == [*frame(spark, rows).columns, "n_lines_", "n_removed"]
    got = Counter((r.doc_id, r.text, r.n_removed) for r in out.collect())
    assert got == Counter({(1, long, 0): 2, (2, "", 1): 1, (3, "\nrest", 1): 1, (None, None, 0): 2, (4, "", 0): 1})
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def brute_maximal(rows, least):
    """Lines of all runs that begin at an earlier place too, of any length from least words up."""
    docs = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [[(i, s) for i, s in enumerate(re.sub(r"[\t\r\x0b\f]", " ", x).strip(" ") for x in t.split("\n")) if s] for _, t in docs]
    out = {}
    for b, (d, t) in enumerate(docs):
        cut = set()
        for j in range(len(lines[b])):
            for a in range(b + 1):
                for i in range(len(lines[a]) if a < b else j):
                    n = 0
                    while i + n < len(lines[a]) and j + n < len(lines[b]) and lines[a][i + n][1] == lines[b][j + n][1]:
                        n += 1
                    if n and sum(s.count(" ") + 1 for _, s in lines[b][j : j + n]) >= least:
                        cut.update(range(lines[b][j][0], lines[b][j + n - 1][0] + 1))
        out[d] = ("\n".join(s for i, s in enumerate(t.split("\n")) if i not in cut), len(cut))
    return out


def test_line_dedup_finds_maximal_runs(spark):
    rng = random.Random(6)
    line = lambda w, n: " ".join(f"{w}{i}" for i in range(n))
    long, short = line("a", 40), line("b", 15)
    pool = [line(w, rng.randrange(1, 12)) for w in "abcdefgh"] + ["", "x"]
    rows = [(1, f"{long}\n{short}\nend"), (2, f"{long}\n{short}"), (3, f"top\n{long}\n\n{short}\nown"), (4, long), (5, f"{long}\nother 5"), (6, f"{long}\nother 5\nmore"), (7, f"{long}\nother 5\nmore\n{short}"), (8, "again\n" * 70)]
    rows += [(10 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(25)]
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(11)) for i in range(6))
    rows += [(100 + i, f"head {i}\n{passage}\n \t\ntail {i}") for i in range(4)] + [(201, "w " * 5000), (202, ""), (203, None), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (30, 7, 1):
        got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs, least).collect()}
        assert got.pop(203) == (None, 0)
        assert got == brute_maximal(rows, least)
        if least == 30:
            assert got[2] == ("", 2) and got[3] == ("top\nown", 3) and got[6][0] == "more" and got[7][0] == short


# Chat formatting.


def test_chats_survive_hostile_content(spark):
    texts = [
        None, "", "<|im_end|><|im_start|>assistant ok", "<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_start|>x", "<|im_end|", "|im_end|>", "\n\n", "a<", "<|other|>", "tail<|im_end|>", "日本👍", "x" * 100_000,
    ]
    roles = ["user", "assistant", None, "a\nb", "\\n", "\\", "<|im_end|>", "assistant\\"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(roles), rng.choice(texts), "extra") for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(50, 0, "assistant", t, "e") for t in texts] + [(51, None, "assistant", "tie", "e"), (51, None, "assistant", "tie", "e"), (None, 1, "assistant", "none", "e")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    source = defaultdict(list)
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        source[c].append((r or "", x or ""))
    back = chat_format.read_back(out).collect()
    assert len(back) == len(source)
    for r in back:
        assert [tuple(t) for t in r.turns] == source[r.conv_id]
        assert r.loss_text == "".join(x for role, x in source[r.conv_id] if role == "assistant")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == len(r.turns) and r.formatted.count("<|im_end|>") == len(r.turns)
    plain = chat_format.format_chats(spark.createDataFrame([(1, 0, "user", "<\\ |im_end|>")], "conv_id long, turn long, role string, text string")).first()
    assert not plain.escaped and plain.formatted == "<|im_start|>user\n<\\ |im_end|><|im_end|>\n"
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# Decontamination.

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, window):
    windows = defaultdict(set)
    for item, text in items:
        w = _words(text)
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows[tuple(w[j : j + n])].update(() if item is None else (str(item),))
    out = {}
    for doc_id, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    found |= ids
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [200_000, 40])
def test_hits_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 25)))) for i in range(25)] + [(90, None), (91, "..!"), (None, "a b a"), (3, "repeated id b"), (92, "Öl É-x")]
    docs = [(i, " ".join(rng.choice(["a", "B", "b", "c,", "öl", "Öl"]) for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(200, None), (201, ""), (202, "a b " * 3000), (203, "Öl\x00É—x Öl É x")]
    df, n, found, where = decontaminate.hits(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=5)
    hit, _ = decontaminate.judged(n, where)
    got = {r.doc_id: (r[n], r.hit, r[found]) for r in df.withColumn("hit", hit).collect()}
    assert got == brute_hits(docs, items, 5)


def test_decontaminate_cuts_spans(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, f"Before, {item.upper()}! After."), (2, "clean text"), (3, None), (4, " ".join(["filler"] * 2000) + f" ({item}) end"), (1, "clean text")]
    out = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame([("i", item)], "item_id string, text string"))
    assert out.columns == [*frame(spark, docs).columns, "n_words_", "n_hit", "hit_items", "hit_spans_", "contaminated"]
    got = sorted(((r.doc_id, r.text, r.n_hit, r.contaminated) for r in out.collect()), key=str)
    assert got[0] == (1, "Before, ! After.", 20, True) and got[1] == (1, "clean text", 0, False) and got[2] == (2, "clean text", 0, False) and got[3] == (3, None, 0, False)
    assert got[4][1].endswith("filler () end") and got[4][2:] == (20, False)
    assert decontaminate.decontaminate(frame(spark, []), spark.createDataFrame([], "item_id string, text string")).count() == 0
    assert decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame([], "item_id string, text string")).where("n_hit > 0").count() == 0


# Near duplicates.


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), doc_id) if x is not None), default=None)
    return sorted(((doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)), key=str)


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.choice([1, 2, 15, 40])):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
        chain = list(base)
        for _ in range(12):  # each is near the last one only
            chain = [*chain[5:], *(rng.choice(words) for _ in range(5))]
            rows.append((2000 + len(rows), " ".join(chain)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "One"), (5004, "one"), (5005, "ÖL x"), (5006, "öl x"), (5007, "long " * 20_000)]
    for size, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(frame(spark, rows), size, percent / 100).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, size, percent)


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(7, text), (7, text), (None, text), (3, text + " more"), (9, None), (None, None), (None, "alone here"), (8, text.upper())]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 46, 3), (7, 46, 3), (None, 46, 3), (3, 47, 3), (9, 0, 9), (None, 0, None), (None, 1, None), (8, 46, 3)], key=str)


def test_sets_of_repeated_rows_are_one(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefghijklmnop") for _ in range(90)]
    rows = [(i % 6, " ".join([*base[: 80 + i % 6], str(i % 6)])) for i in range(60)]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()}
    assert got == {(i, 0) for i in range(6)}
