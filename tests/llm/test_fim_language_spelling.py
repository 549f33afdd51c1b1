"""Fill-in-middle, language identification and spelling variants: against plain versions, round trips, and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import fim, language_id, spelling

DOC = "doc_id long, text string, lang string, source string, n_chars long, `output` string, `h` int, `key` int, `word` string, `node.x` int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, "x", 1, 2, "w", 3) for i, t, lang in rows], DOC)


# Fill-in-middle


def _plain_fim(doc_id, text):
    text = text or ""
    n = len(text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    begins = [k.start() for k in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    words = [sum(k < a for k in begins), sum(a <= k < b for k in begins)]
    return n, "spm" if spm else "psm", a, b - a, *words, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(3)
    bits = ["a", "é", "𝄞", " ", "\n", "\t", " ", "<", "P>", "S", ">", "<M", "word", "\x0b"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice((0, 1, 2, 9, 60)))), None) for i in range(300)]
    rows += [(900, None, "en"), (901, "has <P> in it", "en"), (902, "<S>", None), (None, "no id", None), (5, rows[5][1], None), (903, "long text " * 50_000, None), (904, " \n ", None)]
    made = fim.fill_in_middle(_docs(spark, rows))
    got = sorted(map(repr, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["prefix_words"], r["middle_words"], r["output"]) for r in made.collect())))
    assert got == sorted(repr((i, *_plain_fim(i, t))) for i, t, _ in rows)
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(repr, ((r[0], r[1]) for r in back))) == sorted(repr((i, t or "")) for i, t, _ in rows)
    sums = fim.digests(made).collect()
    assert all(r["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for r in sums for i, t, _ in rows if i == r["doc_id"] and i is not None)


@pytest.mark.parametrize("unit,pattern", [("word", r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_fill_in_middle_units(spark, unit, pattern):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["ab", "é", " ", "\n", "  "]) for _ in range(rng.choice((0, 1, 5, 40)))), None) for i in range(120)]
    for r in fim.fill_in_middle(_docs(spark, rows), unit=unit, rate=100).collect():
        text = rows[r["doc_id"]][1]
        starts = [m.start() for m in re.finditer(pattern, text)]
        assert r["n"] == len(starts)
        if r["form"] != "plain":
            a, b = sorted(h % (len(starts) + 1) for h in fim.draws(r["doc_id"])[:2])
            ends = [*starts, len(text)]
            assert (r["prefix_chars"], r["middle_chars"]) == (ends[a], ends[b] - ends[a])


def test_fill_in_middle_refuses():
    for wrong in (("<P>", "", "<M>"), ("<P>", "a b", "<M>")):
        with pytest.raises(ValueError):
            fim.automaton(fim.SPACE, wrong)


# Language identification


def _plain_vectors(text):
    """A text's bundle, letter by letter."""
    codes = [0]
    for c in text or "":
        x = ord(c.lower()[0]) if c.isalpha() else 0
        if x or codes[-1]:
            codes.append(x)
    if codes[-1]:
        codes.append(0)
    of = lambda x: language_id.letter_vectors(np.array([x], np.uint64))[0].astype(np.int64)
    made = np.zeros(language_id.DIMENSIONS, np.int64)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        made += np.roll(of(a), 2) * np.roll(of(b), 1) * of(c)
    return made


def test_text_vectors():
    texts = ["", None, "a", "Ab c", "ÀÉ ñ", "one two  three\n4", "12 34", "汉字 Wort", "x" * 700]
    made, some = language_id.text_vectors(texts)
    for t, v, s in zip(texts, made, some, strict=True):
        want = _plain_vectors(t)
        assert s == bool(want.any())
        assert np.allclose(v, want / max(np.linalg.norm(want), 1e-9))


def test_blocks_of_long_texts(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("ab çé. ") for _ in range(3000))
    whole = language_id.grams(text)
    for block in (1, 7, 100, 2999, 3000):
        monkeypatch.setattr(language_id, "BLOCK", block)
        found = language_id.grams(text)
        assert (found[0] == whole[0]).all() and (found[1] == whole[1]).all()


def test_language_id(spark):
    rng = random.Random(9)
    words = {"aa": ["kam", "toka", "makat"], "bb": ["selin", "ries", "liese"], "cc": ["umbro", "bruno", "ombu"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.choice((2, 20, 300)))), k) for i, k in ((i, rng.choice("abc") * 2) for i in range(300))]
    odd = [(400, None, "aa"), (401, "", "bb"), (402, "12 !", None), (None, "kam toka", "aa"), (403, "selin ries", None), (404, "selin ries", None), (404, "selin ries", None)]
    got = language_id.language_id(_docs(spark, rows + odd)).collect()
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(by[i]["held_out"] == held[i] and 0 <= by[i]["score"] <= 1 for i, _, _ in rows)
    assert np.mean([by[i]["lang_pred"] == k for i, _, k in rows if held[i]]) > 0.97
    assert [by[i]["lang_pred"] for i in (400, 401, 402, None, 403, 404)] == ["und", "und", "und", "aa", "bb", "bb"] and by[402]["score"] == 0
    # A plain version: prototypes of unit vectors of the same documents, and cosines.
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    proto = {k: unit(sum(unit(_plain_vectors(t)) for i, t, x in rows + odd if x == k and not held.get(i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1))) for k in words}
    for i, t, _ in rows[:60]:
        like = {k: float(unit(_plain_vectors(t)) @ p) for k, p in proto.items()}
        assert by[i]["lang_pred"] == max(like, key=like.get) and abs(by[i]["score"] - max(like.values())) < 1e-5


def test_language_labels_are_no_input(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["kam", "toka"] if i % 2 else ["ries", "selin"]) for _ in range(30)), "aa" if i % 2 else "bb") for i in range(120)]
    base = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(_docs(spark, rows)).collect()}
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else k) for i, t, k in rows]
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(_docs(spark, other)).collect()} == base


def test_bounded_sample_of_a_language(spark):
    docs = _docs(spark, [(i, f"kam toka {i}", "aa") for i in range(300)] + [(1000 + i, "selin ries", "bb") for i in range(5)])
    found = language_id.profiles(docs, per_language=20)
    assert found.names == ["aa", "bb"]
    assert found.closest(["toka kam", "ries"])[0] == ["aa", "bb"]


# Spelling variants


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("most", [1, 6, 200])
def test_near_pairs(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice((2, 3, 4, 5, 6, 7)))) for _ in range(260)} | {"aaaaaaa", "aaaaaaaa", "aaaaaa", "x", "xy", "é" * 40, "é" * 41}
    df = spark.createDataFrame([(w, k + 1) for k, w in enumerate(sorted(words))], "word string, n long")
    got = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(df, most).collect()]
    want = {tuple(sorted((a, b))) for a in words for b in words if a < b and min(len(a), len(b)) >= 2 and _near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def _plain_variants(rows):
    count = Counter()
    upper = {ord(a): b for a, b in zip(spelling.UPPER, spelling.LOWER, strict=True)}
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in words if x != w and _near(w, x)] for w in words}
    form = {w: (min(v, key=lambda x: (-words[x], x)) if v else None) for w, v in near.items()}
    form = {w: f if f and words[f] >= 5 * words[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def test_variants(spark):
    rng = random.Random(6)
    base = ["colour", "collour", "ÉtrangÈ", "letters", "abcdefghijkl", "Station"]
    chain = [("gardens", 6), ("garden", 31), ("gardan", 160), ("garxan", 5), ("ardan", 900)]
    rows = [(i, " ".join(rng.choice(base) for _ in range(rng.choice((0, 3, 60)))), None) for i in range(80)]
    rows += [(200 + k, f"{w}, " * n, None) for k, (w, n) in enumerate(chain)]
    rows += [(300, None, None), (None, "colour colour×÷ 12", None), (301, "", None), (301, "", None), (302, "colour", None), (302, "colour", None)]
    got = sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(_docs(spark, rows)).collect())
    want = _plain_variants(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    ends = {w: root for w, _, root, *_ in got}
    assert ends["gardens"] == ends["garden"] == "gardan"


def test_slips_change_counts(spark):
    rows = [(i, "frequent " * 3, None) for i in range(1000)]
    want = _plain_variants(rows)
    assert any(w != "frequent" for w, *_ in want)
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(_docs(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty_tables(spark):
    none = _docs(spark, []).limit(0)
    assert fim.digests(fim.fill_in_middle(none)).count() == 0
    assert language_id.language_id(none).count() == 0
    assert spelling.variants(none).count() == 0
    nothing = _docs(spark, [(1, "too few", "en")])
    assert spelling.variants(nothing).count() == 0
    assert [r["lang_pred"] for r in language_id.language_id(_docs(spark, [(1, "word", None)])).collect()] == ["und"]
