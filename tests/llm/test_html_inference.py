"""Wrappers inferred by alignment: they match every page they come from, and keep what is main text."""

import random
import re

import pytest

from provenant.llm import html_wrappers as H


def _texts(spark, pages, hosts=None):
    rows = [(i, f"http://{hosts[i] if hosts else 'h'}.example/a", p) for i, p in enumerate(pages)]
    return {r.page_id: (r.text, r.by) for r in H.decided(H._plain(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html")).collect()}


def _page(rng, depth=0):
    """Parts of a random template's page: constants in fixed places, optional and repeated slots between them."""
    made = []
    for k in range(6):
        if rng.random() < 0.5:
            made.append((100 + k, True, True))
        made += [(1 + k % 3, False, True)] * rng.choice((0, 1, 1, 3))
        made += [(7, False, True), (8, False, True)] * rng.choice((0, 0, 1, 2, 4))
    return made


@pytest.mark.parametrize("seed", range(12))
def test_wrapper_matches_its_pages(seed):
    rng = random.Random(seed)
    pages = [_page(rng) for _ in range(9)]
    streams = [H.stream(p) for p in pages]
    name = lambda k: chr(0x100 + k)
    raw = ["".join(name(k) for k, _, _ in p) for p in pages]
    for s, text in zip(streams, raw, strict=True):
        assert re.fullmatch(H.expression(s, name), text)
    whole = H.inferred(streams)
    tree = H.inferred([H.inferred(streams[:4]), H.inferred(streams[4:])])
    for wrapper in (whole, tree):
        assert all(re.fullmatch(H.expression(wrapper, name), text) for text in raw)
        for s, p in zip(streams, pages, strict=True):
            assert len(H.between_slots(wrapper, s)) == sum(const for _, const, _ in p)


def test_long_lists_are_aligned(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(H, "CELLS", 10)
    name = lambda k: chr(0x100 + k)
    for _ in range(20):
        pages = [_page(rng) for _ in range(5)]
        wrapper = H.inferred([H.stream(p) for p in pages])
        assert all(re.fullmatch(H.expression(wrapper, name), "".join(name(k) for k, _, _ in p)) for p in pages)


def test_inference_by_hand():
    a, b, c = ((k, False, True) for k in (1, 2, 3))
    x, y = (101, True, True), (102, True, True)
    streams = [H.stream(p) for p in ([x, a, b, a, b, y], [x, a, b, y, c], [x, y])]
    assert [(s.ids, s.many, s.optional) for s in H.inferred(streams)] == [((101,), False, False), ((1, 2), True, True), ((102,), False, False), ((3,), False, True)]
    assert H.expression(H.inferred(streams)) == "(?:101)(?:12)*(?:102)(?:3)?"


def test_near_copies_keep_their_text(spark):
    """Copies of one article that differ in a counter are no layout, however many there are."""
    story = "".join(f"<p>Sentence {k} of a story that all copies tell alike, to its end.</p>" for k in range(6))
    each = [(n, tag, i) for n in (3, 4, 6, 40) for tag in ("article", "div") for i in range(n)]
    got = _texts(spark, [f"<body><{tag}><h1>One story</h1>{story}<p>Views: {i}</p></{tag}>" for _, tag, i in each], [f"{tag}{n}" for n, tag, _ in each])
    for k, (_, _, i) in enumerate(each):
        assert got[k][0].startswith("One story\nSentence 0") and got[k][0].endswith(f"its end.\nViews: {i}")


def test_copies_beside_other_stories(spark):
    page = lambda k, n: f"<body><div class=a>Site</div><div class=q><h1>Title {k}</h1><p>Story {k} goes on for a while here.</p><p>Views {n}</p></div><div class=z>Foot</div>"
    got = _texts(spark, [page(0, n) for n in range(20)] + [page(k, 0) for k in range(1, 4)])
    assert all(got[n] == (f"Title 0\nStory 0 goes on for a while here.\nViews {n}", "wrapper") for n in range(20))


def test_headings_that_all_pages_have(spark):
    """A constant between slots is main text, one around them isn't; some pages lack a part."""
    page = lambda i: f"<body><div class=t>Recipes of the house</div><article><h1>Dish {i}</h1><h2>Ingredients</h2><ul>{f'<li>{i} grams</li>' * (i % 3 + 1)}</ul><h2>Method</h2><p>Cook it {i} times, then wait.</p></article><div class=u>All rights reserved</div>"
    each = [(n, i) for n in (2, 3, 5, 12) for i in range(n)]
    got = _texts(spark, [page(i) for _, i in each], [f"h{n}" for n, _ in each])
    for k, (_, i) in enumerate(each):
        assert got[k][0] == "\n".join([f"Dish {i}", "Ingredients", *[f"{i} grams"] * (i % 3 + 1), "Method", f"Cook it {i} times, then wait."])


def test_heading_without_text_below_it(spark):
    """The wrapper knows that text may follow a heading, also on a page where none does."""
    page = lambda i: f"<body><div class=x><h1>Dish {i}</h1><p>About dish {i} and its kind</p><h2>Notes</h2>{'' if i == 3 else f'<ul><li>note {i}</li></ul>'}</div><div class=u>Reserved</div>"
    got = _texts(spark, [page(i) for i in range(8)])
    assert got[3][0] == "Dish 3\nAbout dish 3 and its kind\nNotes" and got[4][0].endswith("Notes\nnote 4")


def test_many_streams_of_a_host(spark, monkeypatch):
    """Streams are aligned a few at a time, in rounds, and pages of one text count once."""
    rng = random.Random(7)
    monkeypatch.setattr(H, "AT_ONCE", 2)
    pages = []
    for i in range(60):
        parts = "".join(f"<{t}>{t} text {i} {k}</{t}>" for k, t in enumerate(rng.choices(["p", "h3", "pre", "blockquote"], k=rng.randint(1, 9))))
        pages.append(f"<body><div class=a>Top</div><div class=m><h1>T {i}</h1><h2>Fixed</h2>{parts}</div><div class=b>Foot</div>")
    got = _texts(spark, pages + pages[:5])
    for i, page in enumerate(pages + pages[:5]):
        want = [f"T {i % 60}", "Fixed", *re.findall(r">((?:p|h3|pre|blockquote) text [^<]*)<", page)]
        assert got[i] == ("\n".join(want), "wrapper")


def test_streams_that_have_too_many_items(monkeypatch):
    monkeypatch.setattr(H, "ITEMS", 3)
    slots = [H.stream([(k, False, True) for k in ks]) for ks in ((1, 2), (3, 4), (1, 2))]
    assert H.inferred(slots) == [] and H.inferred([[], slots[0]]) == [] and H.inferred(slots[:1]) == slots[0]


def test_odd_pages(spark):
    got = _texts(spark, [None, "", "<div>", "<p>x", "<p>x", "<div class=a>" * 50])
    assert {k: v[0] for k, v in got.items()} == {0: "", 1: "", 2: "", 3: "x", 4: "x", 5: ""}
