"""A layout's size changes nothing in how its pages are judged."""

import random

from provenant.llm import html_wrappers as H


def _name(n):
    return "".join("abcdefghij"[int(c)] for c in str(n))


def test_a_wrapper_of_more_items_than_the_bound(spark):
    """Pages whose blocks all have classes of their own, at a few blocks a page and at 1500."""
    for size in (3, 1500):
        body = lambda i, size=size: "".join(f"<p class=x{_name(i * size + k)}>Text {k} of page {i}</p>" for k in range(size))
        pages = [f"<body><div class=t>Top of all</div><div class=m><h1>Title {i}</h1>{body(i)}</div><div class=u>Foot of all</div>" for i in range(4)]
        rows = [(i, "http://h.example/a", p) for i, p in enumerate(pages)]
        got = {r.page_id: (r.text, r.by) for r in H.decided(H._plain(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html")).collect()}
        for i in range(4):
            assert got[i] == ("\n".join([f"Title {i}", *(f"Text {k} of page {i}" for k in range(size))]), "wrapper")


def test_places_do_not_depend_on_the_cells_held_at_once(monkeypatch):
    rng = random.Random(3)
    lists = [([rng.randrange(6) for _ in range(rng.randrange(60))], [rng.randrange(8) for _ in range(rng.randrange(60))]) for _ in range(100)]
    whole = [H._matches(a, b, [3 if k < 2 else 1 for k in a]) for a, b in lists]
    for cells in (1, 40, 500):
        monkeypatch.setattr(H, "CELLS", cells)
        assert [H._matches(a, b, [3 if k < 2 else 1 for k in a]) for a, b in lists] == whole


def test_no_bound_unless_one_is_set():
    slots = [H.stream([(k, False, True) for k in range(n, n + 3000)]) for n in (0, 3000)]
    assert H.inferred(slots) == [] and len(H.inferred(slots, 6000)) == 6000 and H.inferred(slots, 5999) == []
