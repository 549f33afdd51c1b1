"""Rewriting, aliases, metadata, manifests, bundles and stores: against plain versions on unplanned rows, and odd ones."""

import hashlib
import os
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from provenant.operators import aliases, bundle, graph, rewrite, store
from provenant.sources import article_xml, bibliography, inventory


# Rewriting


def _folded(text, to):
    """Name after name over the whole text, longest first; places that are taken are shut off by characters of their own."""
    marks = {}
    for k, name in enumerate(sorted(to, key=lambda n: (-len(n), n))):
        marks[chr(0xE000 + k)] = name
        text = re.sub(rf"(?<![\w:-]){re.escape(name)}(?![\w:-])", chr(0xE000 + k), text)
    return "".join(to[marks[c]] if c in marks else c for c in text), sum(c in marks for c in text)


def _placed(text, to):
    """All places of all names, then one after the other where none touches it."""
    stands = lambda i, n: text.startswith(n, i) and not re.match(r"[\w:-]", text[i - 1 : i]) and not re.match(r"[\w:-]", text[i + len(n) :])
    kept = {}
    for n in sorted(to, key=lambda n: (-len(n), n)):
        for i in range(len(text)):
            if stands(i, n) and all(i + len(n) <= j or j + len(m) <= i for j, m in kept.items()):
                kept[i] = n
    for i in sorted(kept, reverse=True):
        text = text[:i] + to[kept[i]] + text[i + len(kept[i]) :]
    return text, len(kept)


@pytest.mark.parametrize("limit", [rewrite.BROADCAST_CHARS, 0])
@pytest.mark.parametrize("words", [True, False])
def test_rewrite(spark, limit, words):
    rng = random.Random(11)
    bits = ["ab", "a", "b", "é", "ab a", " ", " ", "-", ":", ".", "(", ")", "_", "B"]
    names = {"".join(rng.choice(bits) for _ in range(rng.choice((1, 2, 3, 4, 5, 7)))) for _ in range(60)}
    names = {n for n in names if re.search(r"[\w:-]", n) and (not words or re.fullmatch(r"[\w:-](?:.*[\w:-])?", n))}
    to = {n: f"<{k}>" for k, n in enumerate(sorted(names))}
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice((0, 1, 5, 40, 120))))) for i in range(150)] + [(7, None), (None, "ab a b"), (8, ""), (9, "a b"), (9, "a b")]
    texts = spark.createDataFrame([(i, t, "clash") for i, t in rows], "text_id int, text string, name string")
    listed = spark.createDataFrame([*to.items(), (None, "x"), ("", "x"), ("...", "x"), (sorted(names)[0], "<~>")], "name string, replacement string")
    got = [(r["text_id"], r["text"], r["n_replaced"]) for r in rewrite.rewrite(texts, listed, limit).collect()]
    # Names whose ends aren't word characters can touch one another: the fold then sees what it has put there.
    want = [(i, *((_folded if words else _placed)(t, to) if t else (t, 0))) for i, t in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    none = rewrite.rewrite(texts, listed.limit(0), limit).collect()
    assert sorted(map(repr, ((r[0], r[1], r[2]) for r in none))) == sorted(map(repr, ((i, t, 0) for i, t in rows)))
    assert rewrite.rewrite(texts.limit(0), listed, limit).count() == 0


def test_record_markers(spark):
    texts = spark.createDataFrame([(1, "a [rec: X1] b [rec:x1 ] c [rec: y] [rec: two words]"), (2, None), (3, "none")], "text_id int, text string")
    ids = spark.createDataFrame([("x1",), ("x1",), (None,)], "id string")
    link = '<a class="recref" href="assessments.html#rec-{0}">{0}</a>'
    got = {r[0]: r[1] for r in rewrite.linked_records(texts, ids).collect()}
    assert got == {1: f"a {link.format('X1')} b {link.format('x1')} c [rec: y] [rec: two words]", 2: None, 3: "none"}


# Aliases


def test_alias_setting(spark):
    rows = [(" A1 -> B2 , c->d,broken, ->x, y->, e -> f -> g",), ("<a -> b>",), (None,), ("",)]
    got = [[(p["alias"], p["target"]) for p in r[0]] for r in spark.createDataFrame(rows, "s string").select(aliases.pairs(F.col("s"))).collect()]
    assert got == [[("a1", "b2"), ("c", "d"), ("e", "f -> g")], [], [], []]


@pytest.mark.parametrize("seed", [1, 2])
def test_alias_ends(spark, seed):
    rng = random.Random(seed)
    to = {("p", f"a{i}"): f"a{rng.randrange(90)}" if rng.random() < 0.9 else f"k{i}" for i in range(60)}
    to |= {("q", f"c{i}"): f"c{i + 1}" for i in range(37)} | {("q", "r0"): "r1", ("q", "r1"): "r2", ("q", "r2"): "r0", ("q", "t0"): "t1", ("q", "t1"): "t2", ("q", "t2"): "r1", ("q", "self"): "self"}
    links = spark.createDataFrame([(p, a, t) for (p, a), t in to.items()], "project string, alias string, target string")

    def plain(p, a):
        at, n, seen = to[p, a], 1, []
        while (p, at) in to and at not in seen:
            seen.append(at)
            at, n = to[p, at], n + 1
        return (None, None, a in seen) if (p, at) in to else (at, n, False)

    got = {(r["project"], r["alias"]): (r["end"], r["steps"], r["loops"]) for r in aliases.ends(links).collect()}
    assert got == {k: plain(*k) for k in to}


def test_alias_problems(spark):
    given = spark.createDataFrame([("p", "x", "k"), ("p", "x", "k"), ("p", "k", "k2"), ("p", "y", "gone"), ("p", None, "k"), ("p", "z", ""), ("q", "y", "gone"), ("p", "u", "x")], "project string, alias string, target string")
    real = spark.createDataFrame([("p", "k"), ("p", "k2"), ("p", "k2")], "project string, key string")
    got = sorted(tuple(r) for r in aliases.problems(given, real).collect())
    assert got == sorted([("p", "duplicate", "x", "2"), ("p", "shadow", "k", None), ("p", "missing", "y", "gone"), ("p", "missing", "u", "x"), ("p", "chain", "x", "k2"), ("p", "chain", "u", "k2")], key=lambda r: r[:3])
    assert aliases.problems(given.limit(0), real).count() == 0


# Metadata


def test_page_metadata(spark):
    pages = [
        (1, '<head><META NAME="citation_title" content="No"><meta content=" A &amp; B " name="citation_title"><meta name="citation_author" content="de la Crúz, José"></head>'),
        (2, "<title>One</title><svg><title>Two</title></svg><meta name=DC.Date content='May 1987, 2001'><meta name='DC.Creator' content='Ann  Ó’Brien'>"),
        (3, '<script type="application/ld+json">{"@graph": [{"name": "G", "author": {"name": "X Y"}, "sameAs": ["http://doi.org/10.1234/AB"]}]}</script>'),
        (4, '<script type="application/ld+json">{broken</script><title> </title>'), (5, None), (6, ""), (7, "<title>cut off"), (8, '<script type="application/ld+json">[1, "x", {"name": 3}]</script>'),
    ]
    got = {r["i"]: (r["meta_title"], r["meta_author"], r["meta_year"], r["meta_doi"]) for r in bibliography.metadata(spark.createDataFrame([(i, h, "x") for i, h in pages], "i int, html string, meta_x string")).collect()}
    nothing = (None, None, None, None)
    assert got == {1: ("No", "de la cruz", None, None), 2: ("One", "obrien", "1987", None), 3: ("G", "y", None, "10.1234/ab"), 4: nothing, 5: nothing, 6: nothing, 7: nothing, 8: nothing}


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?>\n<PubmedArticleSet>' + "".join(f"<PubmedArticle><MedlineCitation><PMID Version='1'>{i}</PMID><Article><ArticleTitle>T{i} <sup>2</sup> end</ArticleTitle></Article></MedlineCitation></PubmedArticle>" for i in range(5)) + "</PubmedArticleSet>")
    (tmp_path / "b.xml").write_text('<article xmlns:x="u"><front><article-meta><article-id pub-id-type="doi"> 10.5555/Zz </article-id><title-group><article-title>One\n two</article-title></title-group></article-meta></front></article>')
    (tmp_path / "c.xml").write_text("<other/>")
    rows = article_xml.metadata(article_xml.read_articles(spark, str(tmp_path))).collect()
    assert sorted((r["file"], r["meta_title"], r["meta_doi"]) for r in rows) == [("a.xml", f"T{i} 2 end", None) for i in range(5)] + [("b.xml", "One\n two", "10.5555/zz")]
    texts = spark.createDataFrame([("<article><front/></article>",), (None,), ("not xml",), ("<article><front><article-meta><title-group><article-title>" + "x" * 400 + "</article-title></title-group></article-meta></front></article>",)], "xml string")
    got = [r["meta_title"] for r in article_xml.metadata(article_xml.parsed(texts, "xml")).collect()]
    assert got == [None, None, None, "x" * 300]


# Manifests


def _tree(files, depth):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = {}
    for path, digest in sorted(files.items(), key=lambda f: sha(f[0])):
        level.setdefault(sha(path)[:depth], []).append(sha(f"{path}\0{digest}"))
    level = {p: sha("".join(d)) for p, d in level.items()}
    found = {(depth, p): d for p, d in level.items()}
    for n in range(depth - 1, -1, -1):
        up = {}
        for p in sorted(level):
            up.setdefault(p[:n], []).append(level[p])
        level = {p: sha("".join(d)) for p, d in up.items()} or ({"": sha("")} if n == 0 else {})
        found |= {(n, p): d for p, d in level.items()}
    return found


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest(spark, depth):
    files = {f"dir/f{i}.html": hashlib.sha256(str(i).encode()).hexdigest() for i in range(70)}
    for some in (files, {}):
        df = spark.createDataFrame(list(some.items()), "path string, sha256 string")
        for n in (1, 7):
            assert {(r["level"], r["prefix"]): r["digest"] for r in inventory.tree(df.repartition(n), depth).collect()} == _tree(some, depth)
    later = {**{k: v for k, v in files.items() if k != "dir/f3.html"}, "dir/f9.html": "0" * 64, "new.pdf": "1" * 64}
    a, b = (spark.createDataFrame(list(x.items()), "path string, sha256 string") for x in (files, later))
    assert sorted(tuple(r) for r in inventory.changes(a, b, depth).collect()) == [("dir/f3.html", "removed"), ("dir/f9.html", "changed"), ("new.pdf", "added")]
    assert inventory.changes(a, a, depth).count() == 0


def test_scan(spark, tmp_path):
    for name, text in {"a.html": "<p>One</p><script>x</script>", "B.XML": "<r>Two</r>", "c.txt": "no", ".hidden.html": "no", "sub.pdf": "%PDF"}.items():
        (tmp_path / name).write_text(text)
    os.makedirs(tmp_path / "deep")
    (tmp_path / "deep" / "d.html").write_text("deeper")
    flat = inventory.scan(spark, str(tmp_path), "*.{pdf,html,xml,XML}")
    assert {(r["path"], r["extension"], r["size"], r["sha256"]) for r in flat.collect()} == {(n, n.rpartition(".")[2].lower(), os.path.getsize(tmp_path / n), hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()) for n in ("a.html", "B.XML", "sub.pdf")}
    assert {r["path"] for r in inventory.scan(spark, str(tmp_path), recursive=True).select("path").collect()} == {"a.html", "sub.pdf", "deep/d.html"}
    made = inventory.extracts(flat)
    assert {(r["path"], r["text"]) for r in made.collect()} == {("a.html", "One"), ("B.XML", "Two")}
    lines = inventory.checksum_lines(flat)
    assert inventory.checksum_problems(lines, flat).count() == 0
    digests = [r[0] for r in spark.createDataFrame([("a" * 64 + "  x",), ("A" * 64,), ("short",), (None,), ("a" * 65,)], "t string").select(inventory.sidecar(F.col("t"))).collect()]
    assert digests == ["a" * 64, "a" * 64, None, None, None]


# Bundles


def test_resolved(spark):
    rng = random.Random(4)
    bits = ["a", "b.html", "..", ".", "..", "c d", "é"]
    rows = []
    for _ in range(300):
        base = "/".join(rng.choice(["x", "y", "z"]) for _ in range(rng.choice((1, 2, 3))))
        url = rng.choice(["", "/"]) + "/".join(rng.choice(bits) for _ in range(rng.choice((1, 2, 4)))) + rng.choice(["", "?q=/../1", "#f/..", "?a#b#c"])
        rows.append((base, url))
    got = spark.createDataFrame(rows, "base string, url string").select("base", "url", bundle.resolved(F.col("base"), F.col("url")).alias("r")).collect()
    for r in got:
        path = urljoin(f"http://h/{r['base']}", r["url"])[len("http://h/") :]
        path = re.sub(r"[?#].*$", "", path).rstrip("/")
        assert r["r"]["path"] == path, r
        depth, out = (0 if r["url"].startswith("/") else r["base"].count("/")), False
        for part in re.sub(r"[?#].*$", "", r["url"]).split("/"):
            depth += -1 if part == ".." else 1 if part not in (".", "") else 0
            out, depth = out or depth < 0, max(depth, 0)
        assert r["r"]["outside"] == out and r["r"]["fragment"] == (r["url"].partition("#")[2] or None)


def test_bundle(spark):
    files = [
        ("b", "index.html", '<a href="sub/a.html#x">a</a><a href="http://e/">e</a><a href=\'sub/\'>s</a><a href="gone.html?x">g</a><a href="sub/a.html#no">n</a>'),
        ("b", "sub/a.html", '<p id="x"><a href="../index.html">i</a><a href="../../up">u</a><img src="//cdn/x.png"><link rel=x href="https://cdn/x.css">'),
        ("b", "sub/alone.html", '<a href="a.html">a</a>'), ("c", "index.html", None), ("b", "index.html", ""),
    ]
    df = spark.createDataFrame([(*f, "x") for f in files], "bundle string, path string, html string, node string")
    index = df.filter("path = 'index.html'").select("bundle", "path")
    got = sorted((r["bundle"], r["path"], r["code"], r["detail"]) for r in bundle.problems(df, index).collect())
    assert got == sorted([("b", "index.html", "dead", "gone.html?x"), ("b", "index.html", "no anchor", "sub/a.html#no"), ("b", "sub/a.html", "outside", "../../up"), ("b", "sub/a.html", "remote", None), ("b", "sub/alone.html", "unreachable", None)], key=lambda x: x[:3])
    assert bundle.problems(df.limit(0), index.limit(0)).count() == 0


def test_reachable(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)}
    known = {0, 7}
    while more := {b for a, b in edges if a in known} - known:
        known |= more
    got = graph.reachable(spark.createDataFrame(list(edges), "node int, next int"), spark.createDataFrame([(0,), (7,), (7,)], "node int"))
    assert sorted(r[0] for r in got.collect()) == sorted(known)


# Stores


def _state(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    store.create(spark.createDataFrame([(f"i{k}", f"text {k}") for k in range(40)], "id string, text string"), path, 8)
    before = _state(path)
    changes = spark.createDataFrame(
        [("i1", "newer", sha("text 1")), ("i2", "late", sha("older")), ("i3", "text 3", "any"), ("n1", "first", None), ("n2", "x", "seen"), ("i4", "a", sha("text 4")), ("i4", "b", sha("text 4")), ("i5", "c", sha("text 5")), ("i5", "c", sha("text 5")), (None, "x", None), ("i6", None, sha("text 6"))],
        "id string, text string, expected string",
    )
    got = sorted((str(r["id"]), r["outcome"]) for r in store.apply(spark, path, changes, 8).collect())
    assert got == sorted([("i1", "changed"), ("i2", "stale"), ("i3", "same"), ("n1", "new"), ("n2", "stale"), ("i4", "conflict"), ("i4", "conflict"), ("i5", "changed"), ("None", "invalid"), ("i6", "invalid")])
    now = {r["id"]: (r["text"], r["digest"]) for r in store.read(spark, path).collect()}
    want = {f"i{k}": f"text {k}" for k in range(40)} | {"i1": "newer", "n1": "first", "i5": "c"}
    assert now == {k: (v, sha(v)) for k, v in want.items()}
    after = _state(path)
    parts = {os.path.dirname(f) for f in after if before.get(f) != after[f]}
    touched = {r["part"] for r in store.read(spark, path).filter("id in ('i1', 'i5', 'n1')").collect()}
    assert {int(p.rpartition("part=")[2]) for p in parts} == touched
    again = {(str(r["id"]), r["outcome"]) for r in store.apply(spark, path, changes, 8).collect()}
    assert ("i1", "same") in again and ("n1", "same") in again and not {o for _, o in again} & {"new", "changed"}
    assert _state(path) == after


def test_records_are_sealed(spark):
    from provenant.operators import records

    asked = spark.createDataFrame([("r1", "status", " K:a ", ["K:b"], None, None, None, "20240101"), ("r2", "status", "nowhere", None, "s", None, None, "20240101")], "id string, kind string, subject string, grounding array<string>, span string, disputes array<string>, reviews array<string>, assessed_date string")
    claims = spark.createDataFrame([("k", "a", "body"), ("k", "a", "body")], "key string, alias string, body string")
    made = store.judgements(asked, claims, "a person", "tool")
    rows = {r["id"]: r for r in made.select("id", records.sealed(F.col("text")).alias("sealed"), F.get_json_object("text", "$.body_sha256").alias("body")).collect()}
    assert rows["r1"]["sealed"] and rows["r2"]["sealed"] and rows["r1"]["body"] == hashlib.sha256(b"body").hexdigest() and rows["r2"]["body"] == ""


def test_frontmatter(spark):
    rows = ["", "a\nb", "---\nx: 1\n---\nrest\n\n", "---\r\nx: 1\r\ny : 2\r\nx: 3\r\n---\r\n", "---\nopen", "x\n---\nx: 1\n---"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(store.upserted(F.col("t"), {"x": F.lit("9"), "z": F.lit("8")})).collect()]
    new = 'x: "9"\nz: "8"\n'
    assert got == [f"---\n{new}---\n", f"---\n{new}---\na\nb\n", f"---\n{new}---\nrest\n\n", '---\nx: "9"\ny : 2\nx: 3\nz: "8"\n---\n', f"---\n{new}---\n---\nopen\n", f"---\n{new}---\nx\n---\nx: 1\n---\n"]
