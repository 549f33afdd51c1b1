"""Main text of web pages by wrappers: union-free regular expressions inferred by aligning the token streams of a host's pages.

A page's blocks are texts under paths of elements. Pages of a host that have the same containers are of one layout. A text
that every page with its path has is a constant, all other text is in slots; the innermost element with nearly all slot
text is the layout's region. A page's stream is its constants and slots in page order, a run that repeats folded into one
repeated group. Streams of a layout are aligned two by two, and what has come of them likewise, up a tree, until one is
left: what both have stays, repeated where one of them repeats, and what only one has becomes optional. That is the
layout's wrapper, in which each page's stream is found again. Extraction keeps slot text in the region, and the constants
that stand between its slots in the wrapper: headings that all pages have stay, and what stands around the region's text
goes. Where no wrapper applies, an element that HTML marks as the main one is the region, else the body.
"""

from __future__ import annotations

import functools
import html as references
import math
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import bounded_batches, column, cut, is_empty, map_batches

#: Most bytes of wrappers that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Where less than this part of the text is in slots, pages are copies of one, which differ in a counter or a date, and not a
#: layout: of the text of elements that HTML marks as main ones, and where there are none of all text.
COPIES = {"marked": 0.5, "all": 0.2}
#: Streams that are aligned in one task, most blocks of one turn of a repeated group, and most items of what inferred() gives
#: where its caller sets no bound; wrappers() sets none.
AT_ONCE, TURN, ITEMS = 8, 6, 4000
#: Cells of an alignment's table that are held at once.
CELLS = 1_000_000
#: Ends each key in a path's string.
END = "\x1f"

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']|["'](?=[^<]*>))*)(>|\Z)|<[!?/][^>]*(?:>|\Z)|<[A-Za-z/!?]?[^<>]*\Z(?<=<)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements by how HTML treats them, and names that mark what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg canvas math object audio video nav footer aside form button select option datalist input fieldset menu dialog head map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ALONE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies respond disqus discussion share sharing social related recommended newsletter subscribe subscription signup login footer masthead widget toolbar pagination pager skip hidden".split())
#: Words beside a mark that leave a class name one: site-footer is a footer, has-sidebar isn't a sidebar.
NEUTRAL = frozenset("bar block box buttons container global inner left links list main modal nav outer page panel post posts right section site slot top bottom wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = ("article", "main")
CONTENT = frozenset("p pre h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table blockquote figure figcaption".split())


class Item(NamedTuple):
    """Part of a stream: a constant's key, or the keys of the paths of one turn of a group of slots. inside: in the region."""

    ids: tuple[int, ...]
    const: bool
    inside: bool
    many: bool
    optional: bool


class Token(NamedTuple):
    """kind: open, close or text. name: the element's, or the text, references decoded. drop: marked as boilerplate."""

    kind: str
    name: str
    key: str = ""
    drop: bool = False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


@functools.lru_cache(maxsize=4096)
def _marks(label: str) -> bool:
    """Whether a class name or id as a whole names boilerplate: of its words one does, and the others say nothing else."""
    words = {w.lower() for w in _WORD.findall(label)}
    return bool(words & MARKS) and words <= MARKS | NEUTRAL


def _opened(name: str, text: str) -> Token:
    if not text or text.isspace():
        return Token("open", name, name, name in DROPPED)
    at = _attributes(text)
    role = at.get("role", "").lower()
    key = "main" if role == "main" else name
    unseen = "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()
    named = key not in (*MAIN, "body", "html") and any(map(_marks, f"{at.get('class', '')} {at.get('id', '')}".split()))
    drop = name in DROPPED or unseen or named or role in ROLES
    if key == "main":
        return Token("open", name, "main", drop)
    return Token("open", name, name + ("." + ".".join(sorted(re.sub(r"\d+", "", c) for c in at["class"].split())) if at.get("class") else ""), drop)


def tokens(page: str | None) -> Iterator[Token]:
    """The page's stream. Comments, declarations, raw elements' contents and a tag cut off by the end are left out."""
    page = page or ""
    at, low = 0, None
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            yield Token("text", references.unescape(text) if "&" in text else text)
        if not m:
            return
        at = m.end()
        if m[0].startswith("<![CDATA["):
            yield Token("text", m[0][9:].removesuffix("]]>"))
        if not m[2] or not m[4]:
            continue
        name = m[2].lower()
        if m[1]:
            yield Token("close", name, name)
            continue
        yield _opened(name, m[3])
        if name in VOID:
            yield Token("close", name, name)
        elif name in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{name}", at)
            at = len(page) if end < 0 else end


class Block(NamedTuple):
    """A block's text, the keys of the elements around it, each with END behind it, whether one of them is boilerplate, and which of MAIN it is in (-1: none)."""

    text: str
    path: str
    drop: bool
    main: int


class _Element:
    """An open element. Its path is that of all block elements down to it; main is the least place in MAIN of those around it."""

    __slots__ = ("name", "path", "marked", "main", "parent", "form")

    def __init__(self, name: str, key: str, marked: bool, parent: _Element | None):
        self.name, self.marked, self.parent = name, marked, parent
        self.form = self if name == "form" else parent.form if parent else None
        above = parent.path if parent else ""
        self.path = above if name in INLINE else above + key + END
        own = MAIN.index(at) if (at := key.partition(".")[0]) in MAIN else -1
        self.main = own if not parent or parent.main < 0 else parent.main if own < 0 else min(own, parent.main)


def blocks(stream: Iterator[Token]) -> list[Block]:
    """Texts between tags of blocks, white space as one space, in page order.

    An element that holds an article or a main element is no boilerplate, whatever its name, nor is a form around more
    than half of the page's text.
    """
    stack: list[_Element] = []
    found: list[tuple[str, _Element | None]] = []
    pending: list[str] = []

    def flush() -> None:
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            found.append((text, stack[-1] if stack else None))

    for t in stream:
        if t.kind == "text":
            pending.append(t.name)
        elif t.kind == "open":
            if t.name == "br":
                pending.append(" ")
                continue
            if t.name not in INLINE or t.drop:
                flush()
                if t.name in CLOSES_P:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i].name == "p":
                            del stack[i:]
                            break
                        if stack[i].name not in INLINE:
                            break
                if t.name in ALONE:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i].name in ALONE[t.name]:
                            del stack[i:]
                            break
                        if stack[i].name in ("ul", "ol", "dl", "table", "select"):
                            break
            parent = stack[-1] if stack else None
            made = _Element(t.name, t.key, t.drop or (t.name == "header" and (parent is None or parent.main < 0)), parent)
            if made.main >= 0 and (parent is None or parent.main < 0):
                while parent is not None:
                    parent.marked, parent = False, parent.parent
            stack.append(made)
        else:
            if t.name == "br":
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == t.name:
                    if t.name not in INLINE or stack[i].marked:
                        flush()
                    del stack[i:]
                    break
            else:
                if t.name not in INLINE:
                    flush()
    flush()
    held: dict[_Element, int] = {}
    for text, e in found:
        if e is not None and e.form is not None:
            held[e.form] = held.get(e.form, 0) + len(text)
    total = sum(len(text) for text, _ in found) if held else 0
    for form, n in held.items():
        form.marked = form.marked and 2 * n <= total
    dropped: dict[int, bool] = {}

    def drops(e: _Element | None) -> bool:
        todo = []
        while e is not None and id(e) not in dropped:
            todo.append(e)
            e = e.parent
        on = e is not None and dropped[id(e)]
        for x in reversed(todo):
            on = dropped[id(x)] = on or x.marked
        return on

    return [Block(text, e.path if e else "", drops(e), e.main if e else -1) for text, e in found]


def containers(path: str) -> str:
    """A path up to its first element of content."""
    at = 0
    while at < len(path):
        end = path.index(END, at)
        if path[at:end].partition(".")[0] in CONTENT:
            break
        at = end + 1
    return path[:at]


def region(found: dict[tuple[str, ...], int]) -> tuple[str, ...]:
    """The innermost element that holds nearly all slot text. found: characters of slot text by path."""
    total = sum(found.values())
    best: tuple[str, ...] = ()
    while True:
        nexts: dict[tuple[str, ...], int] = {}
        for path, n in found.items():
            if path[: len(best)] == best and len(path) > len(best):
                nexts[path[: len(best) + 1]] = nexts.get(path[: len(best) + 1], 0) + n
        if not nexts:
            return best
        top = max(nexts, key=lambda k: (nexts[k], k))
        if nexts[top] < 0.8 * total or top[-1].partition(".")[0] in CONTENT:
            return best
        best = top


def extract(page: str | None) -> str:
    """A page's main text by itself: blocks of the element that HTML marks as main, else of the body."""
    kept = [b for b in blocks(tokens(page)) if not b.drop]
    best = min((b.main for b in kept if b.main >= 0), default=-1)
    return "\n".join(b.text for b in kept if b.main == best or best < 0)


def parsed(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, host) with their layout and blocks in place of html; a block's main says in which of MAIN it is."""

    def rows(x):
        made, layouts = [], []
        for page in x["html"]:
            kept = [b for b in blocks(tokens(page)) if not b.drop]
            layouts.append(zlib.crc32("\n".join(sorted({containers(b.path) for b in kept})).encode()))
            made.append([{"path": b.path, "text": b.text, "main": b.main} for b in kept])
        return {"page_id": x["page_id"], "url": x["url"], "host": x["host"], "page": x["page"], "layout": layouts, "blocks": made}

    keyed = pages.withColumn("page", F.xxhash64("html"))
    return map_batches(keyed, rows, f"page_id {dict(pages.dtypes)['page_id']}, url string, host string, page long, layout long, blocks array<struct<path:string,text:string,main:int>>").withColumn("place", F.xxhash64("host", "layout"))


def stream(parts: list[tuple[int, bool, bool]]) -> list[Item]:
    """A page's items, from (key, const, inside) of its blocks: consecutive equal turns of slots are one repeated group."""
    made, i = [], 0
    while i < len(parts):
        size, turns = 1, 1
        if not parts[i][1]:
            for n in range(1, TURN + 1):
                turn, k = parts[i : i + n], 1
                if len(turn) < n or turn[-1][1]:
                    break
                while parts[i + k * n : i + (k + 1) * n] == turn:
                    k += 1
                if k > 1:
                    size, turns = n, k
                    break
        turn = parts[i : i + size]
        made.append(Item(tuple(p[0] for p in turn), parts[i][1], any(p[2] for p in turn), turns > 1, False))
        i += size * turns
    return made


def _folded(items: list[Item], turns: set[tuple[int, ...]]) -> list[Item]:
    """Items with single slots that are a turn of a group elsewhere as one turn of it, and its repeats joined."""
    made, i = [], 0
    longest = max(map(len, turns), default=0)
    while i < len(items):
        x = items[i]
        run = []
        for r in items[i : i + longest]:
            if len(r.ids) > 1 or r.const or r.many or r.optional:
                break
            run.append(r)
        found = None
        for n in range(len(run), 1, -1):
            t = tuple(r.ids[0] for r in run[:n])
            if t in turns:
                found = Item(t, False, any(r.inside for r in run[:n]), False, False)
                break
        x, i = found or x, i + (len(found.ids) if found else 1)
        if made and not x.const and made[-1].ids == x.ids and not made[-1].const:
            made[-1] = made[-1]._replace(many=True, optional=made[-1].optional and x.optional)
        else:
            made.append(x)
    return made


def _heaviest(x: list, y: list, weights: list[int]) -> list[tuple[int, int]]:
    """Places of a heaviest common subsequence of x and y.

    A table of the weight of what follows has a row for each item of x and a column for each of y, of those that the other
    list has too. About CELLS of it are held at once: of a larger one rows at even distances, from which the rows between
    are made again on the way. So memory grows with the lists and not with their product, and CELLS changes no place.
    """
    both = set(x) & set(y)
    rows = [i for i, k in enumerate(x) if k in both]
    column, where = [0], {}  # type: list[int], dict[object, list[int]]
    for k in y:
        if k in both:
            where.setdefault(k, []).append(column[-1])
        column.append(column[-1] + (k in both))
    at = {k: np.array(v) for k, v in where.items()}
    width = column[-1]
    found: list[tuple[int, int]] = []

    def above(under: np.ndarray, r: int) -> np.ndarray:
        row, match = under.copy(), at[x[rows[r]]]
        row[match] = np.maximum(row[match], under[match + 1] + weights[rows[r]])
        return np.maximum.accumulate(row[::-1])[::-1]

    def walk(low: int, high: int, last: np.ndarray, j: int) -> int:
        """Goes from place j of y through rows low to high, of which last is the one at high; the place then."""
        step = -(-(high - low) // max(2, CELLS // (width + 1)))
        held = {high: last}
        for r in range(high - 1, low - 1, -1):
            last = above(last, r)
            if (r - low) % step == 0:
                held[r] = last
        for r in range(low, high, step):
            top, under = held.pop(r), held[min(r + step, high)]
            if step > 1:
                j = walk(r, min(r + step, high), under, j)
                continue
            i = rows[r]
            while j < len(y):
                c = column[j]
                if x[i] == y[j] and top[c] == under[c + 1] + weights[i]:
                    found.append((i, j))
                    j += 1
                    break
                if top[c] == under[c]:
                    break
                j += 1
        return j

    if rows:
        walk(0, len(rows), np.zeros(width + 1, np.int64), 0)
    return found


def _matches(a: list, b: list, weights: list[int]) -> list[tuple[int, int]]:
    """Places of a heaviest common subsequence in which equal beginnings and ends stand in their places."""
    start, ends = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while ends < min(len(a), len(b)) - start and a[-1 - ends] == b[-1 - ends]:
        ends += 1
    edges = [(i, i) for i in range(start)], [(len(a) - k, len(b) - k) for k in range(ends, 0, -1)]
    found = _heaviest(a[start : len(a) - ends], b[start : len(b) - ends], weights[start : len(a) - ends])
    return edges[0] + [(start + i, start + j) for i, j in found] + edges[1]


def aligned(a: list[Item], b: list[Item]) -> tuple[list[Item], list[int]]:
    """What a and b have in common in their order, and between that what only one has, as optional; and where each constant of b is in it.

    As an expression, it matches all that a or b matches.
    """
    turns = lambda of: {x.ids for x in of if not x.const and (x.many or len(x.ids) > 1)}
    both = turns(a) | turns(b)
    a, b = _folded(a, both), _folded(b, both)
    pairs = _matches([(x.const, x.ids) for x in a], [(x.const, x.ids) for x in b], [3 if x.const else 1 for x in a])
    made: list[Item] = []
    place, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        made += [x._replace(optional=True) for x in a[i:p]]
        place += [len(made) + k for k, x in enumerate(b[j:q]) if x.const]
        made += [x._replace(optional=True) for x in b[j:q]]
        if p < len(a):
            place += [len(made)] if b[q].const else []
            made.append(a[p]._replace(many=a[p].many or b[q].many, optional=a[p].optional or b[q].optional))
        i, j = p + 1, q + 1
    return made, place


def inferred(streams: list[list[Item]], most: float | None = None) -> list[Item]:
    """The wrapper of streams or wrappers, aligned one after the other; nothing if it has more than most items (ITEMS where it isn't given)."""
    made = streams[0]
    for s in streams[1:]:
        made = aligned(made, s)[0] if made and s else []
        if len(made) > (ITEMS if most is None else most):
            return []
    return made


def between_slots(wrapper: list[Item], page: list[Item]) -> list[bool]:
    """Of each of the page's constants, in order, whether it stands between the region's first and last slot in the wrapper."""
    if not any(x.const and x.inside for x in page):
        return [False] * sum(x.const for x in page)
    whole, places = aligned(wrapper, page)
    slots = [i for i, x in enumerate(whole) if x.inside and not x.const]
    return [bool(slots) and slots[0] < i < slots[-1] for i in places]


def expression(wrapper: list[Item], name: Callable[[int], str] = str) -> str:
    """A wrapper as a regular expression over the names of its keys."""
    return "".join(f"(?:{''.join(map(name, x.ids))})" + {(False, False): "", (True, False): "+", (False, True): "?", (True, True): "*"}[x.many, x.optional] for x in wrapper)


ITEM = "array<struct<ids:array<long>,const:boolean,inside:boolean,many:boolean,optional:boolean>>"


def _rows(items: list[Item]) -> list[dict]:
    return [{**x._asdict(), "ids": list(x.ids)} for x in items]


def _items(rows: list[dict]) -> list[Item]:
    return [Item(tuple(x["ids"]), x["const"], x["inside"], x["many"], x["optional"]) for x in rows]


def regions(pages: DataFrame) -> DataFrame:
    """place, n_pages, constants (keys of path and text), region and copies of each layout that has two different pages or more.

    pages are parsed(). Each different page of a layout counts once. A text is constant if all pages that have its path
    have it, and these are half of the layout's or more. All is counted by aggregation; nothing of a host is gathered but
    its constants, of which there are at most twice as many as blocks of a page, and its paths. copies: see COPIES.
    """
    c = F.col
    each = pages.select("place", "page", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text"), F.lit(-1).alias("main"))), F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["text"].alias("text"), b["main"].alias("main"))))).alias("b"))
    texts = each.select("place", "page", "b.path", (c("b.main") >= 0).alias("main"), F.xxhash64("b.path", "b.text").alias("key"), F.length("b.text").alias("chars"))
    counts = cut(texts.distinct().groupBy("place", "path", "main", "key", "chars").agg(F.count(F.lit(1)).alias("n")), "texts")
    paths = cut(each.select("place", "page", "b.path").distinct().groupBy("place", "path").agg(F.count(F.lit(1)).alias("n_path")), "paths")
    whole = paths.filter("path is null").select("place", c("n_path").alias("n_pages")).filter("n_pages >= 2")
    few = paths.count() <= BROADCAST_BYTES // 200
    near = lambda df: F.broadcast(df) if few else df
    held = near(cut(paths.filter("path is not null").join(whole, "place"), "held"))
    constant = cut(counts.filter("path is not null and n >= 2").join(held, ["place", "path"]).filter("n = n_path and 2 * n >= n_pages"), "constants")
    size = lambda df, name: df.groupBy("place", "path", "main").agg(F.sum(c("n") * c("chars")).alias(name))
    slots = size(counts.filter("path is not null"), "all").join(size(constant, "fixed"), ["place", "path", "main"], "left").select("place", "path", "main", "all", (c("all") - F.coalesce("fixed", F.lit(0))).alias("slot"))
    when = lambda name, on: F.coalesce(F.sum(F.when(on, c(name))), F.lit(0))
    slots = slots.groupBy("place").agg(F.collect_list(F.struct("path", "slot")).alias("slots"), when("all", c("main")).alias("m_all"), when("slot", c("main")).alias("m_slot"), F.sum("all").alias("a_all"), F.sum("slot").alias("a_slot"))
    copies = F.when(c("m_all") > 0, c("m_slot") < COPIES["marked"] * c("m_all")).otherwise(c("a_slot") < COPIES["all"] * c("a_all"))
    found = whole.join(slots.withColumn("copies", copies), "place").join(constant.groupBy("place").agg(F.collect_list("key").alias("constants")), "place", "left")

    def rows(x):
        places = [region({tuple(s["path"].split(END)[:-1]): s["slot"] for s in group if s["slot"]}) for group in x["slots"]]
        return {k: x[k] for k in ("place", "n_pages", "constants", "copies")} | {"region": ["".join(k + END for k in p) for p in places]}

    return map_batches(found.select("place", "n_pages", F.coalesce("constants", F.array().cast("array<long>")).alias("constants"), "slots", "copies"), rows, "place long, n_pages long, constants array<long>, region string, copies boolean")


def wrappers(streams: DataFrame) -> DataFrame:
    """place and wrapper of each layout. streams: place and stream of its pages, equal ones as often as they come.

    Each round aligns about AT_ONCE streams or wrappers of a layout, told apart by a hash, so no task has many of a hot host.
    A wrapper has as many items as its streams need.
    """
    now = cut(streams.select("place", F.col("stream").alias("wrapper")).distinct(), "streams")

    def rows(x):
        return {"place": x["place"], "wrapper": [_rows(inferred([_items(s.as_py()) for s in group.values], math.inf)) for group in x["group"]]}

    while True:
        sizes = cut(now.groupBy("place").agg(F.count(F.lit(1)).alias("n")), "sizes")
        if is_empty(sizes.filter("n > 1")):
            return now
        buckets = F.when(F.col("n") <= 2 * AT_ONCE, 1).otherwise(F.ceil(F.col("n") / AT_ONCE))
        dealt = now.join(sizes, "place").withColumn("bucket", F.pmod(F.xxhash64("wrapper"), buckets))
        grouped = dealt.groupBy("place", "bucket").agg(F.array_sort(F.collect_list("wrapper")).alias("group"))
        now = cut(map_batches(grouped.select("place", "group"), rows, f"place long, wrapper {ITEM}", ("group",)), "wrappers")


def _streamed(placed: DataFrame) -> DataFrame:
    """Adds stream to parsed pages that have constants and region."""
    parts = F.expr("transform(blocks, b -> struct(if(array_contains(constants, xxhash64(b.path, b.text)), xxhash64(b.path, b.text), xxhash64(b.path)) as key, array_contains(constants, xxhash64(b.path, b.text)) as const, startswith(b.path, region) as inside))")
    kinds = dict(placed.dtypes)

    def rows(x):
        made = [_rows(stream([(p["key"], p["const"], p["inside"]) for p in each])) for each in x["parts"]]
        return {k: v for k, v in x.items() if k != "parts"} | {"stream": made}

    return map_batches(placed.withColumn("parts", parts), rows, ", ".join(f"{k} {v}" for k, v in kinds.items()) + f", stream {ITEM}")


def decided(pages: DataFrame) -> DataFrame:
    """As main_text, with by: wrapper, tag or body, whichever decided the page. pages: page_id, url, html, host."""
    whole = cut(parsed(pages), "parsed")
    found = cut(regions(whole), "regions")
    size = found.agg(F.coalesce(F.sum(F.size("constants") * 8 + F.octet_length("region") + 32), F.lit(0))).first()[0]
    near = lambda df, n: F.broadcast(df) if n <= BROADCAST_BYTES else df
    forms = whole.select("place", "blocks").join(near(found.filter("not copies"), size), "place")
    form = wrappers(_streamed(forms.select("place", "blocks", "constants", "region")).select("place", "stream"))
    form = form.filter("size(wrapper) > 0")
    items = form.agg(F.coalesce(F.sum(F.size("wrapper") * 48), F.lit(0))).first()[0]
    placed = whole.join(near(found, size), "place", "left").join(near(form, items), "place", "left")

    def rows(x):
        out = {"page_id": x["page_id"], "url": x["url"], "text": [], "by": []}
        known: dict[int, list[Item]] = {}
        for place, blocks_, constants, region_, wrapper in zip(x["place"], x["blocks"], x["constants"], x["region"], x["wrapper"], strict=True):
            best = min((b["main"] for b in blocks_ if b["main"] >= 0), default=-1)
            kept, by = None, "wrapper"
            if wrapper.is_valid:
                if place not in known:
                    known[place] = _items(wrapper.as_py())
                form_ = known[place]
                fixed = set(constants)
                keys = [b["key"] for b in blocks_]
                inside = [b["path"].startswith(region_) for b in blocks_]
                page = stream([(k if k in fixed else b["place"], k in fixed, i) for b, k, i in zip(blocks_, keys, inside, strict=True)])
                stay = iter(between_slots(form_, page))
                kept = [b["text"] for b, k, i in zip(blocks_, keys, inside, strict=True) if (k not in fixed or next(stay)) and i]
                if not any(i and k not in fixed for k, i in zip(keys, inside, strict=True)):
                    kept = None
            if kept is None:
                kept, by = [b["text"] for b in blocks_ if b["main"] == best or best < 0], "tag" if best >= 0 else "body"
            out["text"].append("\n".join(kept))
            out["by"].append(by)
        return out

    keyed = placed.withColumn("blocks", F.expr("transform(blocks, b -> struct(b.path as path, b.text as text, b.main as main, xxhash64(b.path, b.text) as key, xxhash64(b.path) as place))"))
    got = map_batches(keyed.select("page_id", "url", "place", "blocks", "constants", "region", "wrapper"), rows, f"page_id {dict(whole.dtypes)['page_id']}, url string, text string, by string", ("wrapper",))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by")


def _plain(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = column(pages, url_col)
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return pages.select(column(pages, id_col).alias("page_id"), url.alias("url"), F.coalesce(column(pages, html_col), F.lit("")).alias("html"), host.alias("host"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of pages: page_id, url, text, n_chars (long).

    A null html is an empty page, whose text is empty. A null url, or one without a host, has the empty host, whose pages
    share wrappers. Repeated rows give repeated results; an empty table gives an empty one; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    return decided(_plain(pages, id_col, url_col, html_col)).drop("by")
