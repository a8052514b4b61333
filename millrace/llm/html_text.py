"""Main text of web pages: structure, then a suffix array per host.

A page is read into blocks of text.  Blocks inside scripts, menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are known not to
belong to the text; blocks inside an explicit article (or main) element are
known to belong.  What lies outside both is *open*; a page that has more than
``TEASER`` times as much open text as text of articles is open throughout.

*Host suffix array.*  The token streams of a host's pages, without what an
article element protects, are concatenated; the array of their suffixes, sorted
to ``RUN`` tokens by prefix doubling, puts equal runs side by side.  A run that
stands on enough distinct pages is boilerplate, and every token that such a run
covers is marked.  An open block that is covered is dropped, the others are kept
as the page's unique runs.

*Large hosts.*  A host of more than ``SLICE_CHARS`` doesn't meet in one task.  Its
runs, as 64-bit hashes, are counted over all its pages instead; those on enough
pages go to the slices of pages without an article that hold them, and cover
the same tokens there as the array of the whole host would.

Edge cases: null or empty html, and pages without main text, give the empty
text; repeated rows give repeated results; null urls form one host; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import materialize, ship
from .bpe import slices
from .words import gram_hashes, word_hashes

#: Tokens in a run that counts as repeated, and distinct pages that it must stand on.
RUN, PAGES = 8, 3
#: An open block goes when at least this share of its tokens is covered.
COVERED = 0.7
#: Characters of html that one slice of a host holds, about; a host of no more has an array of its own.
SLICE_CHARS = 2 << 20

#: Elements by what they mean.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = RAW | {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "template", "svg", "math", "canvas", "object", "button", "select", "datalist", "audio", "video", "map"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: Words of a class or id that name something beside the text.
BESIDE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr",
    "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets",
}
#: Those of them that no article or main element below them redeems, and that an article itself may bear.
NEVER = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "commentlist", "disqus", "promo", "promoted", "related", "replies", "respond", "sponsor", "sponsored",
}
#: Words that beside such a word name the same thing; a class or id with any other word names something else.
HOLDERS = {
    "area", "article", "bar", "block", "blog", "bottom", "box", "btn", "button", "buttons", "container", "desktop", "form", "global", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "main", "media", "mobile",
    "module", "outer", "page", "panel", "post", "posts", "primary", "reader", "right", "secondary", "section", "site", "slot", "sticky", "sub", "top", "unit", "user", "wrap", "wrapper",
}
#: Words that, first in a name or behind words that only say where or whose, tell what the whole name is of, whatever follows.
TELLING = {"comment", "comments", "commentlist", "disqus", "newsletter", "signup", "subscribe"}
#: Words that may stand before them besides ``HOLDERS``, and words behind the last three that name a text instead.
BEFORE, TEXTS = {"fb", "js", "the", "wp"}, {"article", "body", "content", "issue", "post", "posts", "text"}
#: Words beside "cookie" or "cookies" that name a notice; alone these may name a dish.
NOTICES = {"accept", "alert", "banner", "bar", "consent", "disclaimer", "gdpr", "info", "law", "message", "modal", "notice", "overlay", "policy", "popup", "settings", "warning"}
#: An article of which a page has so many times as much other text is a teaser.
TEASER = 2
#: Opening one of the keys ends an open one of the values, looked for up to the nearest of the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = {"article", "main", "section", "div", "td", "th", "table", "li", "body", "html", "blockquote", "nav", "aside", "header", "footer", "form", "button", "figure"}

#: What ends a tag's name, and what a tag's end is looked for among.
#: A tag without another one's begin in it, which nearly all are; it reads no further than that.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?>[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_NAME_END, _QUOTE_OR_END = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[a-z]+")

DROPPED, OPEN, MAIN = 0, 1, 2


class _Element:
    __slots__ = ("beside", "gone", "holds", "inside", "name", "parent")

    def __init__(self, name: str, parent: _Element | None, beside: int, inside: bool):
        self.name, self.parent, self.beside, self.inside, self.holds = name, parent, beside, inside, False
        self.gone = [None, None]


def _named(names: str, inside: bool) -> int:
    """2 or 1 if one name of a class or id says throughout that it is beside the text; inside an article a header may hold its title."""
    out = 0
    for order in map(_NAME_WORD.findall, names.split()):
        words = set(order)
        found = BESIDE & words
        told = next((w for w in order if w not in HOLDERS and w not in BEFORE), "")
        if told in TELLING and (told in NEVER or TEXTS.isdisjoint(words)) or not words.isdisjoint(("cookie", "cookies")) and not words.isdisjoint(NOTICES):
            out = max(out, 2 if told in NEVER else 1)
        elif found and found | HOLDERS >= words and not (inside and found == {"header"}):
            out = max(out, 1 if NEVER.isdisjoint(found) else 2)
    return out


def _beside(name: str, rest: str, inside: bool) -> int:
    """2 if the element is never main text, 1 if its names say so unless it holds an article, 0 otherwise; ``inside`` an article with more care."""
    if name in DROP:
        return 2
    if name in ("html", "body") or "=" not in rest and "hidden" not in rest:
        return 0
    out, main = 0, name in ("article", "main")
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
        if key == "role" and value in ROLES and not main:
            out = max(out, 1)
        elif key in ("class", "id") and not (inside and (name in HEADINGS or name == "p" and key == "id")):  # such names follow the text
            level = _named(value, inside)
            out = max(out, level if not main or level == 2 else 0)
    return out


def _gone(element: _Element) -> bool:
    """Whether the element or one around it is beside the text, except the headings in an article's own header.

    Told once for an element and whether there is a heading below it, so that deep pages take linear time.
    """
    path, own, heading = [], element, False
    while own.parent:
        heading = heading or own.name in HEADINGS
        if own.gone[heading] is not None:
            break
        path.append((own, heading))
        own = own.parent
    verdict = bool(own.parent and own.gone[heading])
    for own, heading in reversed(path):
        if not (own.name == "header" and heading and own.inside):
            verdict = verdict or own.beside == 2 or own.beside == 1 and not own.holds
        own.gone[heading] = verdict
    return verdict


class _Tags:
    """The tags of a page in order, in time linear in its length whatever is left open.

    A tag ends at the first ``>`` outside quotes; where there is none, its ``<`` is text.  Whatever a search
    finds is remembered, and so is every quote from which no end is reached, so that no part is read again
    for each of many open tags.
    """

    def __init__(self, page: str):
        self.page = page
        self.known: dict[re.Pattern, tuple[int, int]] = {}
        self.endless: set[int] = set()
        self.last = page.rfind(">")

    def _next(self, pattern: re.Pattern, at: int) -> int:
        first, found = self.known.get(pattern, (0, -1))
        if not first <= at <= found:
            m = pattern.search(self.page, at)
            first, found = self.known[pattern] = at, m.start() if m else len(self.page)
        return found

    def _end(self, at: int) -> int:
        """The ``>`` that ends the tag whose attributes begin at ``at``, or -1."""
        page, quotes = self.page, []
        while True:
            at = self._next(_QUOTE_OR_END, at)
            if at == len(page) or at in self.endless:
                break
            if page[at] == ">":
                return at
            quotes.append(at)
            at = page.find(page[at], at + 1) + 1
            if not at:
                break
        self.endless.update(quotes)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Begin, end, whether it closes, name and attributes of the first tag from ``at`` on; comments and declarations have no name."""
        page = self.page
        while True:
            at = page.find("<", at)
            if at < 0:
                return None
            plain = _PLAIN.match(page, at)
            if plain:
                return at, plain.end(), bool(plain[1]), plain[2], plain[3]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), False, "", ""
            if at > self.last:  # no tag ends from here on, but a comment may begin
                at = page.find("<!--", at)
                if at < 0:
                    return None
                continue
            close = page.startswith("/", at + 1)
            begin = at + 1 + close
            if "a" <= page[begin : begin + 1].lower() <= "z":
                stop = self._next(_NAME_END, begin)
                end = self._end(stop)
                if end >= 0:
                    return at, end + 1, close, page[begin:stop], page[stop:end]
                if close:
                    return at, page.find(">", at) + 1, close, "", ""
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                return at, page.find(">", at) + 1, close, "", ""
            at += 1


def blocks(page: str | None) -> list[tuple[int, str]]:
    """The page's blocks of text in order, each with DROPPED, OPEN or MAIN."""
    if not page:
        return []
    root = _Element("", None, 0, False)
    here, parts, out = root, [], []
    found: list[tuple[_Element, str]] = []
    stands: Counter[str] = Counter()  # open elements by name

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append((here, text))
            parts.clear()

    def pop_to(element: _Element) -> None:
        nonlocal here
        while True:
            stands[here.name] -= 1
            here, last = here.parent, here
            if last is element:
                return

    at, raw, tags = 0, None, _Tags(page)
    size = len(page)
    while at < size:
        if raw:
            end = re.compile(rf"</{re.escape(raw)}[\s/>]", re.I).search(page, at)
            at, raw = end.start() if end else size, None
            continue
        tag = tags.next(at)
        if not tag:
            parts.append(page[at:])
            break
        begin, end, close, name, rest = tag
        if begin > at:
            parts.append(page[at:begin])
        at = end
        if not name:
            continue
        name = name.lower()
        if close:
            if name == "br":
                parts.append(" ")
                continue
            if name in BLOCK or name in DROP:
                flush()
            if not stands[name]:
                continue
            e = here
            while e.parent and e.name != name:
                if name not in BLOCK and name not in DROP and e.name in _SCOPE:
                    e = root
                    break
                e = e.parent
            if e.parent:
                pop_to(e)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK or name in DROP:
            flush()
        if name in VOID:
            continue
        if name in BLOCK and stands["p"]:  # a block ends an open paragraph
            e = here
            while e.parent and e.name not in _SCOPE and e.name != "p":
                e = e.parent
            if e.name == "p":
                pop_to(e)
        if name in ENDS:
            ended, bounds = ENDS[name]
            e, last = here, None
            while e.parent and e.name not in bounds:
                if e.name in ended:
                    last = e
                e = e.parent
            if last:
                pop_to(last)
        if rest.endswith("/") and name in ("svg", "math", "path"):
            continue
        beside = _beside(name, rest, here.inside)
        here = _Element(name, here, beside, here.inside or name in ("article", "main"))
        stands[name] += 1
        if name in ("article", "main") and beside < 2:
            e = here.parent
            while e and not e.holds:
                e.holds = True
                e = e.parent
        if name in RAW:
            raw = name
    flush()
    out = [(DROPPED if _gone(e) else MAIN if e.inside else OPEN, text) for e, text in found]
    length = lambda state: sum(len(text) for own, text in out if own == state)
    main = length(MAIN)
    if main and length(OPEN) <= TEASER * main:
        out = [(DROPPED if state == OPEN else state, text) for state, text in out]
    elif main:  # an article that is a small part of the page is no more than its other text
        out = [(OPEN if state == MAIN else state, text) for state, text in out]
    return out


def repeated_runs(tokens: np.ndarray, page: np.ndarray, run: int = RUN, pages: int = PAGES) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that stands on at least ``pages`` distinct pages.

    ``page`` is the page of each token, ascending.  Suffixes are sorted to ``run`` tokens by prefix
    doubling; ranks then name equal runs, which are neighbours in the array.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(n, bool)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    have = 1
    while have < run:
        step = min(have, run - have)
        beyond = np.zeros(n, np.int64)
        beyond[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + beyond, return_inverse=True)[1].astype(np.int64) + 1
        have += step
    starts = np.flatnonzero(page[: n - run + 1] == page[run - 1 :])  # a run doesn't cross pages
    order = starts[np.lexsort((page[starts], rank[starts]))]  # the suffix array
    new_run = np.concatenate(([True], rank[order][1:] != rank[order][:-1])) if len(order) else np.zeros(0, bool)
    new_page = new_run | np.concatenate(([True], page[order][1:] != page[order][:-1])) if len(order) else new_run
    group = np.cumsum(new_run) - 1
    on = np.bincount(group, new_page) if len(order) else np.zeros(0)
    hit = order[on[group] >= pages] if len(order) else order
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + run, -1)
    return np.cumsum(edge[:n]) > 0


def _hashed_runs(pages: list[list[tuple[int, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hash, page and first token of every run that doesn't cross pages, and the number of tokens."""
    words, page, _, _ = word_hashes(pa.array([" ".join(t for _, t in own) for own in pages], pa.string()))
    grams = gram_hashes(words, RUN)
    starts = np.flatnonzero(page[: len(grams)] == page[RUN - 1 :]) if len(grams) else np.zeros(0, np.int64)
    return grams[starts], page[starts], starts, len(words)


def _counted_runs(pages: list[list[tuple[int, str]]], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, hash and number of pages of each distinct run of a group of pages; ``groups`` has each page's."""
    run, page, _, _ = _hashed_runs(pages)
    order = np.lexsort((page, run, groups[page]))
    run, page, group = run[order], page[order], groups[page][order]
    if not len(run):
        return group, run, np.zeros(0, np.int64)
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (run[1:] != run[:-1])))
    new_page = new | np.concatenate(([True], page[1:] != page[:-1]))
    return group[new], run[new], np.add.reduceat(new_page.astype(np.int64), np.flatnonzero(new))


def _covered_by(pages: list[list[tuple[int, str]]], repeated: np.ndarray) -> np.ndarray:
    """Which tokens lie in a run whose hash is one of ``repeated``."""
    run, _, starts, n = _hashed_runs(pages)
    hit = starts[np.isin(run, repeated)]
    edge = np.zeros(n + RUN + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + RUN, -1)
    return np.cumsum(edge[:n]) > 0


def _unique_blocks(pages: list[list[tuple[int, str]]], repeated: np.ndarray | None = None) -> list[list[str]]:
    """Per page the open blocks that no repeated run covers, judged among the pages of one host or by its ``repeated`` runs."""
    ids: dict[str, int] = {}
    tokens, owner, spans, size = [], [], [], 0
    for number, own in enumerate(pages):
        for k, (_, text) in enumerate(own):
            words = text.split()
            spans.append((number, k, size, size + len(words)))
            size += len(words)
            if repeated is None:
                tokens += [ids.setdefault(w, len(ids)) for w in words]
                owner += [number] * len(words)
    covered = repeated_runs(np.array(tokens, np.int64), np.array(owner, np.int64)) if repeated is None else _covered_by(pages, repeated)
    total = np.concatenate(([0], np.cumsum(covered)))
    gone = {(number, k) for number, k, a, b in spans if b > a and total[b] - total[a] >= COVERED * (b - a)}
    return [[text for k, (state, text) in enumerate(own) if state == OPEN and (number, k) not in gone] for number, own in enumerate(pages)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page.

    The text of pages with an article never leaves its task.  Only the token streams outside articles
    (and whole pages without one) are dealt out by host, at the price of a second reading.
    """
    ship(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    types = dict(rows.dtypes)
    kind = pa.struct([("state", pa.int8()), ("text", pa.string())])

    def told(at: pa.Array, url: pa.Array, texts: list[str]) -> list[pa.Array]:
        return [at, url, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))]

    def articles(batches):
        for batch in slices(batches, "html"):
            own = [[t for s, t in blocks(h) if s == MAIN] for h in batch.column("html").to_pylist()]
            batch = batch.filter(pa.array(list(map(bool, own)), pa.bool_()))
            yield pa.RecordBatch.from_arrays(told(batch.column("id"), batch.column("url"), ["\n\n".join(o) for o in own if o]), ["id", "url", "text", "n_chars"])

    def streams(batches):
        for batch in slices(batches, "html"):
            own = [blocks(h) for h in batch.column("html").to_pylist()]
            whole = pa.array([all(s != MAIN for s, _ in o) for o in own], pa.bool_())
            outside = [[{"state": s, "text": t} for s, t in o if s != MAIN] for o in own]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "url", "host", "part")), whole, pa.array(outside, pa.list_(kind))], ["id", "url", "host", "part", "whole", "blocks"])

    def runs(batches):
        """Runs by host and, as only pages without an article are judged, by those pages' slices."""
        for batch in slices(batches, "html"):
            own = [blocks(h) for h in batch.column("html").to_pylist()]
            named: dict[tuple, int] = {}
            told = zip(batch.column("host").to_pylist(), batch.column("part").to_pylist(), own, strict=True)
            groups = np.array([named.setdefault((h, p if all(s != MAIN for s, _ in o) else None), len(named)) for h, p, o in told], np.int64)
            group, run, n = _counted_runs([[b for b in o if b[0] != MAIN] for o in own], groups)
            hosts, parts = pa.array([h for h, _ in named], pa.string()), pa.array([p for _, p in named], pa.int64())
            yield pa.RecordBatch.from_arrays([hosts.take(pa.array(group)), parts.take(pa.array(group)), pa.array(run.astype(np.int64)), pa.array(n)], ["host", "part", "run", "n"])

    def judged(table: pa.Table, repeated: np.ndarray | None) -> pa.Table:
        own = [[(b["state"], b["text"]) for b in bs] for bs in table.column("blocks").to_pylist()]
        whole = table.column("whole").to_pylist()
        texts = ["\n\n".join(kept) for kept, w in zip(_unique_blocks(own, repeated), whole, strict=True) if w]
        table = table.filter(table.column("whole"))
        return pa.table(told(table.column("id"), table.column("url"), texts), ["id", "url", "text", "n_chars"])

    def judge_host(table: pa.Table) -> pa.Table:
        return judged(table, None)

    def judge_slice(table: pa.Table, repeated: pa.Table) -> pa.Table:
        return judged(table, repeated.column("run").to_numpy().astype(np.uint64))

    schema = f"id {types['id']}, url {types['url']}, text string, n_chars long"
    parsed = f"id {types['id']}, url {types['url']}, host string, part long, whole boolean, blocks array<struct<state: tinyint, text: string>>"
    sizes = pages.select(host.alias("host"), F.length(html_col).alias("n")).groupBy("host").agg(F.ceil(F.sum(F.coalesce("n", F.lit(0))) / SLICE_CHARS).alias("slices"))
    large = F.broadcast(materialize(sizes.where("slices > 1"), "large-hosts"))  # at most one for every SLICE_CHARS of input
    small = rows.join(large, "host", "left_anti").withColumn("part", F.lit(0).cast("long"))
    unique = small.mapInArrow(streams, parsed).groupBy("host").applyInArrow(judge_host, schema)
    if not large.isEmpty():
        dealt = rows.join(large, "host").withColumn("part", F.pmod(F.xxhash64("id", "url"), F.col("slices"))).drop("slices")
        repeated = dealt.mapInArrow(runs, "host string, part long, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("n"), F.collect_set("part").alias("parts"))
        repeated = repeated.where(F.col("n") >= PAGES).select("host", "run", F.explode("parts").alias("part"))
        by_slice = dealt.mapInArrow(streams, parsed).where("whole").groupBy("host", "part").cogroup(repeated.groupBy("host", "part")).applyInArrow(judge_slice, schema)
        unique = unique.unionByName(by_slice)
    out = rows.select("id", "url", "html").mapInArrow(articles, schema).unionByName(unique)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
