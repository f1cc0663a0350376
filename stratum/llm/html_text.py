"""Main-text extraction from HTML by tree scoring.

A page is read once into a tree of block elements (inline tags make no node). Text in
scripts, styles, menus, page headers, footers, sidebars, notices, adverts, form controls and
reader comments is marked as left out, by element, role, visibility, or a class or id that
names nothing else (``related-posts``, not ``related-work`` or ``has-sidebar``). In an
``article`` or ``main`` ids are mostly anchors and words often code, so there only the classes of
containers count, ids of containers that name comments, adverts or related pages, whole classes
of paragraphs but headings, and of inline elements those that name adverts. A name leaves out no
element that holds the page's largest ``article`` or ``main``, or, unless one stands elsewhere,
most of the page's text; comments, adverts and related pages go however long they are, if
their article, or else the page, has other text. Every remaining paragraph passes points to its ancestors: 1, plus its commas, plus
its length in hundreds of characters (3 at most), in full to the parent, half to the
grandparent, less to those above. Containers start with points by element and lose the
share of their text that stands in links. The best container is kept; if it stands in an
``article`` or ``main`` whose text (in an ``article``, links aside) is mostly its own, that one
is kept, and so are siblings that score at least a fifth as much, long, link-poor sibling
paragraphs, sections beside a section and unnamed ``div``s of the same class beside a ``div``. Headings right
before the container (or before an element that holds nothing else) are its title, unless it
has one. Lists of nothing but links are menus outside ``article`` and ``main`` only; a table of them is none where
it follows a paragraph.

Character references are decoded, white space (as ``str.split`` sees it) in a block becomes
one space, and the blocks are joined by one space in page order. Nothing is cut or capped.

Pages are independent: no shuffle, and a task holds one Arrow batch.

Defined cases: NULL or empty html, and pages without text outside the parts left out, give
the empty text; broken markup is read as browsers do (a block ends an open paragraph, a
missing end tag ends with its parent, an unfinished tag at the end is dropped); equal rows
give equal rows; columns other than ``page_id, url, html`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratum.llm.common import arrow_map, table
from stratum.llm.textnp import blocks

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z/][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[0-9]+")

RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PARAGRAPHS = {"p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "blockquote", "figcaption", "caption", "summary", "address"}
CONTAINERS = {
    "html", "body", "div", "article", "main", "section", "td", "th", "tr", "table", "tbody", "thead", "tfoot", "ul", "ol", "dl",
    "form", "fieldset", "center", "details", "figure", "hgroup", "header", "nav", "footer", "aside", "menu", "dialog", "search",
    "head", "select", "option", "optgroup", "button", "label", "legend", "datalist", "output", "noscript", "template", "svg",
    "math", "object", "canvas", "audio", "video", "map", "applet", "frameset",
}
BLOCKS = PARAGRAPHS | CONTAINERS
#: Elements whose text is never part of an article.
LEFT_OUT = {
    "head", "nav", "footer", "aside", "menu", "dialog", "search", "select", "option", "optgroup", "button", "label", "legend",
    "datalist", "output", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "map", "applet", "frameset",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
#: Words that name a part left out, in a class or id of such words and ``PARTS`` only.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "sidebar", "rail", "widget", "comment", "comments", "disqus", "replies", "respond", "cookie", "cookies", "consent", "gdpr",
    "notice", "banner", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "share", "sharing", "social", "related",
    "recommended", "toolbar", "skip", "hidden",
}
PARTS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "form", "global", "group", "header", "icon",
    "icons", "inner", "is", "item", "items", "left", "link", "links", "list", "main", "mobile", "outer", "panel", "posts", "primary",
    "post", "reader", "region", "reply", "right", "row", "secondary", "section", "site", "slot", "toggle", "top", "unit", "visually", "user", "wrap", "wrapper",
}
ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion"}
#: Names of parts that are never the article, as long as they may be.
STRICT = ADVERTS | {"comment", "comments", "disqus", "replies", "respond", "related", "recommended"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Whole classes of an ``article`` that is none.
NOT_ARTICLES = {"comment", "comments", "related", "ad", "advert", "advertisement", "promo", "sponsored", "teaser"}
LONG = 80  # characters of a paragraph that is more than a label
START_POINTS = {
    "article": 10, "main": 8, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "body": 0, "ul": -3, "ol": -3,
    "dl": -3, "li": -3, "form": -3, "th": -5,
}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _is_left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    if not attributes.strip() or tag in ("html", "body"):
        return False
    found = _attributes(attributes)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("aria-modal") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    return False


def _is_named(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the class or id names a part left out."""
    if not attributes.strip() or tag in ("html", "body"):
        return False
    block = tag in CONTAINERS
    found = _attributes(attributes)
    tokens = found.get("class", "").split()
    if in_article and not block:
        if tag in HEADINGS:
            return False
        return not (NAMES if tag in PARAGRAPHS else ADVERTS).isdisjoint(x.lower() for x in tokens)
    if tag in ("article", "main"):  # their classes often tell what the page has besides
        return not NOT_ARTICLES.isdisjoint(x.lower() for x in tokens)
    ids = found.get("id", "").split() if block else []
    if in_article:
        return any(_names_part(x) for x in tokens) or any(_names_part(x, STRICT) for x in ids)
    return any(_names_part(x) for x in tokens + ids)


def _is_strict(attributes: str) -> bool:
    found = _attributes(attributes)
    return any(_names_part(x, STRICT) for y in ("class", "id") for x in found.get(y, "").split())


def _names_part(token: str, names: set[str] = NAMES) -> bool:
    words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
    return not names.isdisjoint(words) and all(x in NAMES or x in PARTS or x.isdigit() for x in words)


class _Tree:
    """Block nodes in page order (a parent comes before its children) and pieces of text."""

    def __init__(self) -> None:
        self.tag, self.parent, self.out, self.article = ["html"], [-1], [False], [False]
        self.named, self.real = [False], [False]  # left out by name; an article that no name denies
        self.strict, self.label = [False], [None]  # named, and never the article; class of an element without an id
        self.pieces: list[tuple[int, str, bool]] = []  # node, text, in a link; node -1 is a break
        self.inline_named: dict[int, int] = {}  # piece: number of the inline element left out by name

    def add(self, tag: str, parent: int, out: bool, named: bool, real: bool, attributes: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.out.append(self.out[parent] or out)
        self.named.append(named)
        self.real.append(real)
        self.strict.append(named and _is_strict(attributes))
        found = _attributes(attributes) if attributes.strip() else {}
        self.label.append(None if "id" in found else found.get("class", ""))
        self.article.append(self.article[parent] or tag in ("article", "main"))
        return len(self.tag) - 1


def read_tree(html: str) -> _Tree:
    tree = _Tree()
    stack = [0]
    open_inline_out: list[str] = []  # inline elements that are left out
    open_inline_named: list[str] = []
    links, at, inline = 0, 0, 0

    def text(raw: str) -> None:
        if raw and not open_inline_out and not tree.out[stack[-1]]:
            if open_inline_named:
                tree.inline_named[len(tree.pieces)] = inline
            tree.pieces.append((stack[-1], unescape(raw) if "&" in raw else raw, links > 0))

    while (m := _TAG.search(html, at)) is not None:
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in BLOCKS:
            if tag in ("br", "hr"):
                tree.pieces.append((-1, " ", False))
            elif closing:
                if tag in open_inline_out:
                    del open_inline_out[open_inline_out.index(tag) :]
                if tag in open_inline_named:
                    del open_inline_named[open_inline_named.index(tag) :]
            elif tag not in VOID and (m[3] or m[6] or "").strip():
                if _is_left_out(tag, m[3] or m[6], True):
                    open_inline_out.append(tag)
                elif open_inline_named:
                    if tag == open_inline_named[0]:
                        open_inline_named.append(tag)
                elif tree.tag[stack[-1]] != "pre" and _is_named(tag, m[3] or m[6], tree.article[stack[-1]]):
                    open_inline_named.append(tag)
                    inline += 1
            continue
        tree.pieces.append((-1, " ", False))
        open_inline_out.clear()  # a block ends what was left open
        open_inline_named.clear()
        tags = [tree.tag[n] for n in stack]
        if closing:
            if tag in tags[1:]:
                depth = len(tags) - 1 - tags[::-1].index(tag)
                if tag == "p" or not any(x in ("td", "th") for x in tags[depth + 1 :]) or tag in ("table", "tr", "tbody", "body", "html"):
                    del stack[depth:]
            links = 0 if tag not in PARAGRAPHS else links
            continue
        if tag in ("html", "body") and tag in tags:
            continue
        if "p" in tags:
            depth = len(tags) - 1 - tags[::-1].index("p")
            if not any(x in ("td", "th", "button", "object") for x in tags[depth:]):
                del stack[depth:]
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag)
        if same:
            stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table", "tr") if tag in ("td", "th") else ("table",))
            for depth in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[depth]] in same:
                    del stack[depth:]
                    break
                if tree.tag[stack[depth]] in stop:
                    break
        if tag == "body":
            while tree.tag[stack[-1]] == "head":
                stack.pop()
        if tag in ("article", "main"):  # no menu or page header holds the article
            for depth in range(1, len(stack)):
                if tree.tag[stack[depth]] in ("nav", "head") or (tree.tag[stack[depth]] == "header" and tree.out[stack[depth]]):
                    del stack[depth:]
                    break
        attributes, in_article = m[3] or m[6] or "", tree.article[stack[-1]]
        named, real = _is_named(tag, attributes, in_article), False
        if tag in ("article", "main") and not named:
            found = _attributes(attributes)
            real = not any(_names_part(x, NOT_ARTICLES) for y in ("class", "id") for x in found.get(y, "").split())
        stack.append(tree.add(tag, stack[-1], _is_left_out(tag, attributes, in_article), named, real, attributes))
    text(html[at:])
    return tree


def drop_named(tree: _Tree) -> None:
    """Takes out the text of what a name leaves out, unless it is the article by its place or size."""
    if not tree.inline_named and not any(tree.named):
        return
    n = len(tree.tag)
    size, inline_size = [0] * n, dict.fromkeys(tree.inline_named.values(), 0)
    for at, (node, said, _) in enumerate(tree.pieces):
        if node >= 0:
            long = len(" ".join(said.split()))
            size[node] += long
            if at in tree.inline_named:
                inline_size[tree.inline_named[at]] += long
    for k in range(n - 1, 0, -1):
        size[tree.parent[k]] += size[k]
    in_named, in_one = [False] * n, [False] * n  # in a named element; in an ``article``
    inner, rival = [0] * n, {"article": 0, "main": 0}  # the largest article in each element; those outside named ones
    for k in range(1, n):
        up = tree.parent[k]
        in_named[k] = in_named[up] or tree.named[k]
        in_one[k] = in_one[up] or tree.tag[up] == "article"
        if tree.real[k] and not in_one[k]:
            inner[k] = size[k]
            if not in_named[k]:
                rival[tree.tag[k]] = max(rival[tree.tag[k]], size[k])
    for k in range(n - 1, 0, -1):
        inner[tree.parent[k]] = max(inner[tree.parent[k]], inner[k])
    # text outside the strict names, of the page and of each outermost article
    holder, in_strict, plain = [0] * n, [False] * n, [0] * n
    for k in range(1, n):
        up = tree.parent[k]
        in_strict[k] = in_strict[up] or (tree.strict[k] and not inner[k])
        holder[k] = holder[up] or (k if tree.tag[k] in ("article", "main") and not in_strict[k] else 0)
    for at, (node, said, _) in enumerate(tree.pieces):
        if node >= 0 and not in_strict[node] and at not in tree.inline_named:
            plain[0] += len(said.strip())
            if holder[node]:
                plain[holder[node]] += len(said.strip())
    out = [False] * n
    for k in range(1, n):
        up = tree.parent[k]
        out[k] = out[up]
        if tree.named[k] and not out[up]:
            other = rival["article"] if tree.article[up] else max(rival.values())
            beside = plain[holder[up]] if holder[up] else plain[0] - LONG
            most = size[k] * 2 >= size[0] and (in_one[k] or not other) and not (tree.strict[k] and beside > 0)
            out[k] = not most and inner[k] <= other
    small = {x for x, long in inline_size.items() if long * 2 < size[0]}
    tree.pieces = [
        piece for at, piece in enumerate(tree.pieces) if piece[0] < 0 or not (out[piece[0]] or tree.inline_named.get(at) in small)
    ]


def _titles(tree: _Tree, best: int, total: list[int], keep: set[int]) -> set[int]:
    """Headings right before the container, or before an element that holds nothing else."""
    n = len(tree.tag)
    within = [k == best for k in range(n)]
    for k in range(best + 1, n):
        within[k] = within[tree.parent[k]]
        if within[k] and tree.tag[k] in ("h1", "hgroup") and total[k]:
            return set()
    found: set[int] = set()
    first = best
    while first > 0:
        up = tree.parent[first]
        begin = min([first, *(x for x in keep if tree.parent[x] == up)])
        before = [k for k in range(1, begin) if tree.parent[k] == up]
        for k in reversed(before):
            if tree.tag[k] in HEADINGS and total[k]:
                found.add(k)
            elif total[k] or (tree.tag[up] in ("body", "html") and (tree.out[k] or tree.named[k])):
                return found
        beside = sum(total[k] for k in range(1, n) if tree.parent[k] == up and k not in keep and k not in found)
        if beside - (0 if first in keep else total[first]) or tree.tag[up] in ("body", "html"):
            return found
        first = up
    return found


def main_text(html: str | None) -> str:
    """The text of the page's article; empty if there is none."""
    if not html:
        return ""
    tree = read_tree(html)
    drop_named(tree)
    n = len(tree.tag)
    own, commas, linked, anchors = [0] * n, [0] * n, [0] * n, [0] * n
    for node, said, in_link in tree.pieces:
        if node >= 0:
            size = len(" ".join(said.split()))
            own[node] += size
            commas[node] += said.count(",") + said.count("，") + said.count("、")
            if in_link and size:
                linked[node] += size
                anchors[node] += 1
    total, in_links, count = own[:], linked[:], anchors[:]
    for k in range(n - 1, 0, -1):
        up = tree.parent[k]
        total[up] += total[k]
        in_links[up] += in_links[k]
        count[up] += count[k]
    if not total[0]:
        return ""
    after_text, last = [False] * n, [-1] * n  # the sibling before, in page order, is a paragraph with text
    for k in range(1, n):
        up = tree.parent[k]
        if total[k]:
            after_text[k] = last[up] > 0 and tree.tag[last[up]] in PARAGRAPHS and in_links[last[up]] < 0.25 * total[last[up]]
            last[up] = k
    # outside articles, lists of nothing but links are menus; forms that do not hold the page are left out
    dropped = [False] * n
    for k in range(1, n):
        up = tree.parent[k]
        tag = tree.tag[k]
        dropped[k] = (
            dropped[up]
            or (tag == "form" and total[k] * 2 < total[0])
            or (
                tag in ("ul", "ol", "dl", "div", "section", "table")
                and not tree.article[k]
                and count[k] >= 3
                and in_links[k] >= 0.9 * total[k]
                and total[k] * 2 < total[0]
                and not (tag == "table" and after_text[k])
            )
        )
    score: list[float] = [START_POINTS.get(t, 0) for t in tree.tag]
    touched = [False] * n
    for k in range(n):
        if not own[k] or dropped[k]:
            continue
        points = 1 + commas[k] + min(own[k] / 100, 3)
        up = tree.parent[k] if tree.tag[k] in PARAGRAPHS and k else k
        level = 0
        while up >= 0 and level < 6:
            score[up] += points / (1 if level == 0 else 2 * level)
            touched[up] = True
            up, level = tree.parent[up], level + 1
    score = [s * (1 - in_links[k] / total[k]) if total[k] else 0.0 for k, s in enumerate(score)]
    candidates = [k for k in range(n) if touched[k] and not dropped[k] and total[k] and tree.tag[k] not in PARAGRAPHS] or [0]
    best = max(candidates, key=lambda k: (score[k], -k))
    for wanted in (("article",), ("main",)):
        up, found = best, -1
        while up > 0:
            plain = wanted == ("article",) and (total[best] - in_links[best]) * 2 >= total[up] - in_links[up]
            if tree.tag[up] in wanted and (plain or total[best] * 2 >= total[up]):
                found = up
            up = tree.parent[up]
        if found >= 0:
            best = found
            break
    keep = {best}
    if best:
        for k in range(1, n):
            if tree.parent[k] == tree.parent[best] and k != best and not dropped[k] and total[k]:
                density = in_links[k] / total[k]
                if tree.tag[k] in ("p", "pre", "blockquote"):
                    good = density < 0.25 and (total[k] >= LONG or tree.tag[best] not in ("article", "main"))
                else:
                    earned = score[k] - START_POINTS.get(tree.tag[k], 0)
                    good = touched[k] and density < 0.25 and earned >= max(5.0, 0.2 * score[best])
                    if tree.tag[k] == tree.tag[best] and density < 0.25:
                        plain = tree.label[k] is not None and tree.label[k] == tree.label[best]
                        good = good or tree.tag[k] == "section" or (tree.tag[k] == "div" and plain)
                if good:
                    keep.add(k)
        keep |= _titles(tree, best, total, keep)
    inside = [False] * n
    for k in range(n):
        inside[k] = not dropped[k] and (k in keep or (k > 0 and inside[tree.parent[k]]))
    return " ".join("".join([said for node, said, _ in tree.pieces if node < 0 or inside[node]]).split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row ``page_id, url, html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return arrow_map(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
