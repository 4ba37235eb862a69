"""Main text of web pages by composite text density.

Every element of the page's tree gets its characters, link characters, tags and link tags; its density is characters per
tag, corrected by a logarithm of how much of it is linked. The sum of the densities of its children is an element's
score, and the element of the largest score holds the main text, with subtrees beside its path that are as dense, and prose
that is next to it (see main_nodes). The least density on that path to body is the threshold: elements inside that stay below
it and are mostly links are dropped as well. Elements that are boilerplate by name (navigation, footers, forms and so on), or
by a class, id or role that is nothing but a word for it (comments, ad-box, site-footer) are cut before any counting. Words
that may also name content (related-work, search, notice), or that stand beside others (cookie-recipes), are hints alone, in
an article or not: such an element goes when it is mostly links or stays below the threshold. Headings are never cut.

Edge cases: a null or empty page has an empty text; a page without markup is one block; a page cut off anywhere is read
as far as it goes (a tag cut off at the end is dropped); elements left open end with their parent. Of nodes of equal score
the one that ends last in the page, which is the outer one, is taken. Very long and deeply nested pages take time in
proportion to their length. Repeated rows are read each for itself; an empty table gives an empty result; only the three
named columns are read, so others never clash. One Arrow pass, no shuffle; the tree of one page at a time is held in
memory."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded

TOKEN = re.compile(r"<!--|<[!?]|</?([a-zA-Z][^\s/>]*+)")
STOP = re.compile(r"[>\"']")
MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "xmp"}
SKIP = RAW | {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "label"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: What a start tag ends: open elements of these names, up to the nearest border.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDER = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "html", "blockquote"}
#: A block of this kind ends an open paragraph.
ENDS_P = BORDER | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "form", "header", "footer", "nav", "aside", "figure", "hr", "address", "details"}
#: Words of classes, ids and roles that name boilerplate.
BOILER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "footer", "masthead", "nav", "navbar",
    "navigation", "newsletter", "pager", "pagination", "popup", "promo", "promoted", "replies", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "toolbar", "contentinfo", "complementary",
}
#: Those that may also name content: hints, wherever they stand.
HINTS = {"banner", "copyright", "disclaimer", "menu", "modal", "notice", "notices", "recommended", "related", "responses", "search", "share", "sharing", "skip", "social", "header", "alert", "login", "widget"}
#: What may stand beside a word of BOILER_WORDS in a name without making it one of content (ad-box, site-footer).
PARTS = {"", "area", "bar", "block", "body", "bottom", "box", "col", "column", "container", "content", "entry", "form", "global", "group", "header", "inner", "item", "left", "links", "list", "main", "outer", "page", "panel", "post", "reader", "readers", "right", "section", "site", "slot", "thread", "top", "unit", "user", "wrap", "wrapper"}
#: Those that also tell an article element from the main one.
ARTICLE_WORDS = {"ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "promoted", "replies", "reply", "sponsor", "sponsored"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = HEADINGS | {"p", "blockquote", "pre"}
SPLIT_MARK = re.compile(r"[^a-z]+")
_RAW_ENDS: dict[str, re.Pattern] = {}


class Node:
    __slots__ = ("name", "parent", "depth", "hint", "kids", "chars", "link_chars", "tags", "link_tags", "density", "score")

    def __init__(self, name: str, parent: Node | None, hint: bool = False):
        self.name, self.parent, self.hint, self.kids = name, parent, hint, []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.score = 0.0


def _boiler(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """(whether an element is boilerplate by its names, whether they hint at it)."""
    if name in SKIP or (name == "header" and not inside):
        return True, False
    if name in ("body", "html", "main") or name in HEADINGS or (not attributes and name != "fieldset"):
        return False, False
    words = BOILER_WORDS if name != "article" else ARTICLE_WORDS
    hint = name == "fieldset"
    for m in MARK.finditer(attributes):
        for mark in (m[1] or m[2] or m[3] or "").lower().split():
            parts = set(SPLIT_MARK.split(mark))
            if found := parts & words:
                if not parts - found - PARTS - HINTS:
                    return True, False
                hint = True
            hint |= name != "article" and bool(parts & HINTS)
    return False, hint


class _Path:
    """The open elements, by name as well: finding and closing one costs no walk over its ancestors."""

    def __init__(self, root: Node):
        self.node, self.root = root, root
        self.by_name: dict[str, list[Node]] = {"html": [root]}

    def open(self, name: str, attributes_hint: bool) -> None:
        kid = Node(name, self.node, attributes_hint)
        self.node.kids.append(kid)
        self.node = kid
        self.by_name.setdefault(name, []).append(kid)

    def last(self, name: str) -> Node | None:
        return own[-1] if (own := self.by_name.get(name)) else None

    def near(self, name: str) -> Node | None:
        """The innermost open element of a name, if no border lies inside it."""
        own = self.last(name)
        if own is None or any((b := self.last(e)) is not None and b.depth > own.depth for e in BORDER):
            return None
        return own

    def close(self, own: Node) -> None:
        """Ends an element and all inside it; the root stays."""
        while self.node.depth >= own.depth and self.node is not self.root:
            self.by_name[self.node.name].pop()
            self.node = self.node.parent

    def inside(self) -> bool:
        return bool(self.by_name.get("article") or self.by_name.get("main"))


def parse(page: str) -> Node:
    """The tree of a page without boilerplate elements; texts are strings among the kids."""
    root = Node("html", None)
    path = _Path(root)
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    muted, depth = "", 0  # inside a boilerplate element: its name and how many of that name are open
    while at < n:
        m = TOKEN.search(page, at)
        if not muted and (m is None or m.start() > at):
            path.node.kids.append(page[at : m.start() if m else n])
        if m is None:
            break
        if m[1] is None:
            end = page.find("-->" if m[0] == "<!--" else ">", m.end())
            at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        at = _tag_end(page, m.end(), last)
        name, attributes = m[1].lower(), page[m.end() : at - 1]
        if at == n and page[-1] != ">":
            continue
        closing = page[m.start() + 1] == "/"
        if muted:
            if name == muted:
                depth += -1 if closing else 1
                if depth == 0:
                    muted = ""
            elif closing and name in ("body", "html", "article", "main") and muted not in RAW and path.last(name):
                muted = ""
            if muted:
                if name in RAW and not closing:
                    at = _after_raw(page, name, at)
                continue
        if closing:
            if name in VOID:
                if name == "br":
                    path.node.kids.append("\n")
            elif (own := path.last(name)) is not None:
                path.close(own)
            continue
        if name in RAW:
            at = _after_raw(page, name, at)
            continue
        if name in ENDS_P and (own := path.near("p")) is not None:
            path.close(own)
        if name in ENDS:
            while (own := next((o for e in ENDS[name] if (o := path.near(e)) is not None), None)) is not None:
                path.close(own)
        if name in VOID:
            path.node.kids.append("\n" if name in ("br", "hr") else "")
            continue
        if attributes.endswith("/") and name not in INLINE and name not in ENDS_P:
            continue
        cut, hint = _boiler(name, attributes, path.inside())
        if cut:
            muted, depth = name, 1
        else:
            path.open(name, hint)
    return root


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The end of a tag from within it. A quote that nothing closes (`last` has the last place of each kind) is a character."""
    while (m := STOP.search(page, at)) is not None:
        if m[0] == ">":
            return m.end()
        at = m.end() if m.start() >= last[m[0]] else page.find(m[0], m.end()) + 1
    return len(page)


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _after_raw(page: str, name: str, at: int) -> int:
    """The end of an element whose content is no markup."""
    if name not in _RAW_ENDS:
        _RAW_ENDS[name] = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I | re.A)
    end = _RAW_ENDS[name].search(page, at)
    return end.end() if end else len(page)


def measure(root: Node) -> list[Node]:
    """Counts, densities and scores of all nodes, children first."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [k for k in x.kids if type(k) is Node]
    order.reverse()
    for x in order:
        for k in x.kids:
            if type(k) is Node:
                x.chars += k.chars
                x.link_chars += k.link_chars
                x.tags += k.tags + 1
                x.link_tags += k.link_tags + (k.name == "a")
            else:
                x.chars += len("".join(k.split()))
        if x.name == "a":
            x.link_chars = x.chars
    whole = root.link_chars / max(1, root.chars)
    for x in order:
        tags, plain = max(1, x.tags), x.chars - x.link_chars
        base = math.log(max(2.0, x.chars / max(1, plain) * x.link_chars + whole * x.chars + math.e))
        inner = x.chars / max(1, x.link_chars) * tags / max(1, x.link_tags)
        x.density = x.chars / tags * (math.log(inner) / base if inner > 1 and base > 0 else 0.0)
        x.score = sum(k.density for k in x.kids if type(k) is Node)
    return order


def _mostly_links(x: Node) -> bool:
    return x.link_chars * 2 > x.chars


def _densest(x: Node) -> float:
    most, stack = 0.0, [x]
    while stack:
        k = stack.pop()
        most = max(most, k.density)
        stack += [c for c in k.kids if type(c) is Node]
    return most


def _is_prose(k: Node) -> bool:
    return k.chars > 0 and not k.hint and not _mostly_links(k)


def _has_blocks(x: Node) -> bool:
    return any(type(k) is Node and k.name not in INLINE and k.density > 0 for k in x.kids)


def main_nodes(root: Node) -> tuple[list[Node], float]:
    """The nodes that hold the main text, in the order of the page, and the threshold of the path from the node of the
    largest density sum to body. That node is widened to the outermost article or main element around it. Beside its path, a
    subtree not mostly links is taken as well

    * if it has blocks, and somewhere reaches the mean density of the node's children;
    * if it is an article with blocks, or has blocks where no article is around the node, and somewhere reaches the threshold
      or the density of the node's sparsest child that is no heading (unless a word hints at boilerplate);
    * if it lies between two that are taken, or, where no article is around the node, is a paragraph or heading next to
      one. Nothing of that kind is too short."""
    order = measure(root)
    best = max(reversed(order), key=lambda x: x.score)
    if best.score <= 0:
        best = root
    path = list(_up(best))
    threshold = min((x.density for x in path if x.density > 0), default=0.0)
    own = [k.density for k in best.kids if type(k) is Node and k.density > 0 and k.name not in HEADINGS and k.name not in INLINE]
    least, mean = min([threshold, *own]), sum(own) / len(own) if own else threshold
    top = next((k for k in range(len(path) - 1, 0, -1) if path[k].name in ("article", "main")), 0)
    within = path[top].name in ("article", "main")
    on_path, good = {id(x) for x in path}, {id(path[top])}
    for x in path[top + 1 :]:
        kids = [k for k in x.kids if type(k) is Node and k.chars > 0]
        kept = []
        for k in kids:
            taken = id(k) in on_path
            if not taken and not _mostly_links(k):
                dense = _densest(k)
                taken = _has_blocks(k) and (dense >= mean or (dense >= least and not k.hint and (k.name == "article" or not within)))
            kept.append(taken)
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        for i in range(first, last):
            kept[i] = kept[i] or _is_prose(kids[i])
        if not within:
            for step, i in ((-1, first - 1), (1, last + 1)):
                while 0 <= i < len(kids) and kids[i].name in PROSE and _is_prose(kids[i]):
                    kept[i] = True
                    i += step
        good |= {id(k) for k, taken in zip(kids, kept, strict=True) if taken and id(k) not in on_path}
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if id(x) in good:
            found.append(x)
        else:
            stack += [k for k in reversed(x.kids) if type(k) is Node]
    return found, threshold


def extract(page: str | None) -> str:
    """The main text: white space inside a block is one space, blocks are joined by one space."""
    if not page:
        return ""
    nodes, threshold = main_nodes(parse(page))
    blocks: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(current)).split())
        if text:
            blocks.append(text)
        current.clear()

    tops = {id(x) for x in nodes}
    stack: list = [k for x in reversed(nodes) for k in (None, x, None)]
    while stack:
        x = stack.pop()
        if type(x) is str:
            current.append(x)
        elif x is None:
            flush()
        else:
            if id(x) not in tops and x.name not in INLINE and x.name not in HEADINGS:
                sparse, linked = x.density < threshold, _mostly_links(x)
                if (sparse and linked) or (x.hint and (linked or _densest(x) < threshold)):
                    continue
            block = x.name not in INLINE
            if block:
                flush()
                stack.append(None)
            stack += reversed(x.kids)
    flush()
    return " ".join(blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages."""
    slim = bounded(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(v.as_py()) for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, f"page_id {slim.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
