"""Main text of web pages by tree scoring.

A page becomes a tree. Elements that never hold the article (scripts, menus,
controls, forms that do not hold the page, and containers whose role, class or
id names furniture) are cut; a name that only hints at furniture cuts a part
that has little text or much of it in links. Each
paragraph then passes points for its length and commas to its ancestors, in
full to the parent and less above; a container's points are discounted by the
share of its text that stands in links. The best container (or the article
element around it) is kept, with siblings that score well or read like text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, map_batches, pairs_schema, slices, texts_of

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    # Quotes count only where a value starts; a value without them runs to the next space.
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|[^\s/>=]++(?>\s*=\s*(?>\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+))?|=)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CUT = frozenset("script style textarea title xmp iframe noembed noframes noscript template head svg math canvas object audio video button select input datalist label legend nav footer aside dialog menu search".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
CONTAINERS = frozenset("div section ul ol dl table td p span aside header figure article li details center fieldset".split())
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar sidebars comment comments commentlist disqus respond "
    "cookie cookies consent gdpr notice notification alert newsletter subscribe subscription signup related recommended recommendations share sharing social menu menus nav "
    "navbar navigation breadcrumb breadcrumbs pagination pager footer footnav masthead popup modal overlay login search widget widgets toolbar skip copyright legal disclaimer "
    "trending outbrain taboola paywall reply replies discussion".split()
)
# Words that name sections of articles as well: alone they prove nothing.
DOUBTFUL = frozenset("discussion legal related recommended copyright disclaimer notice notification reply replies promotion sharing social search skip overlay alert banner paywall widget".split())
NEUTRAL = frozenset("box block section container wrapper wrap inner outer list item items area panel group bar links link main page site left right top bottom row col column content text title post article primary secondary aside module unit slot first last".split())
TOP_ONLY = frozenset(("header", "topbar", "top"))
# An element on the left ends an open one on the right.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body figcaption".split())
SHORT, MODERATE = 25, 80


class Node:
    __slots__ = ("attributes", "children", "inside", "linked", "parent", "score", "tag")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.score, self.inside, self.linked = 0.0, 0, 0


def parse(html: str) -> Node:
    root = Node("html", "", None)
    here, at = root, 0
    while at < len(html):
        m = TAG.search(html, at)
        stop = m.start() if m else len(html)
        if stop > at:
            here.children.append(entities.unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            up = here
            while up is not None and up.tag != name:
                # A paragraph's end tag does not reach out of its container.
                up = None if name == "p" and up.tag in BLOCKS else up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if name in BLOCKS:
            up = here
            while up.parent is not None and up.tag != "p" and up.tag not in BLOCKS:
                up = up.parent
            if up.tag == "p" and up.parent is not None:
                here = up.parent
            elif name in HEADINGS and up.tag in HEADINGS:
                here = up.parent
        if name in ENDS:
            up = here
            while up.parent is not None and up.tag not in FENCES[name]:
                if up.tag in ENDS[name]:
                    here = up.parent
                up = up.parent
        if name in ("html", "body") and (name == "html" or any(isinstance(c, Node) and c.tag == "body" for c in root.children)):
            continue
        node = Node(name, attributes, here)
        here.children.append(node)
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            at = html.find(">", end.start()) + 1 or len(html) if end else len(html)
        elif name not in VOID and not (attributes.endswith("/") and name not in BLOCKS):
            here = node
    return root


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attributes)}


def _within(node: Node, tags: Iterable[str]) -> bool:
    up = node.parent
    while up is not None:
        if up.tag in tags:
            return True
        up = up.parent
    return False


def _has(node: Node, tags: frozenset[str]) -> bool:
    stack = [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node):
                if c.tag in tags:
                    return True
                stack.append(c)
    return False


def _furniture(node: Node) -> bool:
    if node.tag in CUT:
        return True
    if not node.attributes.strip():
        return node.tag == "header" and not _within(node, ("article", "main"))
    have = _attributes(node)
    if "hidden" in have or have.get("aria-hidden", "").lower() == "true" or re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", have.get("style", "")):
        return True
    if have.get("role", "").lower() in CUT_ROLES:
        return True
    if node.tag == "header" and not _within(node, ("article", "main")):
        return True
    if node.tag in CONTAINERS:
        words = [[p.lower() for p in NAME_PART.findall(w)] for w in f"{have.get('class', '')} {have.get('id', '')}".split()]
        names = {p for w in words for p in w}
        if names & FURNITURE or (names & TOP_ONLY and not _within(node, ("article", "main"))):
            # A name all of whose words mean furniture is sure; another one
            # (related-work, legal) counts against a part that does not read.
            sure = any(w and all(p in FURNITURE or p in NEUTRAL for p in w) and any(p in FURNITURE and p not in DOUBTFUL for p in w) for w in words)
            return not _has(node, MAIN_PARTS) and (sure or not _reads_on(node))
    return False


def _reads_on(node: Node) -> bool:
    """A part of an article or of the main part that holds running text: a
    paragraph or more, few of it in links, and no form."""
    if not _within(node, ("article", "main")):
        return False
    nodes = _order(node)
    if any(n.tag in ("form", "input", "textarea", "button", "iframe") for n in nodes):
        return False
    _measure(nodes)
    text = sum(len(_own_text(n)) for n in nodes if n.tag in ("p", "pre", "blockquote", "li", "dd") or n is node)
    return text >= 2 * MODERATE and _links(node) < LINKED / 2


def _holds_page(form: Node, root: Node) -> bool:
    """A form around the page, as whole generations of sites have it: it holds
    the main part or most of all text."""
    return _has(form, MAIN_PARTS | {"article"}) or 2 * form.inside > root.inside


LINKED = 0.25
MAIN_PARTS = frozenset(("h1", "main"))


def prune(root: Node) -> None:
    _measure(_order(root))
    forms = {id(n) for n in _order(root) if n.tag == "form" and not _holds_page(n, root)}
    stack = [root]
    while stack:
        node = stack.pop()
        # In an article's header the headings belong to the article.
        if node.tag == "header" and _within(node, ("article", "main")):
            node.children = [c for c in node.children if isinstance(c, str) or c.tag in HEADINGS or c.tag == "hgroup" or _has(c, HEADINGS)]
        node.children = [c for c in node.children if isinstance(c, str) or not (id(c) in forms or _furniture(c))]
        stack += [c for c in node.children if isinstance(c, Node)]


def _order(root: Node) -> list[Node]:
    """Nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _measure(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        own = sum(len(" ".join(c.split())) for c in n.children if isinstance(c, str))
        n.inside = own + sum(c.inside for c in n.children if isinstance(c, Node))
        n.linked = n.inside if n.tag == "a" else sum(c.linked for c in n.children if isinstance(c, Node))


def _links(n: Node) -> float:
    return n.linked / n.inside if n.inside else 0.0


def _own_text(n: Node) -> str:
    """Text of a node outside of block elements in it."""
    parts, stack = [], list(reversed(n.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag not in BLOCKS:
            stack += reversed(c.children)
    return " ".join("".join(parts).split())


def score(nodes: list[Node]) -> None:
    texts = [(n, _own_text(n)) for n in nodes if n.tag in PARAGRAPHS]
    least = SHORT if any(len(t) >= SHORT for _, t in texts) else 1
    for n, text in texts:
        if len(text) < least:
            continue
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)) * (1 - _links(n))
        # Bare text in a container counts for the container itself.
        up, level = (n.parent if n.tag in ("p", "pre", "blockquote", "li", "dd", "td", "figcaption") else n), 0
        while up is not None and level < 5:
            up.score += points / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1


def choose(root: Node) -> list[Node]:
    nodes = _order(root)
    _measure(nodes)
    score(nodes)
    best = max((n for n in nodes if n.inside), key=lambda n: n.score * (1 - _links(n)), default=None)
    if best is None or not best.inside:
        return []
    up = best
    while up is not None:
        if up.tag == "article":
            best = up
            break
        up = up.parent
    if best.parent is None:
        return [best]
    need = max(10.0, 0.2 * best.score * (1 - _links(best)))
    if best.tag == "article":
        return [c for c in best.parent.children if not isinstance(c, str) and (c is best or c.score * (1 - _links(c)) >= need)]
    # Furniture is gone, so what stands beside the best container up to the
    # main part or the top is text, unless it is made of links.
    kept, at = [best], best
    while at.parent is not None and at.tag != "main":
        beside = at.parent.children
        sure = [n for n, c in enumerate(beside) if not isinstance(c, str) and (c is at or _reads(c) or c.score * (1 - _links(c)) >= need)]
        here = next(n for n, c in enumerate(beside) if c is at)
        stays = [sure[0] < n < sure[-1] or n in sure or isinstance(c, str) or _links(c) < LINKED for n, c in enumerate(beside)]
        kept = [c for n, c in enumerate(beside[:here]) if stays[n]] + kept + [c for n, c in enumerate(beside) if n > here and stays[n]]
        at = at.parent
    return kept


def _reads(c: Node) -> bool:
    text = _own_text(c) if c.tag == "p" else ""
    return c.tag == "h1" or len(text) > MODERATE and _links(c) < LINKED or 0 < len(text) <= MODERATE and not c.linked and text[-1] in ".!?"


def render(nodes: list[Node]) -> str:
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    stack: list[object] = list(reversed(nodes))
    while stack:
        c = stack.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            held.append(c)
        elif c.tag == "br":
            held.append(" ")
        elif c.tag in BLOCKS:
            flush()
            stack.append(None)
            stack += reversed(c.children)
        else:
            stack += reversed(c.children)
    flush()
    return "\n".join(blocks)


def main_text(html: str) -> str:
    if not html:
        return ""
    root = parse(html)
    prune(root)
    return render(choose(root))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row: block texts in page order, one a line.

    Null and empty pages, and pages without text outside of furniture, give an
    empty text; plain text without markup is one block; nothing is cut off,
    however long. Further columns, of any name, take no part. Rows that repeat an id stay rows of their own; an empty table gives none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts = [main_text(t) for t in texts_of(b, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(col(id_col).alias("id"), col(url_col).cast("string").alias("url"), col(html_col).alias("html"))
    return map_batches(rows, run, pairs_schema(pages, id_col, "id", "url string, text string, n_chars long"))
