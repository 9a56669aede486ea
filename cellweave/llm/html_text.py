"""Main text of web pages by scoring the element tree.

A page is read into a tree of elements and text. Every paragraph-like block gives points for its length and its commas
to its parent and, halved at each step, to all further ancestors; a container's points are discounted by the share of
its text that lies in links. What is kept is the best container and, up to the article, main or body around it, every
other container with enough points, and what stands between and beside them unless it is mostly links; never the parts
that are no article text (scripts, menus, forms, adverts, comments by readers and so on).

The whole page is read, however long; nothing nests deeper on Python's stack, since the tree is built and walked with
explicit stacks.

Defined results: null or empty html gives an empty text; broken markup is read as browsers do (unclosed paragraphs end
where the next begins, unknown end tags are skipped, an unclosed comment or script runs to the end of the page); null
and repeated page_ids are ordinary rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, and words by which class, id and role tell what an element is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object".split())
NEVER = frozenset("head script style noscript template iframe svg object nav header footer aside form button select option textarea input fieldset dialog menu title canvas audio video".split())
#: Of these, what an article may have of its own.
INNER = frozenset("header aside".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
PARAGRAPH = frozenset("p pre td blockquote dd li h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("p pre blockquote table ul ol dl details address hr".split())
UNLIKELY = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|sidebar\w*|side|menu\w*|nav|navbar|navigation|breadcrumb\w*|header|footer|masthead|cookie\w*|consent|gdpr|notice\w*|popup\w*|modal|newsletter\w*|subscribe\w*|social\w*|share\w*|sharing|related\w*|recommend\w*|comments?|comment-\w+|commentlist|disqus\w*|respond|reply|replies|pager|pagination|widget\w*|login|signup|search|tags|toolbar|skip\w*|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
#: Parts of hyphenated names that also name an article's own sections (side-effects, promotion-history, notice-board).
AMBIGUOUS = re.compile(r"^(?:side|promo\w*|notice\w*|header|share\w*|related\w*|tags|legal|search|skip\w*|social\w*|menu\w*|reply|replies|respond|page|disclaimer|copyright|banner\w*|modal|consent|recommend\w*)$", re.I)
#: Link density above which, and characters below which, an element with such a name is none of the article.
APART_DENSITY, APART_CHARS = 0.25, 40
LIKELY = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|hentry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
TAG_POINTS = {"article": 10.0, "main": 8.0, "section": 2.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "dd": -3.0, "dt": -3.0, "address": -3.0, "th": -5.0}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I | re.S)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attributes", "bonus", "children", "chars", "commas", "linked", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        self.points = self.bonus = 0.0
        self.chars = self.linked = self.commas = 0


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html", None, {})
    here, at, n = root, 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            here = _close(here, m[1].lower())
            continue
        if not m[2]:
            continue
        tag, rest = m[2].lower(), m[3]
        if tag in ("html", "body") and here.parent is None and tag == "html":
            continue
        here = _before(here, tag)
        node = Node(tag, here, {a[0].lower(): a[1] or a[2] or a[3] or "" for a in _ATTRIBUTE.findall(rest)} if rest.strip() else {})
        here.children.append(node)
        if tag in RAW and not rest.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not (rest.rstrip().endswith("/") and tag in RAW):
            here = node
    return root


def _before(here: Node, tag: str) -> Node:
    """Where a new element goes: some elements end others that are open."""
    ends = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}.get(tag, set())
    stop = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "body", "html", "blockquote"}
    if tag in CLOSES_P:
        node = here
        while node.parent is not None and node.tag != "p" and (node.tag not in BLOCK):
            node = node.parent
        if node.tag == "p":
            here = node.parent
    node = here
    while ends and node.parent is not None and node.tag not in stop:
        if node.tag in ends:
            return node.parent
        node = node.parent
    if tag == "body" or (tag in BLOCK and here.tag == "head"):
        while here.tag == "head" and here.parent is not None:
            here = here.parent
    return here


def _close(here: Node, tag: str) -> Node:
    node = here
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if tag not in BLOCK and node.tag in BLOCK:
            return here
        node = node.parent
    return here


def _own_text(node: Node) -> bool:
    """Whether an element has text of some length of which little is linked."""
    chars = linked = 0
    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        x, in_link = stack.pop()
        if isinstance(x, str):
            n = len(x.strip())
            chars, linked = chars + n, linked + n * in_link
        elif x.tag not in NEVER or x is node:
            stack += [(c, in_link or x.tag == "a") for c in x.children]
    return chars >= APART_CHARS and linked < APART_DENSITY * chars


def _only_ambiguous(names: str) -> bool:
    """Whether what is unlikely about class and id are only parts of longer names that an article's sections may have too."""
    for token in names.split():
        parts = re.split(r"[-_]", token)
        hits = [p for p in parts if UNLIKELY.search(p)]
        if UNLIKELY.search(token) and (not hits or len(hits) == len(parts) or not all(AMBIGUOUS.match(p) for p in hits)):
            return False
    return True


def unlikely(node: Node, inside: bool = False) -> bool:
    """Whether an element is none of the article by its name, role, class or id; inside: it stands in an article element."""
    if node.tag in NEVER and not (inside and node.tag in INNER and _own_text(node)):
        return True
    a = node.attributes
    if not a or node.tag in ("body", "html", "article", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in UNLIKELY_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if not UNLIKELY.search(names) or (LIKELY.search(names) and not re.search(r"comment|sidebar|ad[sv]?\b", names, re.I)):
        return False
    return not (inside and _only_ambiguous(names) and _own_text(node))


def prune(root: Node) -> None:
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag == "article"
        node.children = [c for c in node.children if isinstance(c, str) or not unlikely(c, inside)]
        stack += [(c, inside) for c in node.children if isinstance(c, Node)]


def ordered(root: Node) -> list[Node]:
    """All elements, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def score(root: Node) -> list[Node]:
    """Set every element's characters, linked characters and points; return the containers that have points."""
    nodes = ordered(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                text = _SPACE.sub(" ", html.unescape(c)).strip()
                node.chars += len(text)
                node.commas += sum(text.count(x) for x in ",،、，")
            else:
                node.chars += c.chars
                node.linked += c.linked
                node.commas += c.commas
        if node.tag == "a":
            node.linked = node.chars
    near: set[int] = set()  # a name or tag counts for at most two steps above a paragraph
    for node in nodes:
        direct = node.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and c.strip() for c in node.children)
        if not (node.tag in PARAGRAPH or direct) or not node.chars:
            continue
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str)) if direct else node.chars
        up = node if direct else node.parent
        if up is not None:
            up.points += 1 + node.commas * (own / node.chars) + min(own / 100, 3)
            near |= {id(up), id(up.parent)}
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.points += node.points / 2
    scored = [node for node in nodes if node.points > 0]
    for node in scored:
        if id(node) in near:
            node.bonus = TAG_POINTS.get(node.tag, 0.0) + (25 if LIKELY.search(_names(node)) else 0)
        apart = 1 - (node.linked / node.chars if node.chars else 0)
        node.bonus *= apart
        node.points = node.points * apart + node.bonus
    return scored


def _names(node: Node) -> str:
    return f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}"


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _chosen(node: Node, best: Node, rich: set[int], limit: float) -> list[Node | str]:
    """The children of a container around the best one that belong to the article."""
    strong, anchors, shapes = set(), [], set()
    for k, c in enumerate(node.children):
        if isinstance(c, str):
            continue
        name = c.attributes.get("class", "")
        same = c.points + (best.points * 0.2 if name and name == best.attributes.get("class") else 0)
        if id(c) in rich or same >= limit:
            strong.add(k)
            if c.tag == "section" or name:
                shapes.add((c.tag, name))
        if k in strong or (c.chars and (c.tag in HEADING or (c.tag == "p" and c.chars > 80 and _density(c) < 0.25))):
            anchors.append(k)
    whole = node.tag == "article" or bool(LIKELY.search(_names(node)))
    out: list[Node | str] = []
    for k, c in enumerate(node.children):
        if isinstance(c, str) or k in strong or c.tag == "br":
            out.append(c)
            continue
        between = whole or (anchors and anchors[0] < k < anchors[-1]) or (c.tag, c.attributes.get("class", "")) in shapes or c.tag not in BLOCK
        if c.tag in ("h1", "h2") or (_density(c) < 0.5 and (between or c.tag in HEADING)) or (_density(c) < 0.25 and c.tag in CONTENT):
            out.append(c)
    return out


def _kept(root: Node) -> Node:
    """The least element around all that is kept; what is not has been taken out of it."""
    scored = score(root)
    if not scored:
        return root
    best = max(scored, key=lambda x: x.points)
    chain = [best]
    while chain[-1].parent is not None:
        chain.append(chain[-1].parent)
    step = {id(x): k for k, x in enumerate(chain)}
    bound = next((max(k for k, x in enumerate(chain) if x.tag == tag) for tag in ("article", "main") if any(x.tag == tag for x in chain)), len(chain) - 1)
    limit = max(10.0, best.points * 0.2)
    top = bound if chain[bound].tag == "article" else min(1, bound)
    # Containers of enough points, and all elements from them up to the best one's ancestors.
    rich, path = set(), {id(best): 0}
    for node in scored:
        if id(node) in step or node.points - node.bonus < limit:
            continue
        seen, at = [], node
        while id(at) not in path and id(at) not in step:
            seen.append(at)
            at = at.parent
        k = path.get(id(at), step.get(id(at), 0))
        path |= {id(x): k for x in seen}
        if 0 < k <= bound:
            rich |= {id(x) for x in seen}
            top = max(top, k)
    rich |= {id(x) for x in chain[:top]}
    # Only elements above the best one are sifted; another rich container is kept whole.
    for node in chain[1 : top + 1]:
        node.children = _chosen(node, best, rich, limit)
    return chain[top]


def blocks(top: Node) -> Iterator[str]:
    """The text blocks of an element in page order: white space is one space, ends are trimmed, br and blocks end one."""
    run: list[str] = []
    stack: list[Node | str | None] = [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(html.unescape(x))  # a reference ends with its text node
            continue
        if x is None or x.tag in BLOCK or x.tag == "br":
            if text := _SPACE.sub(" ", "".join(run)).strip():
                yield text
            run = []
        if x is not None:
            if x.tag in BLOCK:
                stack.append(None)
            stack += reversed(x.children)
    if text := _SPACE.sub(" ", "".join(run)).strip():
        yield text


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(blocks(_kept(root)))


def extract(pages: DataFrame, html_col: str = "html", id_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """id columns, text and n_chars of every page, without a shuffle."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part[len(id_cols)].to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part[k] for k in range(len(id_cols))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*id_cols, "text", "n_chars"])

    return pages.select(*id_cols, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, schema)
