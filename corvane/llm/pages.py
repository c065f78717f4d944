"""Main text of web pages by tag-path ratios.

A page becomes a list of text nodes, each with its path of tags (and class) from the root.

1. Aggregate: for each path the length and the punctuation of all its nodes, divided by the number of nodes.
2. Smooth: both ratios along the page with a Gaussian, in which nodes of kindred paths count more.
3. Fuse: length ratio x (1 + punctuation ratio), the mean of a path's nodes, times one weak feature: how far tags
   and names speak for a menu, a footer, an advert, links or an article. A feature lowers or raises a score; it decides
   nothing alone.
4. Smooth over the tree: the deepest container that holds four fifths of length x score lends its mean to the short nodes
   inside it, and to headings right before or between content.
5. Threshold: nodes of at least a share of the mean score of all text are content.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
_LOOSE = r"<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
#: Tags with quoted attributes of any length; from the first tag on whose quotes never close, tags end at their first '>'.
_MARKUP = re.compile(_OTHER + r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>|" + _LOOSE, re.S)
_BROKEN = re.compile(_OTHER + r"|(?P<end>(?!))(?P<tag>(?!))(?P<attrs>(?!))|" + _LOOSE, re.S)
_NO_TAGS = re.compile(_OTHER, re.S)
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text no reader reads as prose: code, controls, fallbacks.
UNREAD = frozenset("form script style noscript template head title button select textarea option iframe object svg math canvas audio video input label fieldset datalist noembed noframes xmp".split())
#: Elements that mostly hold what stands around an article.
FURNITURE = frozenset("nav footer aside header menu dialog".split())
#: Words in class, id or role that mark furniture.
NAMES = frozenset(
    "ad ads advert advertisement adverts adsense banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer form header masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion reader-comments related remark reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Names of elements beside the story that may be articles themselves, and of what readers write.
BESIDE = frozenset("ad ads advert advertisement adverts adsense promo promoted promotion related sponsor sponsored sidebar sidebars widget widgets newsletter".split())
READERS = frozenset("comment comments discussion disqus reader-comments reply replies respond".split())
#: Names of articles that only announce another one; they mark nothing else.
TEASERS = frozenset("teaser teasers card cards preview previews recommended recommendation recommendations".split())
#: Names that also head parts of a story: inside it they mark furniture only where the text is no prose.
SOFT = frozenset("respond reply replies remark tags notice disclaimer discussion search share sharing social copyright".split())
#: Words that say where an element is and may stand in a compound name.
PLACES = frozenset("site main left right top bottom primary secondary section area box block list item container wrapper bar inner outer the posts articles stories links buttons icons slot unit group holder feed panel".split())
CONTENT_TAGS = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be the container of all content.
CONTAINERS = frozenset(["", *"html body article main section div td center".split()])
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
#: The weak feature: what tags or names of furniture, links, and an article element do to a score.
ODD, LINKED, MARKED = 0.01, 0.1, 3.0
#: Share of all mass that the container holds; share of the mean score that content has; least score of content.
HELD, SHARE, LEAST = 0.8, 0.5, 0.1
SIGMA, RADIUS, STRANGE = 1.0, 2, 0.05
#: A start tag of the key closes an open element of the values, within the nearest of its scope.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "option": ("select",), "body": ("html",)}


@dataclass
class Node:
    """An open element; ``path`` numbers its path of tags and classes, ``above`` is the number of its parent's path."""

    tag: str
    path: int
    above: int
    parent: Node | None
    number: int
    unread: bool = False
    odd: bool = False
    article: bool = False
    heading: bool = False
    link: bool = False
    names: frozenset[str] = frozenset()


@dataclass
class Text:
    """A run of text: where it stands, its block's number and its string."""

    node: Node
    block: int
    value: str

    @property
    def size(self) -> int:
        return len(self.value.strip())

    @property
    def signs(self) -> int:
        return len(PUNCTUATION.findall(self.value))


@dataclass
class Page:
    """Elements, each after its parent, and text nodes of a page in order."""

    nodes: list[Node] = field(default_factory=list)
    texts: list[Text] = field(default_factory=list)


def _names(attrs: str) -> frozenset[str]:
    """The words of NAMES and TEASERS in tokens of class, id, role and aria-label that have no other words than places."""
    found: set[str] = set()
    for m in _NAMED.finditer(attrs):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            words = {token} if token in NAMES else set(re.findall("[a-z]+", token))
            if words & (NAMES | TEASERS) and words <= NAMES | TEASERS | PLACES:
                found |= words & (NAMES | TEASERS)
    return frozenset(found)


def parse(source: str) -> Page:
    """Elements and text nodes with their paths; markup may be broken."""
    page = Page()
    paths: dict[tuple[int, str, str], int] = {}
    root = Node("", 0, 0, None, 0)
    page.nodes.append(root)
    stack = [root]
    open_tags: Counter[str] = Counter()
    block, at = 0, 0
    n, last = len(source), source.rfind(">")
    pattern = _MARKUP

    def text(raw: str) -> None:
        if raw and (not raw.isspace() or (page.texts and page.texts[-1].block == block)):
            page.texts.append(Text(stack[-1], block, html.unescape(raw) if "&" in raw else raw))

    def close(k: int) -> None:
        for x in stack[k:]:
            open_tags[x.tag] -= 1
        del stack[k:]

    while at < n:
        m = (pattern if at <= last else _NO_TAGS).search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        if m.re is _NO_TAGS:
            continue
        if m["tag2"]:
            pattern = _BROKEN
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag in BLOCKS:
                block += 1
            if tag == "br":
                text(" ")
            if open_tags[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag not in BLOCKS and stack[k].tag in BLOCKS:
                        break  # an inline end tag does not close a block
            continue
        if tag in BLOCKS:
            block += 1
            if open_tags["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):  # a block closes an open paragraph
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCKS:
                        break
            if any(open_tags[x] > 0 for x in _CLOSES.get(tag, ())):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _SCOPE[tag]:
                        break
                    if stack[k].tag in _CLOSES[tag]:
                        close(k)
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        parent = stack[-1]
        kind = _CLASS.search(attrs) if attrs else None
        path = paths.setdefault((parent.path, tag, next((x for x in kind.groups() if x), "").lower() if kind else ""), len(paths) + 1)
        node = Node(tag, path, parent.path, parent, len(page.nodes), link=parent.link or tag == "a", heading=parent.heading or tag in HEADINGS)
        node.article = parent.article or tag in CONTENT_TAGS
        node.unread = parent.unread or tag in UNREAD or bool(attrs and _HIDDEN.search(attrs))
        node.odd = parent.odd or tag in FURNITURE
        if parent.tag == "header" and parent.article and tag in HEADINGS:
            node.odd = bool(parent.parent and parent.parent.odd)  # an article's own heading
        node.names = _names(attrs) if attrs and tag not in ("html", "body") else frozenset()
        open_tags[tag] += 1
        stack.append(node)
        page.nodes.append(node)
    return page


def _totals(page: Page, texts: list[Text], values: list[float]) -> list[float]:
    """The sum of the texts' values in each element."""
    out = [0.0] * len(page.nodes)
    for t, v in zip(texts, values, strict=True):
        out[t.node.number] += v
    for x in reversed(page.nodes):
        if x.parent is not None:
            out[x.parent.number] += out[x.number]
    return out


def named_odd(page: Page, texts: list[Text]) -> list[bool]:
    """Which elements names make furniture, by themselves or by what is around them.

    A name does not count on an element that holds most of the page's text (nine tenths for readers' comments), on one of
    the SOFT names that holds prose inside the story, or on one around an outermost article unless it is BESIDE or READERS.
    Names of TEASERS count on articles, unless the article holds half the text of the largest.
    """
    size = _totals(page, texts, [t.size for t in texts])
    signs = _totals(page, texts, [t.signs for t in texts])
    count = _totals(page, texts, [1] * len(texts))
    linked = _totals(page, texts, [t.size if t.node.link else 0 for t in texts])
    total = max(size[0], 1)
    most = max((size[x.number] for x in page.nodes if x.tag == "article"), default=0)
    soft, hard, readers = ([False] * len(page.nodes) for _ in range(3))
    for x in page.nodes[1:]:
        i, p = x.number, x.parent
        outermost = x.tag in CONTENT_TAGS and not p.article
        readers[i] = readers[p.number] or bool(x.names & READERS - SOFT)
        hard[i] = hard[p.number]
        soft[i] = soft[p.number] and not outermost
        if p.tag == "header" and p.article and x.tag in HEADINGS:  # its heading does not take the name of an article's header
            hard[i], soft[i] = (hard[p.parent.number], soft[p.parent.number]) if p.parent else (False, False)
        if x.tag == "article" and 2 * size[i] < most and (x.names & TEASERS or 2 * linked[i] >= size[i]):
            hard[i] = True
        names = x.names - TEASERS
        if not names or (x.tag in CONTENT_TAGS and not names & (BESIDE | READERS)):
            continue
        if size[i] / total > (0.9 if names & READERS and names & READERS - SOFT else 0.5):
            continue
        prose = size[i] >= 40 * count[i] and 200 * signs[i] >= size[i]
        if names <= SOFT and not readers[p.number] and x.article and prose:
            continue
        if names & (BESIDE | READERS):
            hard[i] = True
        else:
            soft[i] = True
    return [a or b for a, b in zip(soft, hard, strict=True)]


def ratios(texts: list[Text]) -> np.ndarray:
    """Fused score of each node's path: its length and punctuation for each node, smoothed along the page."""
    length: dict[int, int] = defaultdict(int)
    signs: dict[int, int] = defaultdict(int)
    count: dict[int, int] = defaultdict(int)
    for t in texts:
        length[t.node.path] += t.size
        signs[t.node.path] += t.signs
        count[t.node.path] += 1
    path = np.array([t.node.path for t in texts])
    above = np.array([t.node.above for t in texts])
    both = np.array([[length[p] / count[p], signs[p] / count[p]] for p in path.tolist()])
    sums, weights = both.copy(), np.ones(len(texts))
    for k in range(1, min(RADIUS, len(texts) - 1) + 1):
        a, b = slice(0, len(texts) - k), slice(k, len(texts))
        kindred = (path[a] == path[b]) | (above[a] == above[b])
        weight = np.exp(-0.5 * (k / SIGMA) ** 2) * np.where(kindred, 1.0, STRANGE)
        sums[a] += weight[:, None] * both[b]
        sums[b] += weight[:, None] * both[a]
        weights[a] += weight
        weights[b] += weight
    smooth = sums / weights[:, None]
    fused = smooth[:, 0] * (1 + smooth[:, 1])
    _, number = np.unique(path, return_inverse=True)
    return (np.bincount(number, fused) / np.bincount(number))[number]


def scores(page: Page, texts: list[Text]) -> np.ndarray:
    """The score of each text node: its path's ratios and the weak feature, smoothed over the tree."""
    size = np.array([t.size for t in texts], float)
    odd = named_odd(page, texts)
    filled = _totals(page, texts, size.tolist())
    articles = any(x.tag == "article" and filled[x.number] for x in page.nodes)
    marked = [False] * len(page.nodes)
    for x in page.nodes[1:]:
        marked[x.number] = marked[x.parent.number] or x.tag == "article" or (not articles and x.tag == "main")
    tags = np.array([(ODD if t.node.odd or odd[t.node.number] else 1.0) * (MARKED if marked[t.node.number] else 1.0) for t in texts])
    block_size, block_linked = defaultdict(int), defaultdict(int)
    for t in texts:
        block_size[t.block] += t.size
        block_linked[t.block] += t.size if t.node.link else 0
    links = np.array([1 - (1 - LINKED) * block_linked[t.block] / max(block_size[t.block], 1) for t in texts])
    own = ratios(texts) * tags * links
    mass = size * own**2
    held = _totals(page, texts, mass.tolist())
    if held[0] <= 0:
        return own
    # The deepest container of most mass, then the article around it; it lends its mean to what it holds.
    root = max((x for x in page.nodes if x.tag in CONTAINERS and held[x.number] >= HELD * held[0]), key=lambda x: x.number)
    root = next((x for x in _around(root) if x.tag in CONTENT_TAGS and marked[x.number]), root)
    under = [False] * len(page.nodes)
    for x in page.nodes[root.number :]:
        under[x.number] = x is root or bool(x.parent and under[x.parent.number])
    inside = np.array([under[t.node.number] for t in texts])
    lent = float((own * size)[inside].sum() / max(size[inside].sum(), 1)) * tags / tags[inside].max()
    out = np.where(inside, np.maximum(own, lent), own)
    # Headings right before the content and within it stand as high, but for what the feature takes off.
    content = np.flatnonzero(out >= threshold(out, size))
    if len(content):
        first, end = int(content[0]), int(content[-1])
        heads = [t.node.heading for t in texts]
        while first > 0 and heads[first - 1]:
            first -= 1
        for i in range(first, end):
            if heads[i]:
                out[i] = max(out[i], lent[i] * links[i])
    return out


def threshold(score: np.ndarray, size: np.ndarray) -> float:
    """A share of the mean score of all text, in which a text weighs its length times its score; LEAST at least."""
    mass = score * size
    return max(LEAST, SHARE * float((mass * score).sum() / mass.sum())) if mass.sum() > 0 else LEAST


def _around(node: Node | None) -> Iterator[Node]:
    """A node and the elements around it."""
    while node is not None:
        yield node
        node = node.parent


def article(page: Page) -> list[Text]:
    """The text nodes over the threshold, in page order; white space between two of one block stays."""
    texts = [t for t in page.texts if not t.node.unread]
    solid = [t for t in texts if t.size]
    if not solid:
        return []
    score = scores(page, solid)
    least = threshold(score, np.array([t.size for t in solid], float))
    kept = {id(t) for t, s in zip(solid, score.tolist(), strict=True) if s >= least}
    return [t for t in texts if not t.size or id(t) in kept]


def main_text(source: str) -> str:
    """The content's blocks, one a line; white space inside a block is one space."""
    blocks: dict[int, list[str]] = defaultdict(list)
    for t in article(parse(source)):
        blocks[t.block].append(t.value)
    lines = (" ".join("".join(x).split()) for _, x in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """The main text of each row's page.

    Adds text ('' if there is none) and n_chars (its code points). A null or empty page has no text; broken markup,
    unclosed elements and comments, and bad references are read as far as they go; repeated rows stay repeated; an empty
    table gives an empty result; columns other than ``keep`` and the page are ignored. No shuffle; one page is worked on
    at a time.
    """

    def work(rows: list[bytes]) -> dict[str, list]:
        texts = [main_text(r.decode(errors="replace")) for r in rows]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return per_text(pages, list(keep), lambda: work, [("text", pa.string()), ("n_chars", pa.int64())], "text string, n_chars long", column)
