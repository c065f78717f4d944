"""Page text: golden pages, broken markup, and the synthetic pages' own articles."""

from __future__ import annotations

import html
import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import pages as P
from corvane.llm.pages import extract_pages, main_text

BODY = "<p>The first paragraph of the story has a good many words, commas, and stops.</p><p>Short.</p>"
FULL = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, really.</div>
<aside>Side words, many of them, and more.</aside><div id="sidebar"><p>Most read, of all, today.</p></div>
<article><header><h1>Head &amp; line</h1><p>By someone</p></header>{BODY}<ul><li>one</li><li>two <b>bold</b> words</li></ul><div class="advert">Buy now, buy here.</div>
<form><input><label>Your mail</label></form><section class="comments"><p>A reader says, well, that it is good.</p></section><footer>Tags</footer></article>
<div class="comments">Another reader, and what they said.</div><footer>&copy; all rights, always.</footer></body></html>"""


def test_whole_page():
    assert main_text(FULL) == "Head & line\nThe first paragraph of the story has a good many words, commas, and stops.\nShort.\none\ntwo bold words"


def test_several_articles():
    """Teasers beside or inside the article, and comments marked up as articles."""
    teaser = "<article class='teaser'><h3>Other</h3><p>Read on.</p></article>"
    page = f"<main><h1>Section</h1><article><h1>Head</h1>{BODY * 2}<div class='comments'><article><p>I say, no, no, no.</p></article></div></article>{teaser}{teaser}</main>"
    assert main_text(page) == "\n".join(["Head", *["The first paragraph of the story has a good many words, commas, and stops.", "Short."] * 2])


def test_without_article_element():
    page = f"<html><body><div class='menu'><a>Home</a></div><div class='content'><h2>Title</h2>{BODY * 3}</div><div class='footer'>All rights, reserved, here.</div></body></html>"
    assert main_text(page) == "\n".join(["Title", *["The first paragraph of the story has a good many words, commas, and stops.", "Short."] * 3])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""), ("plain text, only", "plain text, only"), ("<article><p>a<b>b</b> c\n d&nbsp;e<p>f&amp g &am &#233;&#x41;", "ab c d e\nf& g &am éA"),
        ("<article><p><b>x<br><p>y</p></b>z</article>", "x\ny\nz"), ("<article><!-- no > --><p>a<!-- b --></p><p>c<!-- open", "a\nc"),
        ("<article><p title='a > b' hidden>no</p><p title=\"x>y\">yes</p></article>", "yes"), ("<article><p>a < b and <3</p></article>", "a < b and <3"),
        ("<article><script>if (a < b) '</p>'</script><p>t</p><style>x", "t"), ("<nav>a</nav>", ""), ("<article></article>", ""), ("<a \"" * 2000 + "<article><p>end", "end"),
        ("<main><table><tr><td>a<td>b<tr><td>c</table></main>", "a\nb\nc"), ("<article><p>" + "long " * 50_000 + "</p>", ("long " * 50_000).strip()), ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_synthetic_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract_pages(pages).collect():
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", FULL), (3, "u", FULL), (None, "u", "<p>x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted((str(i), main_text(h or "")) for i, _, h in rows)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


STORY = ["The first paragraph of the story has a good many words, commas, and stops.", "Short."]


@pytest.mark.parametrize("attrs", ["class='layout no-sidebar'", "class='has-sidebar'", "class='with-comments'", "class='ad-free'", "id='search-page'", "id='search'", "class='widget'"])
def test_names_around_the_article(attrs):
    """A wrapper's name does not empty the article, whether the page has an article element or not."""
    menu = "<div class='menu'><a>Home</a></div>"
    assert main_text(f"<body><div {attrs}>{menu}<article>{BODY * 2}</article><div class='comments'><p>I say, no.</p></div></div></body>") == "\n".join(STORY * 2)
    assert main_text(f"<body><div {attrs}>{menu}<div>{BODY * 2}</div></div></body>") == "\n".join(STORY * 2)


@pytest.mark.parametrize("name", ["response", "reply", "remark", "tags"])
def test_named_section_of_prose(name):
    page = f"<article>{BODY * 3}<section class='{name}'><p>The minister gave an answer to this, and it was long, and it was firm.</p></section></article>"
    assert main_text(page) == "\n".join([*STORY * 3, "The minister gave an answer to this, and it was long, and it was firm."])
    if name != "response":  # never a name of furniture
        assert main_text(f"<article>{BODY * 3}<div class='{name}'><a>one</a> <a>two</a></div></article>") == "\n".join(STORY * 3)


def test_content_beside_the_largest_block():
    """Without an article element: headings before the body, and an introduction beside the story."""
    assert main_text(f"<body><div class='menu'>Home</div><h1>Head</h1><div class='body'>{BODY * 3}</div></body>") == "\n".join(["Head", *STORY * 3])
    intro = "The introduction of the story is short, but has commas, and belongs to it."
    assert main_text(f"<body><div class='intro'><p>{intro}</p></div><h2>Then</h2><div class='story'>{BODY * 7}</div></body>") == "\n".join([intro, "Then", *STORY * 7])


def test_unequal_articles():
    """An article in unequal parts is whole; a small one goes where names or links show that it is a teaser or a comment."""
    part = "<article><h2>Part two</h2><p>A shorter part, which ends the story.</p></article>"
    small = "<article class='card'><p>Read on.</p></article><article><h3><a href='/x'>Another story</a></h3></article><div class='comments'><article><p>I say, no.</p></article></div>"
    assert main_text(f"<body><article>{BODY * 4}</article>{part}{small}</body>") == "\n".join([*STORY * 4, "Part two", "A shorter part, which ends the story."])


def plain_ratios(texts):
    """Length and punctuation for each node of a path, smoothed by Gaussian weights, fused, averaged by path: by loops."""
    mean = {}
    for p in {t.node.path for t in texts}:
        own = [t for t in texts if t.node.path == p]
        mean[p] = (sum(len(t.value.strip()) for t in own) / len(own), sum(len(P.PUNCTUATION.findall(t.value)) for t in own) / len(own))
    fused = []
    for i, t in enumerate(texts):
        sums, weight = [0.0, 0.0], 0.0
        for j in range(max(0, i - P.RADIUS), min(len(texts), i + P.RADIUS + 1)):
            u = texts[j]
            near = u.node.path == t.node.path or u.node.above == t.node.above
            w = math.exp(-0.5 * ((i - j) / P.SIGMA) ** 2) * (1.0 if near else P.STRANGE)
            sums = [s + w * m for s, m in zip(sums, mean[u.node.path], strict=True)]
            weight += w
        fused.append(sums[0] / weight * (1 + sums[1] / weight))
    return [statistics.fmean(f for f, u in zip(fused, texts, strict=True) if u.node.path == t.node.path) for t in texts]


def chain(node):
    return [] if node is None else [node, *chain(node.parent)]


def plain_text(source):
    """The method by its definition: loops over all pairs of texts and elements."""
    page = P.parse(source)
    texts = [t for t in page.texts if t.value.strip() and not t.node.unread]
    if not texts:
        return ""
    size = [len(t.value.strip()) for t in texts]
    odd = P.named_odd(page, texts)
    tags = ("article",) if any(x.tag == "article" for t in texts for x in chain(t.node)) else ("main",)
    feature = [(P.ODD if t.node.odd or odd[t.node.number] else 1.0) * (P.MARKED if any(x.tag in tags for x in chain(t.node)) else 1.0) for t in texts]
    links = []
    for t in texts:
        block = [u for u in texts if u.block == t.block]
        links.append(1 - (1 - P.LINKED) * sum(len(u.value.strip()) for u in block if u.node.link) / sum(len(u.value.strip()) for u in block))
    own = [r * f * k for r, f, k in zip(plain_ratios(texts), feature, links, strict=True)]
    mass = [n * s * s for n, s in zip(size, own, strict=True)]
    held = {x.number: sum(m for m, t in zip(mass, texts, strict=True) if x in chain(t.node)) for x in page.nodes}
    root = max((x for x in page.nodes if x.tag in P.CONTAINERS and held[x.number] >= P.HELD * sum(mass) * (1 - 1e-12)), key=lambda x: x.number)
    root = next((x for x in chain(root) if x.tag in P.CONTENT_TAGS and any(y.tag in tags for y in chain(x))), root)
    inside = [root in chain(t.node) for t in texts]
    most = max(f for f, i in zip(feature, inside, strict=True) if i)
    lent = sum(s * n for s, n, i in zip(own, size, inside, strict=True) if i) / sum(n for n, i in zip(size, inside, strict=True) if i)
    out = [max(s, lent * f / most) if i else s for s, f, i in zip(own, feature, inside, strict=True)]

    def least():
        return max(P.LEAST, P.SHARE * sum(s * s * n for s, n in zip(out, size, strict=True)) / sum(s * n for s, n in zip(out, size, strict=True)))

    content = [i for i, s in enumerate(out) if s >= least()]
    if content:
        first = content[0]
        while first > 0 and texts[first - 1].node.heading:
            first -= 1
        for i in range(first, content[-1]):
            if texts[i].node.heading:
                out[i] = max(out[i], lent * feature[i] / most * links[i])
    floor = least()
    chosen = {id(t) for t, s in zip(texts, out, strict=True) if s >= floor * (1 - 1e-12)}
    blocks = {}
    for t in page.texts:
        if not t.node.unread and (not t.value.strip() or id(t) in chosen):
            blocks.setdefault(t.block, []).append(t.value)
    return "\n".join(x for x in (" ".join("".join(b).split()) for _, b in sorted(blocks.items())) if x)


def random_page(rng):
    """A random tree of elements with random names and texts."""
    words = ["a", "word", "longer", "comma,", "stop.", "x" * 30, "&amp;"]

    def inside(depth):
        out = []
        for _ in range(rng.randint(1, 5)):
            if depth > 4 or rng.random() < 0.4:
                out.append(" ".join(rng.choices(words, k=rng.randint(0, 30))))
            else:
                tag = rng.choice(["div", "p", "section", "article", "ul", "li", "h2", "a", "nav", "footer", "main", "b", "table", "td"])
                attrs = rng.choice(["", "", " class='body'", " class='ad'", " class='comments'", " class='teaser'", " id='x'", " hidden"])
                out.append(f"<{tag}{attrs}>{inside(depth + 1)}" + (f"</{tag}>" if rng.random() < 0.9 else ""))
        return "".join(out)

    return f"<body>{inside(0)}</body>"


def test_plain_version():
    rng = random.Random(3)
    for source in [FULL, *(random_page(rng) for _ in range(300))]:
        assert main_text(source) == plain_text(source), source


def synthetic(n=None):
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()[:n]


def bare(source):
    """A page without names and without tags that say what an element is for."""
    return re.sub(r"<(/?)(?:nav|footer|article)\b", r"<\1div", source).replace('<div class="ad">', "<div>")


def test_scores_decide(monkeypatch):
    """Scores that are zero, turned round or drawn change what comes out of most pages."""
    pages, true, rng = synthetic(), P.scores, np.random.default_rng(1)
    want = [main_text(x) for x in pages]
    for other in (lambda p, t: 0 * true(p, t), lambda p, t: -true(p, t), lambda p, t: rng.random(len(t))):
        monkeypatch.setattr(P, "scores", other)
        assert sum(main_text(x) != w for x, w in zip(pages, want, strict=True)) > 0.8 * len(pages)


def test_ratios_without_names(monkeypatch):
    """Where no tag or name helps, the ratios find nearly all articles, lose no text, and other ratios find none."""
    pages = synthetic()
    want = [main_text(x) for x in pages]
    got = [main_text(bare(x)) for x in pages]
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.8 * len(pages)
    assert all(set(w.split("\n")) <= set(g.split("\n")) for g, w in zip(got, want, strict=True))
    rng = np.random.default_rng(1)
    monkeypatch.setattr(P, "ratios", lambda t: rng.random(len(t)))
    assert sum(main_text(bare(x)) != w for x, w in zip(pages, want, strict=True)) > 0.8 * len(pages)


def test_parts_of_an_article_named_like_furniture():
    page = f'<article><div class="article-header"><h1>Title here</h1></div>{BODY}<div class="search-tips"><p>Tips, for those who search.</p></div></article>'
    assert main_text(page) == "\n".join(["Title here", *STORY, "Tips, for those who search."])


def test_long_attributes_and_deep_paths():
    assert main_text(f"<article><p title=\"{'x' * 90_000}>\">yes</p></article>") == "yes"
    assert main_text('<a "' * 50_000 + "<article><p>end") == "end"
    deep = "<div>" * 500
    page = P.parse(f"<body><section>{deep}<p>one</p>{'</div>' * 500}</section><main>{deep}<p>two</p></main>")
    assert len({t.node.path for t in page.texts}) == 2  # equal ends, different paths
