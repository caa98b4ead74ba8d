import html
import math
import random
import re

import pytest

from docflow.llm import htmltext


def expected(page):
    """The article of this corpus' template, by plain patterns."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
    return "\n".join(x for x in texts if x)


def test_query_matches_the_template(spark):
    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = htmltext.op7_html_extraction(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["url"], r["text"]) == (pages[r["page_id"]]["url"], expected(pages[r["page_id"]]["html"]))
        assert r["n_chars"] == len(r["text"])


LONG = "Some words, quite a few of them, that make a sentence. And another one, as long as it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<!-- never closed " + "x" * 1000, ""),
        ("<script>var a = '<p>no</p>'", ""),
        (f"<p>{LONG}", LONG),
        (f"<body><header><h1>Site</h1></header><main><h2>T</h2><p>{LONG}<p>End.</main>", f"T\n{LONG}\nEnd."),
        (f"<article><header><h1>T</h1><p>By me</p></header><p>{LONG}</p></article>", f"T\n{LONG}"),
        (f"<article><p>{LONG}</p><section id='comments'><p>{LONG}</p></section></article>", LONG),
        (f"<article><p>{LONG}</p><form><p>Mail: <input></p></form><aside>{LONG}</aside></article>", LONG),
        (f"<div class=cookie-notice><p>{LONG}</p></div><div><p>{LONG}</p></div>", LONG),
        (f"<article><p>a&nbsp;b &lt;c&gt; &amp;amp; &#233;\n\n d<br>e</p><p>{LONG}</p></article>", f"a b <c> &amp; é d e\n{LONG}"),
        (f"<nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><p>{LONG}</p><footer>{LONG}</footer>", LONG),
        (f"<article><ul><li>{LONG}<ul><li>in</ul><li>out</ul></article>", f"{LONG}\nin\nout"),
        (f"<article><p title='a > b'>{LONG}</p></article>", LONG),
        ("<article><table><tr><td>a<td>b<tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ],
)
def test_pages(page, text):
    assert htmltext.main_text(page) == text


def test_long_pages():
    assert htmltext.main_text("<article>" + "<p>ab" * 50_000 + "</article>") == "\n".join(["ab"] * 50_000)
    assert htmltext.main_text("<" * 20_000) == "<" * 20_000
    assert len(htmltext.main_text("<div>" * 2_000 + LONG)) == len(LONG)
    assert htmltext.main_text('<a b="' * 2_000) is not None


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x y z.</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text")
    assert sorted((r["text"], r["n_chars"]) for r in htmltext.extract(pages).collect()) == [("", 0), ("", 0), ("x y z.", 6)]
    assert htmltext.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{LONG}</p><div><span>Buy now</span></div><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p></article><article><p>{LONG} 2</p></article>", f"{LONG}\n{LONG} 2"),
        (f"<body><p>{LONG}</p><main><p>{LONG} 2</p></main><div><p>Hot</div></body>", f"{LONG}\n{LONG} 2"),
    ],
)
def test_paths_are_thresholded_with_an_article(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(
    "mark", ["section id='related-work'", "section id=search-trees", "div class=social-impact", "section id=legal", "div class=legal"]
)
def test_sections_survive_their_names(mark):
    page = f"<article class='post tag-news hentry'><h1 id=search>T</h1><p>{LONG}</p><{mark}><h2 id=legal>U</h2><p>{LONG}</p></article>"
    assert htmltext.main_text(page) == f"T\n{LONG}\nU\n{LONG}"


def test_frames_still_lose():
    page = f"<div class='ad box'><p>{LONG}</div><article><p>{LONG}</p><div class=post-comments><p>{LONG}</div></article>"
    assert htmltext.main_text(page) == LONG


def plain_ratios(rows):
    """Fused ratios from (path, text, linked characters) of a page's blocks, sum by sum."""
    own = lambda p: [(t, k) for q, t, k in rows if q == p]
    raw = [
        (
            sum(max(0, len(t) - k) for t, k in own(p)) / len(own(p)),
            sum(len(htmltext.PUNCTUATION.findall(t)) for t, _ in own(p)) / len(own(p)),
        )
        for p, _, _ in rows
    ]
    out = []
    for path, _, _ in rows:
        parts = []
        for k in (0, 1):
            total = 0.0
            places = [i for i, r in enumerate(rows) if r[0] == path]
            for i in places:
                near = [(j, math.exp(-((j - i) ** 2) / (2 * htmltext.SIGMA**2))) for j in range(i - 2, i + 3) if 0 <= j < len(rows)]
                total += math.sqrt(raw[i][k] * sum(w * raw[j][k] for j, w in near) / sum(w for _, w in near))
            parts.append(total / len(places))
        out.append(parts[0] * (1 + parts[1]))
    return out


def test_path_ratios_against_plain_sums(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(25).collect()]
    pages.append(f"<div><p>{LONG}</p><p>a</p><ul><li><a href=x>links only</a><li>b, c.</ul></div><div><p>{LONG}</div>")
    for page in pages:
        blocks = htmltext.blocks_of(page)
        want = plain_ratios([(b.element.path, b.text, b.linked) for b in blocks])
        assert htmltext.path_ratios(blocks) == pytest.approx(want)


@pytest.mark.parametrize("box", ["div id=content class=no-sidebar", "div class='main legal'", "section class=post", "td"])
def test_pages_without_an_article(box):
    tag = box.split()[0]
    page = f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><{box}><h1>T</h1><p>{LONG}</p><p>{LONG}</p></{tag}><div><a href=c>More</a></div>"
    assert htmltext.main_text(page) == f"T\n{LONG}\n{LONG}"


SHORT = "Short note."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{LONG}</p><div class=callout><p>{SHORT}</p></div></article>", f"{LONG}\n{SHORT}"),
        (f"<article><p>{LONG}</p><section><h2>Parts</h2><ul><li>one<li>two</ul></section></article>", f"{LONG}\nParts\none\ntwo"),
        (f"<article><p>{LONG}</p><div class=table-wrap><table><tr><td>a<td>b</table></div></article>", f"{LONG}\na\nb"),
        (f"<article><section><p>{LONG}</p><p>{LONG}</p></section><section id=legal><p>{SHORT}</p></section></article>", f"{LONG}\n{LONG}\n{SHORT}"),
        (f"<div id=content><section><p>{LONG}</p></section><section><p>{LONG}</p></section><section><p>{SHORT}</p></section></div>", f"{LONG}\n{LONG}\n{SHORT}"),
        (f"<body><div class=wrap><h1>T</h1><div class=text><p>{LONG}</p><div class=note-box><p>{SHORT}</p></div></div><div>All rights</div></div>", f"T\n{LONG}\n{SHORT}"),
        (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <canvas>so</canvas> <object>it</object>. {LONG}</p></article>", f"Let x=1 be so it. {LONG}"),
        (f"<main><h1>T</h1><article><p>{LONG}</p></article><div><p>{SHORT}</p></div></main>", f"T\n{LONG}"),
        (f"<main><article><p>{LONG}</p></article><article><p>{LONG} 2</p></article></main>", f"{LONG}\n{LONG} 2"),
        (f"<article><p>{LONG}</p><ol><li><a href=a>Source one</a><li><a href=b>Source two</a></ol></article>", f"{LONG}\nSource one\nSource two"),
        (f"<article><p>{LONG}</p><figure><img src=x><figcaption>{SHORT}</figcaption></figure><pre>x = 1\ny</pre><blockquote>Said</blockquote></article>", f"{LONG}\n{SHORT}\nx = 1 y\nSaid"),
        (f"<article><dl><dt>Term<dd>{LONG}</dl><hr><p>End</p></article>", f"Term\n{LONG}\nEnd"),
        (f"<div class=modal><article><p>{LONG}</p></article></div>", LONG),
    ],
)
def test_articles_are_kept_whole(page, text):
    assert htmltext.main_text(page) == text


MORE = " ".join([LONG] * 4)


@pytest.mark.parametrize(
    "frame",
    [
        "section class=comments", "section id=comments", "div class=ad", "div class='box ad'", "div class=related", "div class=cookie-notice", "div class=related-posts",
        "div id=cookie-banner", "div class=post-comments", "ul class=share", "div class=newsletter-signup", "div role=complementary", "div hidden", "aside", "div class=sidebar",
    ],
)
@pytest.mark.parametrize("place", ["in", "before", "after"])
def test_frames_lose_however_long(frame, place):
    tag = frame.split()[0]
    box = f"<{frame}><p>{MORE}</p><div><p>{MORE}</p></div></{tag}>"
    page = {"in": f"<article><p>{LONG}</p>{box}</article>", "before": f"{box}<article><p>{LONG}</p></article>", "after": f"<div><p>{LONG}</p></div>{box}"}[place]
    assert htmltext.main_text(f"<body>{page}</body>") == LONG


def test_comments_that_are_articles_lose():
    page = f"<article><p>{LONG}</p><section id=comments><article class=comment><p>{MORE}</p></article></section></article>"
    assert htmltext.main_text(page) == LONG
    page = f"<article><p>{LONG}</p></article><div class=comments><article><p>{MORE}</p></article></div>"
    assert htmltext.main_text(page) == LONG


def plain_text(page):
    """Choice and growth read plainly: every question is asked of whole chains of elements."""
    blocks = htmltext.blocks_of(page)
    chain = lambda b: [e for e in htmltext._chain(b.element)]
    articles = lambda b: [e for e in chain(b) if e.tag in ("article", "main")]
    frames = lambda es: [e for e in es if e.frame is e]
    free = any(articles(b) and not frames(chain(b)[: chain(b).index(articles(b)[0]) + 1]) for b in blocks)

    def counts(frame, es):
        held = any(frame in chain(b) and any(chain(b).index(a) >= chain(b).index(frame) for a in articles(b)) for b in blocks)
        return any(e.tag in ("article", "main") for e in es[: es.index(frame)]) or free or not held

    live = [b for b in blocks if not any(counts(f, chain(b)) for f in frames(chain(b)))] or blocks
    if not live:
        return ""
    scores = [s * b.element.weight * (2 if articles(b) else 1) for b, s in zip(live, htmltext.path_ratios(live))]
    content = [b for b, s in zip(live, scores) if s >= 0.2 * max(scores)] if max(scores) > 0 else [b for b in live if articles(b) and b.element.weight == 1]
    outer = ("", "html", "body")
    regions = []
    for top in {id(e): e for b in content for e in [next((e for e in chain(b) if e.tag not in outer), None)] if e is not None}.values():
        chains = [chain(b) for b in content if top in chain(b)]
        meet = [e for e in chains[0] if all(any(e is x for x in c) for c in chains)]
        inside = [e for e in meet if e.tag in ("article", "main")]
        parts = [e for e in meet if e.tag in htmltext.PARTS and e.tag not in outer]
        regions.append((inside or parts or meet)[-1])
    within = [any(r in chain(b) for r in regions) for b in live]
    start = within.index(True) if True in within else 0
    out = []
    for i, b in enumerate(live):
        heading = b.element.tag in htmltext.HEADINGS
        if not within[i]:
            wide = articles(b) and any(articles(b)[-1] in chain(c) for c in content)
            near = any(not r.inside and r.parent.tag not in outer and r.parent in chain(b) for r in regions) and i < start
            if b not in content and not (heading and b.element.weight == 1 and (wide or near)):
                continue
        elif b not in content:
            label = b.element.tag in htmltext.BARE and not htmltext.PUNCTUATION.search(b.text)
            if label or (not articles(b) and len(b.text) <= b.linked):
                continue
        if heading or not any(e.tag == "header" for e in chain(b)):
            out.append(b.text)
    return "\n".join(out)


def test_choice_and_growth_against_a_plain_version():
    rng = random.Random(4)
    names = ["", "", "", " class=ad", " class=comments", " id=legal", " class=related", " class=no-sidebar", " class=search-trees", " id=sidebar", " class=tags"]

    def made(depth):
        tag = rng.choice(["div", "section", "article", "main", "ul", "p", "p", "h2", "td", "header"] if depth else ["body"])
        text = rng.choice([LONG, LONG, SHORT, "Buy now", "<a href=x>link only</a>", f"{LONG} <a href=y>with a link</a>"])
        inner = text if depth > 3 or tag in ("p", "h2") else "".join(made(depth + 1) for _ in range(rng.randrange(4))) + rng.choice(["", "", text])
        return f"<{tag}{rng.choice(names)}>{inner}</{tag}>"

    for _ in range(400):
        page = made(0)
        assert htmltext.main_text(page) == plain_text(page), page
