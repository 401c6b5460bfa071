import html
import random
import re
import time

import pytest

from tests.conftest import SF_SMALL
from tidegrid.llm import main_text as m

CASES = [
    (None, ""), ("", ""), ("   ", ""), ("just words", "just words"),
    ("<article><h1>T</h1><p>a &amp; b&nbsp;c<p>d<br>e</article><footer>f</footer>", "T a & b c d e"),
    ("<nav>n</nav><div id=content><p>one <b>two</b>three</p></div><div class='ad'>x</div>", "one twothree"),
    ("<main><article><p>body text here</p><aside>no</aside><form>no</form><section class='comments'><p>no, no, no</p></section></article></main>", "body text here"),
    ("<body class='home'><div class='post-12 entry'><p>first part</p><script>var a='</p><p>';</script><style>p{}</style><p>second &lt;b&gt;</p></div>", "first part second <b>"),
    ("<div><header>no</header><p>yes</p><div class='cookie-notice'>no</div><div role=navigation>no</div><p hidden>no</p></div>", "yes"),
    ("<article><p>kept</p></article><article class='comment'><p>a very long comment of a reader, longer than the text</p></article>", "kept"),
    ("<article>the text<section class='comments'><article>of a reader, much longer than the text</article></section></article>", "the text"),
    ("<main><p>body</p><aside><article>related teaser, longer</article></aside></main>", "body"), ("<nav><article>links</article></nav><p>body</p>", "body"),
    ("<article>main</article><div id='comments'><article>a longer comment</article></div>", "main"), ("<footer><main>f</main></footer><div><p>d</p></div>", "d"),
    ("<div class='layout no-sidebar'><div class='post'><p>the story</p></div></div>", "the story"), ("<div class='post comments-open'><p>the story</p></div>", "the story"),
    ("<article><p>It rose. <span class='share-price'>At 5 euros.</span> It fell.</p></article>", "It rose. At 5 euros. It fell."),
    ("<article><header><h1>Title</h1><nav>no</nav></header><p>text</p><footer>no</footer></article>", "Title text"), ("<header><h1>Site</h1></header><p>text</p>", "text"),
    ("<main><article><p>one</p></article><article><p>two and more</p></article></main>", "one two and more"),
    ("<article><p>the text</p><div class='social-media-share'><a>one</a> <a>two</a></div><div class='social-cost'><p>of it all</p></div></article>", "the text of it all"),
    ("<div class='sidebar'><p>all that the page has</p></div>", "all that the page has"), ("<div class='siteHeader'>no</div><div id=AdSlot2>no</div><p>yes</p>", "yes"),
    ("<div><div class='p'><p>left</p></div></div><div><div class='p'><p>also</p></div></div>", "left also"), ("<article></article>", ""), ("<article class=promo>no</article><p>yes</p>", "yes"),
    ("<i><div>" + "<b>" * 50 + "</i>" * 50 + "kept</div>tail", "kept"), ("<p>" + "x" * 2_000_000 + "</p>", "x" * 2_000_000),
    ("<article><p>cut off <a href='x", "cut off"), ("<article><p title=\"a>b\">q</p><!-- c --><p>r</p>", "q r"), ("<article>x<!-- open", "x"),
    ("<div class=wrap><h1>Headline</h1><p class=lead>The lead.</p><div class=body><p>A long story that goes on and on for a while.</p></div></div>", "Headline The lead. A long story that goes on and on for a while."),
    ("<div class=w><div class=alpha><p>a longer first part of it</p></div><div class=beta><p>the rest</p></div></div>", "a longer first part of it the rest"),
    ("<div class=w><div class=alpha><p>all of the story</p></div><div class=more><a>one</a> <a>two</a> <a>three</a></div></div>", "all of the story"),
    ("<div class=w><div class=alpha><p>all of the story</p></div><div class=x>no paragraph</div></div>", "all of the story"),
    ("<div><h1>T</h1><div class=in><div class=p><p>left side</p></div><div class=p><p>right side</p></div></div></div>", "T left side right side"),
    ("<main><div class=t><h1>T</h1></div><div class=p><p>the text of it</p></div></main>", "T the text of it"),
    ("<article><p><a href=x>all of it a link</a></p></article>", "all of it a link"), ("<nav>menu<article><p>the text</p></article>", "the text"),
    ("<nav>menu<article>the text<nav>no</nav></article>", "the text"), ("<nav>menu</nav><p></p>", ""),
    ("<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, <button>press</button> the <object data=k>thing</object>.</p></article>", "If x=1, press the thing."),
    ("<article><p>short</p></article><div class=discussion><p>what readers say, at much greater length</p></div>", "short"),
    ("<article><p>a<div>b<span>c</div>d</article>", "a bc d"), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"), ("<article>1 < 2 & 3</article>", "1 < 2 & 3"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_pages(source, want):
    assert m.parsed(source or "").main([])[0] == want


def test_the_hosts_consensus_decides(spark):
    # on its own the odd page's long sidebar-like block would win; the other pages of the host say where the text is
    usual = "<div class='story x{k}'><p>the story of page {k} is told here at some length</p></div><div class='extra'><p>short</p></div>"
    odd = "<div class='story x77'><p>brief</p></div><div class='extra'><p>" + "a long list of other things " * 9 + "</p></div>"
    rows = [(k, "http://A.example.com:80/p", usual.format(k=k), "p") for k in range(9)] + [(9, "https://u@a.example.com?x", odd, "p"), (10, None, odd, "p"), (10, None, odd, "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    for bound in (1000, 0):
        got = sorted((r.page_id, r.text) for r in m.extract(df, bound=bound).collect())
        assert got[9] == (9, "brief") and got[10][1].startswith("a long list") and len(got) == 12
        assert all(t == f"the story of page {k} is told here at some length" for k, t in got[:9])
    assert m.extract(df.limit(0)).count() == 0


def test_given_pages_equal_a_direct_cut(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    rows = {r.page_id: r for r in m.extract(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda t: " " if re.match(r"</?(p|h1|br)", t[0]) else "", inner)
        assert rows[p.page_id].text == " ".join(html.unescape(plain).split()) and rows[p.page_id].n_chars == len(rows[p.page_id].text)


def _p(n, word):
    return "<p>" + " ".join(f"{word}{k}" for k in range(n)) + "</p>"


@pytest.mark.parametrize("shape", [
    "<div class=w><div class=part>{0}</div><div class=part>{1}</div></div>",
    "<div class='w x1'><div class='part p1'>{0}</div><div class=ad>no</div><div class='part p2'>{1}</div></div>",
    "<article><div><section><div>{0}</div></section><section><div>{1}</div></section></div></article>",
    "<main><div><div><section><div class=a>{0}</div></section><section><div class=b>{1}</div></section></div></div></main>",
    "<article><div><div class=lead><div><div>{0}</div></div></div><section><div><div>{1}</div></div></section></div></article>",
])
def test_split_and_nested_articles_are_whole(spark, shape):
    page = "<nav>no</nav><div class=other><p>short</p></div>" + shape
    want = lambda a, b: " ".join([*(f"a{k}" for k in range(a)), *(f"b{k}" for k in range(b))])
    parts = [(70, 30), (30, 70), (40, 60), (95, 5)]
    for a, b in parts:
        assert m.parsed(page.format(_p(a, "a"), _p(b, "b"))).main([])[0] == want(a, b)
    rows = [(k, "http://h/", page.format(_p(a, "a"), _p(b, "b"))) for k, (a, b) in enumerate(parts)]
    got = {r.page_id: r.text for r in m.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want(a, b) for k, (a, b) in enumerate(parts)}


@pytest.mark.parametrize("source", ["<b>" * 200_000 + "</i>" * 200_000 + "end", "<i><div>" + "<b>" * 200_000 + "</i>" * 200_000 + "end", "<div>" * 100_000 + "</p>" * 100_000 + "end"])
def test_badly_nested_pages_take_linear_time(source):
    began = time.time()
    assert m.parsed(source).main([])[0] == "end" and time.time() - began < 20


OUT_TAGS, KEPT_TAGS = ("nav", "aside", "footer", "form"), ("div", "section", "p", "b", "article", "table")


def _tree(rng, depth):
    """A random well-formed element as (tag, attributes, children); a child is an element or a word."""
    tag = rng.choice(OUT_TAGS + KEPT_TAGS * 3)
    names = rng.choice(["", "", "", " class='x y2'", " class='comments'", " id='ad'", " class='no-sidebar'", " hidden"])
    kids = [f"w{rng.randrange(10**6)}" if depth == 0 or rng.random() < 0.5 else _tree(rng, depth - 1) for _ in range(rng.randrange(1, 4))]
    if tag == "p":
        kids = [k for k in kids if isinstance(k, str)]
    return tag, names, kids


def _written(node):
    return node if isinstance(node, str) else f"<{node[0]}{node[1]}>" + "".join(map(_written, node[2])) + f"</{node[0]}>"


def _walked(node):
    """The text of a tree, its blocks apart, without what is left out."""
    if isinstance(node, str):
        return node
    tag, names, kids = node
    if tag in OUT_TAGS or "comments" in names or "'ad'" in names or "hidden" in names:
        return "" if tag == "b" else "\n"
    inner = "".join(map(_walked, kids))
    return inner if tag == "b" else f"\n{inner}\n"


@pytest.mark.parametrize("seed", range(60))
def test_random_trees_equal_a_walk(seed):
    rng = random.Random(seed)
    kids = [_tree(rng, 4) for _ in range(3)] + ["tail"]
    page = m.parsed("<main>" + "".join(map(_written, kids)) + "</main>")
    assert page.text("body>main") == " ".join("".join(map(_walked, kids)).split())


def test_a_host_that_keeps_headlines_outside_the_inner_box(spark):
    page = "<body><div class=top><a>x</a></div><div class=wrap><h1>Headline {0}</h1><p class=lead>Lead {0}.</p><div class=body><p>" + "Story {0} goes on. " * 20 + "</p></div></div></body>"
    df = spark.createDataFrame([(k, "http://h/" + str(k), page.format(k)) for k in range(6)], "page_id long, url string, html string")
    for r in m.extract(df).collect():
        assert r.text == f"Headline {r.page_id} Lead {r.page_id}. " + " ".join([f"Story {r.page_id} goes on."] * 20)


def test_many_boxes_side_by_side_take_linear_time():
    began = time.time()
    page = m.parsed("<div class=w>" + "<div class=a><p>one two</p></div><div class=b><p>x</p></div>" * 20_000 + "</div>")
    assert page.main([])[0].startswith("one two x one two x") and time.time() - began < 20


def test_ties_repeats_and_null_ids(spark):
    two = "<div class=b><p>same size</p></div><div class=a><p>size same</p></div>"
    df = spark.createDataFrame([(None, None, two), (None, None, two), (3, "http://h/", None)], "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in m.extract(df).collect()]
    assert sorted(got, key=str) == sorted([(None, "size same", 9), (None, "size same", 9), (3, "", 0)], key=str)
