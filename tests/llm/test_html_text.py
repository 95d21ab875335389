import html
import os
import random
import re
import time

import pytest

from weftline.llm import html_text
from weftline.llm.html_text import extract_main_text, main_text

A = "The first paragraph of the story, with commas, and words enough to count as text."
B = "A second paragraph follows, as long as the first one, and has more to say about it."
C = "Short end."
BODY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
WANT = f"{A}\n\n{B}\n\n{C}"
CHROME = (
    '<header class="site-header"><a href="/">Site</a> tagline of the site, long enough to look like text</header>'
    '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'
    '<div class="cookie-banner">We use cookies, and more cookies, to make it all better for you.</div>'
)
TAIL = (
    '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">A related story, with commas, and more</a></li></ul></aside>'
    '<section id="comments"><h2>Comments</h2><article class="comment"><p>I like this story, really, and I say so at length here, again and again.</p></article></section>'
    "<form><label>Your mail, please, to subscribe to all that we write</label><input><button>Go</button></form>"
    "<footer>&copy; 2024 Site, all rights reserved, in all countries.</footer>"
)


@pytest.mark.parametrize(
    "main",
    [
        f"<article>{BODY}</article>",
        f"<main>{BODY}</main>",
        f'<div id="content">{BODY}</div>',
        f'<div class="wrapper with-sidebar"><div class="post-content">{BODY}</div></div>',
        f'<div class="page"><article class="post">{BODY}<div class="share-buttons"><a href="#">Share</a></div></article></div>',
        f"<article><section><p>{A}</p></section><section><p>{B}</p><p>{C}</p></section></article>",
        f"<div><p>{A}<p>{B}<p>{C}</div>",
        f"<table><tr><td>{BODY}</td></tr></table>",
        f'<main><article>{BODY}</article><aside>Other, more, and more of it, for all who read on</aside></main>',
        f'<article><div class="ad">Buy, buy, buy this thing now, and be happy</div>{BODY}<ul><li><a href="/r">Read this too</a></li></ul></article>',
        f'<article><p style="display:none">hidden, hidden, hidden</p><p hidden>more that is hidden</p>{BODY}</article>',
        f"<article><p><b>{A}<br><p>{B}</p><p>{C}</p></article>",
        f"<div role='main'><div>{A}</div><div>{B}</div><div>{C}</div></div>",
    ],
)
def test_layouts(main):
    assert main_text(f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body>{CHROME}{main}{TAIL}</body></html>") == WANT


def test_headings_references_and_spaces():
    page = "<article><header><h1>A &amp; B</h1><p>By someone</p></header><p>x&nbsp;y\n\t z&#233;&#x41;&lt;b&gt; &am</p><p>one<br>two <a href='q>r'>link</a> <!-- <p>no</p> --> end</p><pre>a  b</pre><ul><li>i</li><li>j</li></ul></article>"
    assert main_text(page) == "A & B\n\nx y zéA<b> &am\n\none two link end\n\na b\n\ni\n\nj"


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("   ") == main_text("<html><head><title>x</title></head></html>") == ""
    assert main_text("just text, no tags") == "just text, no tags"
    page = f"<body>{CHROME}<article>{BODY}"
    assert main_text(page) == WANT
    for cut in range(len(page)):
        main_text(page[:cut])
    assert main_text(page + "<p>cut of<a href='x") == WANT + "\n\ncut of"
    assert main_text(page + "<script>if (a<b) {") == WANT
    assert main_text(page + "<!-- never closed") == WANT
    assert main_text("<div>" * 5000 + A) == A
    assert main_text("<article>" + f"<p>{A}</p>" * 3000 + "</article>") == "\n\n".join([A] * 3000)


def test_table(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x", 3), (1, "u", f"<article>{BODY}</article>", "x", 3), (None, None, None, None, None), (2, "v", "", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(map(tuple, extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract_main_text(pages.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/pages.parquet"), reason="no test data")
def test_given_pages_by_their_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 :]
        inner = inner.split("</article>")[0] if "</article>" in inner else re.sub(r"<[^>]*\Z", "", inner)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize(
    "page",
    [
        f"{CHROME}<div class='sidebar-right'><article>{BODY}</article></div>{TAIL}",
        f"{CHROME}<div class='sidebar-right'><div class='post'>{BODY}</div></div>{TAIL}",
        f"{CHROME}<div class='content-with-sidebar'><div>{BODY}</div></div>{TAIL}",
        f"<form id='aspnet'>{CHROME}<div class='main'><article>{BODY}</article></div>{TAIL}</form>",
        f"<form>{CHROME}<section id='sidebar-left'><main>{BODY}</main></section></form>{TAIL}",
        f"{CHROME}<div class='header-page'><div class='paywall'>{BODY}</div></div>{TAIL}",
        # what must still go
        f"{CHROME}<article>{BODY}</article><div class='sidebar'>{f'<p>{A}</p>' * 9}</div>{TAIL}",
        f"{CHROME}<div>{BODY}</div><div id='comments'>{f'<p>{A}</p>' * 9}</div>{TAIL}",
        f"{CHROME}<div>{BODY}</div><div class='cookie-consent'>{f'<p>{A}</p>' * 9}</div>{TAIL}",
        f"{CHROME}<div>{BODY}</div><div class='sidebar'><p>{A}</p></div><form><p>{A}</p></form>{TAIL}",
    ],
)
def test_wrappers_named_as_furniture(page):
    assert main_text(f"<html><body>{page}</body></html>") == WANT


LEAD = "The lead of the story, which says in brief, and well, what it is all about."
KEPT = {
    "a form around all": (f"<form id='aspnetForm'>{CHROME}<div class='main'>{BODY}</div>{TAIL}</form>", WANT),
    "a wrapper named widget": (f"{CHROME}<div class='widget-content'>{BODY}</div>{TAIL}", WANT),
    "the article's own header": (f"{CHROME}<article><div class='article-header'><h1>Title</h1><p>{LEAD}</p></div>{BODY}</article>{TAIL}", f"Title\n\n{LEAD}\n\n{WANT}"),
    "beside the article's text": (f"{CHROME}<div id='content'><div class='article-header'><h1>Title</h1><p>{LEAD}</p></div><div class='x'>{BODY}</div></div>{TAIL}", f"Title\n\n{LEAD}\n\n{WANT}"),
    "a share's price": (f"{CHROME}<article>{BODY}<p class='share-price'>It rose.</p></article>{TAIL}", f"{WANT}\n\nIt rose."),
    "ad hoc": (f"{CHROME}<article>{BODY}<p class='ad-hoc'>A remark.</p></article>{TAIL}", f"{WANT}\n\nA remark."),
    "a note on a search": (f"{CHROME}<article>{BODY}<p class='search-results-note'>A note.</p></article>{TAIL}", f"{WANT}\n\nA note."),
    "references": (f"{CHROME}<article>{BODY}<h2>References</h2><ul><li><a href='/1'>A first work</a></li><li><a href='/2'>A second</a>, 1999</li></ul></article>{TAIL}", f"{WANT}\n\nReferences\n\nA first work\n\nA second, 1999"),
    "a table of links and years": (f"{CHROME}<article>{BODY}<table><tr><td><a href='/1'>A first work, on this</a></td><td>1998</td></tr></table></article>{TAIL}", f"{WANT}\n\nA first work, on this\n\n1998"),
    "a comment that ends at once": (f"{CHROME}<article><!-->{BODY}<!---></article>{TAIL}<!-- x -->", WANT),
    "names that say nothing but furniture": (f"{CHROME}<article>{BODY}<p class='ad'>Buy.</p><p class='cookie-notice'>We use them.</p></article>{TAIL}", WANT),
}


@pytest.mark.parametrize("name", KEPT)
def test_what_names_and_links_may_not_take_away(name):
    page, want = KEPT[name]
    assert main_text(f"<html><body>{page}</body></html>") == want


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + A, "<p>" * 100_000 + A, "<div class='sidebar'>" * 30_000 + A, "<span hidden>" * 30_000 + A, "<div><p>x, y</p>" * 20_000, "<ul><li>" * 30_000 + A]
    + ["<div>" * 20_000 + "</p>" * 40_000 + A, "<div><table><td>" + "<ul>" * 20_000 + "</div>" * 40_000 + A, "<table><tr><td>" * 15_000 + A, "<main><section class='ad'>" * 15_000 + A, "<div>" * 20_000 + "<html>" * 40_000 + A],
    ids=range(11),
)
def test_time_is_in_proportion_to_the_page(page):
    began = time.process_time()
    assert A in main_text(page) or "x, y" in main_text(page)
    assert time.process_time() - began < 10


def test_points_against_a_walk_over_all_ancestors():
    rng = random.Random(1)
    for _ in range(30):
        page = "".join(rng.choice(["<div>", "<section>", "</div>", "</section>", f"<p>{A}</p>", f"<p><a href='x'>{B}</a>, and {C}</p>", "some text, loose", "<ul><li>one, two</li></ul>", "<h2>Head</h2>", "<table><tr><td>a, b</td></tr></table>"]) for _ in range(60))
        root = html_text.parse(page)
        kept = html_text._score(root)
        every, stack = [], [root]
        while stack:
            every.append(stack.pop())
            stack += [c for c in every[-1].children if isinstance(c, html_text.Node)]
        points, size = dict.fromkeys(every, 0.0), dict.fromkeys(every, 0)
        for node in every:
            whole, _, mine = html_text._own(node)
            above, weight = node, 1.0
            if node.name in ("p", "li", "td", "tr"):
                above = node.parent
            level = 0
            while above is not None:
                points[above] += mine * weight
                above, level = above.parent, level + 1
                weight = 0.5 if level == 1 else weight / 3
            above = node
            while above is not None:
                size[above] += len(whole)
                above = above.parent
        assert all(n.points == pytest.approx(points[n]) and n.size == size[n] for n in every)
        best = max(kept, key=html_text._worth)
        assert html_text._worth(best) == pytest.approx(max(points[n] * (1 - min(1, n.links / max(1, n.size))) for n in kept))
