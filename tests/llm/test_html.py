import html
import itertools
import math
import re

import pytest

from tallymill.llm import html_text
from tallymill.llm.html_blocks import blocks_of
from tallymill.llm.html_training import labelled_pages


@pytest.fixture(scope="module")
def model():
    return html_text.default_model()


def test_held_out_pages(model):
    right = total = 0
    for page, labels in labelled_pages(150, seed=99):
        found = model.labels(blocks_of(page))
        right, total = right + sum(a == b for a, b in zip(found, labels)), total + len(labels)
    assert right >= 0.97 * total


def test_viterbi_finds_the_best_of_all_sequences(model):
    for page, _ in labelled_pages(20, seed=4):
        blocks = blocks_of(page)[:9]
        scores = [model.bias + sum(model.weights.get(f, 0) for f in b.features) for b in blocks]

        def value(labels):
            moves = sum(model.transitions[a][b] for a, b in zip(labels, labels[1:]))
            return moves + sum(s for s, y in zip(scores, labels) if y)

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
        assert math.isclose(value(best), value(model.labels(blocks)))


def test_blocks():
    page = """<body><p>a &amp; b&nbsp;&lt;c&gt;<br>d<p class=x>e <i>f</i>g<!-- no <p> --><div>h<script>if (a<b) "</p>"</script>i</div>j
    <ul><li>k<li><a href="x>y">l</a></ul>3 < 4 <b title='it"s'>m</b><style>n"""
    assert [b.text for b in blocks_of(page)] == ["a & b <c> d", "e fg", "h i", "j", "k", "l", "3 < 4 m"]


ARTICLE = "<article><h1>Title &eacute;</h1><p><b>First one.<br><p>Second   one\n&copy; here.</p>%s</article>"
MAIN = "Title é\n\nFirst one.\n\nSecond one © here."


@pytest.mark.parametrize(
    "part",
    [
        "<nav><ul><li><a href='/a'>a</a></li><li><a href='/b'>b</a></li></ul></nav>",
        '<div class="ad">Buy this thing now. It is good.</div>',
        '<aside><h3>Related</h3><p>Another story that is long enough.</p></aside>',
        '<div class="cookie-notice">We use cookies. Accept them.</div>',
        '<form><label>Mail</label><input><button>Send</button></form>',
        '<section class="comments"><h3>Comments</h3><p>I think that this is wrong.</p></section>',
        "<footer>&copy; site &middot; Some words at the end.</footer>",
        "<header><p>Name of the site.</p></header>",
        "<script>var t = '<p>no text</p>';</script>",
    ],
)
def test_parts_that_are_no_main_text(model, part):
    page = "<html><head><title>T</title></head><body>{}<article>x</article></body></html>"
    for made in (page.format(part).replace("<article>x</article>", ARTICLE % ""), page.format("").replace("<article>x</article>", (ARTICLE % "") + part)):
        assert html_text.main_text(made, model) == MAIN


def test_sample_pages(spark, small, model):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = {r["page_id"]: r for r in html_text.extract_text(pages, ["page_id", "url"]).collect()}
    for row in pages.collect():
        inside = re.search("<article>(.*?)(</article>|$)", row["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub("<footer.*", "", inside, flags=re.S))
        texts = [" ".join(html.unescape(re.sub("<[^>]*>?", " ", p)).split()) for p in parts]
        got = found[row["page_id"]]
        assert got["text"] == "\n\n".join(t for t in texts if t) and got["n_chars"] == len(got["text"]) and got["url"] == row["url"]


def test_odd_pages(spark, model):
    rows = [(None, None, 1, "x"), (1, "", 1, "x"), (1, "plain", 1, "x"), (2, ARTICLE % ("<p>long one.</p>" * 20_000), 1, "x")]
    rows += [(3, "<" * 50_000, 1, "x"), (4, "<p " * 20_000 + '"', 1, "x"), (5, "<div>" * 20_000, 1, "x"), (6, "<script>" * 3000, 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, n_chars int, text string")
    found = html_text.extract_text(pages, ["page_id"]).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert max(r["n_chars"] for r in found) > 200_000
    assert html_text.extract_text(pages.where("false"), ["page_id"]).collect() == []


@pytest.mark.parametrize(
    "made, text",
    [
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"),
        ("<svg class=s><title>Drawing</title><text>Label</text></svg>", "Drawing Label"),
        ("<object data=a>instead</object>", "instead"),
        ("<noscript>without script</noscript>", "without script"),
        ("<iframe src=a>no frame</iframe>", "no frame"),
    ],
)
def test_text_of_embedded_elements_stays(model, made, text):
    page = "<html><body><nav><a href=a>a</a></nav><article><h1>Title here</h1><p>The first one %s goes on for some words more.</p><p>Second one.</p></article></body></html>"
    main = html_text.main_text(page % made, model)
    assert main == f"Title here\n\nThe first one {text} goes on for some words more.\n\nSecond one."
    unclosed = re.sub("</(math|svg|object|noscript|iframe)>", "", made)
    main = html_text.main_text(page % unclosed, model)
    assert main == f"Title here\n\nThe first one {text} goes on for some words more.\n\nSecond one."


def test_a_tag_ends_outside_its_quotes():
    json = "{&quot;a&quot;: '<p>no</p>'}>" * 100
    page = f'<div data-a="{json}" title=\'<b>"x"</b>\'>one</div><p title=it\'s>two</p><p a=" > three</p><p>four'
    assert [b.text for b in blocks_of(page)] == ["one", "two", "three", "four"]


def test_many_open_quotes_take_linear_time():
    import time

    for piece in ('<p a="', "<p a='x\" ", "<p =", '<p a="x>y', "<p a=b'>", "<a =\"'>"):
        began = time.process_time()
        blocks_of(piece * 40_000 + ">")
        assert time.process_time() - began < 10, piece


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<article><p>one<!--> two</p><p>three</p></article><p>x --> y</p>", ["one two", "three", "x --> y"]),
        ("<p>one<!---> two</p><p>three", ["one two", "three"]),
        ("<p>one<!-- c --!> two</p><p>three</p>", ["one two", "three"]),
        ("<p>one<!-- c -- > d --> two</p>", ["one two"]),
        ("<p>one<!----> two<!-- -> --> three</p>", ["one two three"]),
        ("<p>one<!-- never ended</p><p>two</p>", ["one"]),
        ("<p>one</> two</1 x> three < 4 <é> five</", ["one two three < 4 <é> five</"]),
        ("<p>one<!x> two<?y> three", ["one two three"]),
    ],
)
def test_comments_end_where_a_browser_ends_them(page, texts):
    assert [b.text for b in blocks_of(page)] == texts


# Written by hand, not by the generator that the model is trained on.
HAND_MADE = [
# table layout of the nineties
("""<html><head><title>t</title></head><body bgcolor=white><table width=100%><tr><td colspan=2><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></td></tr>
<tr><td width=150><a href=1>Archive</a><br><a href=2>Links</a><br><a href=3>Guestbook</a></td><td><h2>The old mill by the river</h2><p>The mill was built in 1843 and ground corn for the villages around it until the war came.</p><p>After that it stood empty, and only the owls knew its rooms, until a baker from the next town bought it.</p></td></tr>
<tr><td colspan=2><font size=1>Copyright 1999 The Mill Society. All rights reserved.</font></td></tr></table></body></html>""",
 ["The old mill by the river","The mill was built in 1843 and ground corn for the villages around it until the war came.","After that it stood empty, and only the owls knew its rooms, until a baker from the next town bought it."]),
# blog with main
("""<body><header><div class="logo">Ann's blog</div><nav><ul><li><a href="/">Start</a></li><li><a href="/about">About</a></li></ul></nav></header><main><article class="post"><h1>How I learned to bake bread</h1><p>For years my loaves came out flat, and nobody could tell me what I was doing wrong with them.</p><p>Then my neighbour showed me how to fold the dough, and from that day on every loaf rose as it should.</p><blockquote>Bread is patience you can eat, she said to me while we waited.</blockquote></article><section class="comments"><h3>2 comments</h3><div class="comment"><p>Great post, thank you!</p></div><div class="comment"><p>My bread is still flat, what now?</p></div></section></main><aside class="sidebar"><h4>Recent posts</h4><ul><li><a href="/1">Soup</a></li><li><a href="/2">Salad</a></li></ul></aside><footer>Powered by software. <a href="/privacy">Privacy</a></footer></body>""",
 ["How I learned to bake bread","For years my loaves came out flat, and nobody could tell me what I was doing wrong with them.","Then my neighbour showed me how to fold the dough, and from that day on every loaf rose as it should.","Bread is patience you can eat, she said to me while we waited."]),
# news with ad and related
("""<body><div id="cookie-banner" class="notice">We use cookies. <button>Accept</button></div><div id="menu"><a href=a>Politics</a> <a href=b>Sport</a> <a href=c>Weather</a></div><div id="content"><h1>Council votes for the new bridge</h1><p>The council decided on Monday evening to build the bridge that the town has talked about for twenty years.</p><div class="ad">Advertisement: buy two tyres, get two free</div><p>Work is to begin in spring, and the mayor hopes that the first cars will cross the river before the next election.</p><ul><li>The bridge will cost eleven million.</li><li>It will carry two lanes and a path for bicycles.</li></ul><div class="related"><h3>Related</h3><a href=x>The old ferry stops</a> <a href=y>Traffic in town</a></div></div><div id="footer">Imprint | Terms of use | Contact</div></body>""",
 ["Council votes for the new bridge","The council decided on Monday evening to build the bridge that the town has talked about for twenty years.","Work is to begin in spring, and the mayor hopes that the first cars will cross the river before the next election.","The bridge will cost eleven million.","It will carry two lanes and a path for bicycles."]),
# plain page
("""<html><body><h1>Notes on the tides</h1><p>The moon pulls the water towards it, and the earth turns beneath the two hills that this makes.</p><p>So most coasts see two high waters a day, a little later every day than on the day before it.</p></body></html>""",
 ["Notes on the tides","The moon pulls the water towards it, and the earth turns beneath the two hills that this makes.","So most coasts see two high waters a day, a little later every day than on the day before it."]),
# documentation
("""<body><nav class="toc"><ol><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ol></nav><article><h1>Reading files</h1><p>To read a file, open it first and keep the handle for as long as you need the data in it.</p><pre>handle = open(name)</pre><p>When you are done, close the handle, as the system allows only so many of them at a time.</p></article><form action="/s"><input name=q><button>Search</button></form><footer><p>Edit this page</p></footer></body>""",
 ["Reading files","To read a file, open it first and keep the handle for as long as you need the data in it.","handle = open(name)","When you are done, close the handle, as the system allows only so many of them at a time."]),
]


def test_pages_written_by_hand(model):
    for page, wanted in HAND_MADE:
        blocks = blocks_of(page)
        assert [b.text for b, label in zip(blocks, model.labels(blocks)) if label] == wanted
