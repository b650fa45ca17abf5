import numpy as np

from vitalstream.llm import pages

FIELD = pages.default_field()


def test_learns_pages_it_has_not_seen():
    writer, right, every = pages.PageWriter(1234), 0, 0
    for _ in range(200):
        blocks, labels = writer.labelled()
        right += sum(a == b for a, b in zip(FIELD.decode(blocks), labels, strict=True))
        every += len(labels)
    assert right / every >= 0.99


def test_viterbi_is_the_best_labelling():
    writer = pages.PageWriter(5)
    for _ in range(40):
        blocks, _ = writer.labelled()
        blocks = blocks[:8]
        e = FIELD.emissions(blocks)
        score = lambda y: sum(v for v, on in zip(e, y, strict=True) if on) + sum(FIELD.pairs[int(a), int(b)] for a, b in zip(y, y[1:], strict=False))  # noqa: B023,E731
        every = [[bool(k >> i & 1) for i in range(len(blocks))] for k in range(1 << len(blocks))]
        assert np.isclose(score(FIELD.decode(blocks)), max(map(score, every)))


def test_article_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy this now.</div>
<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div>
<article><h1>The  title &amp;\n more</h1><p>First <b>bold<p>Second&nbsp;one, caf&eacute; &#233;.<br>still</p><ul><li>Item one<li>Item two</ul><script>track()</script></article>
<div class="comments"><p>I liked this story a lot, thank you.</p></div><form><p>Your mail</p></form><footer>&copy; 2020 Site</footer></body></html>"""
    assert pages.main_text(page, FIELD) == "The title & more\nFirst bold\nSecond one, café é. still\nItem one\nItem two"


def test_broken_markup_ends():
    for s in (None, "", "<", "<<<>>>", "<p", "<!--", "text only", "<script>x", '<p class="a>' * 2000, "</p>" * 500, "<div>" * 3000 + "x", "&#x110000; &#0; &bogus;", "<p title='a>b'>c</p>"):
        assert isinstance(pages.main_text(s, FIELD), str)


def test_rows(spark):
    rows = [(1, "u", "<article><p>Long text of a page, in words.</p></article>", "z"), (2, None, None, "z"), (2, "v", "", "z"), (None, "w", "<nav><a href='x'>y</a></nav>", "z")]
    got = sorted(((r.page_id or -1), r.url, r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect() if r.url)
    assert got == [(-1, "w", "", 0), (1, "u", "Long text of a page, in words.", 30), (2, "v", "", 0)]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string"), FIELD).count() == 0


# Pages written by hand, unlike those of the generator: without an article element, with adverts, forms and comments inside.
# STORY and TABLE were misread at first and led to features by kind of part, so they guard these and measure nothing.
NEWS = """<html><body><div id="top-bar"><a href="/">Home</a> <a href="/x">World</a> <a href="/y">Sport</a></div><div class="wrapper"><div class="post-content"><h1>River levels fall after a dry spring</h1><p class="byline">By Ann Lee</p><p>The river that runs through the old town has fallen to its lowest level in twenty years, the water board said on Monday.</p><p>Farmers along its banks have been asked to take less water until the autumn rains arrive.</p><blockquote>We have not seen it this low since I was a child, one of them said.</blockquote><p>The board will meet again next week.</p></div><div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten ways to save water at home</a></li><li><a href="/2">Town hall to be sold</a></li></ul></div></div><div class="share-buttons"><a href="#">Share</a><a href="#">Tweet</a></div><div id="footer"><p>Copyright 2021 The Town Paper. All rights reserved.</p></div></body></html>"""
STORY = """<html><body><header><nav><a href="/">Start</a><a href="/a">Archive</a></nav></header><main><section class="story"><h2>A new bridge for the valley</h2><p>Work on the bridge is to begin in March and will take two years, engineers told the council.</p><p>It will carry two lanes and a path for bicycles, and replaces a ferry that has crossed here since 1890.</p><div class="advertisement"><p>Book your holiday today and save!</p></div><p>The cost is put at nine million.</p></section><section id="comments"><h3>Comments</h3><div class="comment"><p>Great news, we have waited long enough for this bridge.</p></div><div class="comment"><p>And who is going to pay for it all?</p></div></section></main><footer><p>Contact us | Imprint</p></footer></body></html>"""
TABLE = """<html><body><table><tr><td class="menu"><a href="/">Index</a><br><a href="/n">News</a></td><td class="text"><h1>Notes on sourdough</h1><p>Flour and water are left in a warm place until they begin to bubble, which takes about five days.</p><p>Feed the mixture every day with as much flour as it weighs.</p></td></tr></table><p class="legal">This site uses cookies. <a href="/p">Privacy policy</a></p></body></html>"""
ARTICLE = """<html><body><div class="cookie-banner"><p>We use cookies to give you the best experience.</p><button>Accept</button></div><article class="entry"><header><h1>How the clock tower was saved</h1></header><p>For thirty years the tower stood empty, its hands stopped at ten past four.</p><aside class="related"><h4>Related</h4><ul><li><a href="/q">Other towers</a></li></ul></aside><p>Last month a group of pupils wound it again.</p><form class="newsletter"><p>Sign up for our letter</p><input name="mail"><button>Send</button></form><p>It has kept good time since.</p><div class="tags"><a href="/t">clocks</a> <a href="/u">history</a></div></article></body></html>"""
WANT = {
    NEWS: """River levels fall after a dry spring
By Ann Lee
The river that runs through the old town has fallen to its lowest level in twenty years, the water board said on Monday.
Farmers along its banks have been asked to take less water until the autumn rains arrive.
We have not seen it this low since I was a child, one of them said.
The board will meet again next week.""",
    STORY: """A new bridge for the valley
Work on the bridge is to begin in March and will take two years, engineers told the council.
It will carry two lanes and a path for bicycles, and replaces a ferry that has crossed here since 1890.
The cost is put at nine million.""",
    TABLE: """Notes on sourdough
Flour and water are left in a warm place until they begin to bubble, which takes about five days.
Feed the mixture every day with as much flour as it weighs.""",
    ARTICLE: """How the clock tower was saved
For thirty years the tower stood empty, its hands stopped at ten past four.
Last month a group of pupils wound it again.
It has kept good time since.""",
}


def test_hand_written_pages_stay_right():
    assert [pages.main_text(p, FIELD) for p in WANT] == list(WANT.values())


def plain_text(html):
    """Another reading of a simple page: Python's own parser, one block for each p, li or heading of the article."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip, self.inside = [], 0, False

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside = True
            if tag in ("script", "style", "nav", "aside", "form", "footer"):
                self.skip += 1
            if tag in ("p", "li", "h1", "h2", "h3"):
                self.out.append([])

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False
            if tag in ("script", "style", "nav", "aside", "form", "footer"):
                self.skip -= 1

        def handle_data(self, data):
            if self.inside and not self.skip and self.out:
                self.out[-1].append(data)

    r = Reader()
    r.feed(html)
    return "\n".join(t for t in (" ".join("".join(x).split()) for x in r.out) if t)


def test_query_equals_another_reading_of_its_pages(spark, tmp_path):
    r = pages.random.Random(4)
    word = lambda: r.choice(["rain", "wind &amp; sun", "caf&#233;", "<b>bold</b> word", "a  b"])
    sentence = lambda: " ".join(word() for _ in range(r.randint(6, 30))) + "."
    rows = []
    for k in range(40):
        body = "".join(f"<{t}>{sentence()}</{t}>" for t in ["h1", *r.choices(["p", "p", "p", "h2"], k=r.randint(1, 9))])
        menu = "".join(f'<li><a href="/{j}">Item {j}</a></li>' for j in range(r.randint(1, 5)))
        rows.append((k, f"u{k}", f"<html><body><nav><ul>{menu}</ul></nav><article>{body}<script>var x = '<p>no</p>';</script></article><footer><p>&copy; {k} All rights reserved</p></footer></body></html>"))
    rows += [(90, None, None), (91, "u", ""), (91, "u", ""), (92, "long", f"<article>{'<p>One more line of the story is told here.</p>' * 20_000}</article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    from vitalstream.llm import queries

    got = sorted(((r.page_id, r.text, r.n_chars) for r in queries.op7_pages(spark, str(tmp_path)).collect()), key=lambda r: r[0])
    want = [(k, plain_text(h or ""), len(plain_text(h or ""))) for k, _, h in rows]
    assert got == want
