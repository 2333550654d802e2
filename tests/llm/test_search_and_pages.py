"""Exact top-k search and page text."""

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from staylens.llm.html_text import BLOCK, RAW, blocks_of, extract_pages, extract_text
from staylens.llm.topk import search_cell, segment_statistics, top_k, top_k_queries


def brute(rows, k, every):
    ok = [(i, np.floor(256 * np.array(x, float)).astype(int)) for i, x in rows
          if i is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    out = set()
    for i, q in {(i, tuple(q)) for i, q in ok if i % every == 0}:
        found = sorted((-int(np.dot(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("dim,shard,block", [(64, 100, 4), (7, 50, 2), (1, 10_000, 512)])
def test_top_k_is_brute_force(spark, dim, shard, block):
    rnd = np.random.default_rng(dim)
    centers = rnd.normal(size=(5, dim))
    rows = [(i, (centers[i % 5] + 0.3 * rnd.normal(size=dim)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # equal vectors: ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = top_k(df, df.where("vec_id % 50 = 0"), shard_rows=shard, block_rows=block)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 50)


def test_top_k_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]),
            (8, [0.001, -0.001]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (100, None), (150, [2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<float>, id int, shard int")
    assert {tuple(r) for r in top_k_queries(df).collect()} == brute(rows, 5, 50)
    assert top_k_queries(df.where("false")).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [1e12, 1.0]), (1, [1.0, 1e12]), (2, [3.0, 5.0]), (3, [-100.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.score) for r in top_k_queries(df).where("query_id = 0").collect()}
    q = (256 * 10**12, 256)
    assert got == {(1, q[0] * 256 + q[1] * q[0]), (2, q[0] * 768 + 256 * 1280), (3, -q[0] * 25_600 + 256 * 256)}


def test_segment_statistics_bound_distances_from_below():
    rnd = np.random.default_rng(0)
    x, y = rnd.normal(size=(50, 30)), rnd.normal(size=(50, 30))
    exact, last = ((x - y) ** 2).sum(axis=1), np.zeros(50)
    for parts in (1, 4, 16, 30):
        d = segment_statistics(x, parts) - segment_statistics(y, parts)
        low = (d * d).sum(axis=1)
        assert (low <= exact + 1e-9).all()
        last = low
    assert last == pytest.approx(exact)


def test_bounds_prune_without_losing_any():
    rnd = np.random.default_rng(3)
    v = np.floor(256 * (rnd.normal(size=(2000, 64)) + 3 * rnd.normal(size=(2000, 1))))
    ids = np.arange(2000)
    for q, (_, found, score) in zip(range(5), search_cell(ids[:5], v[:5], ids, v, 5)):
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -s))[:5]
        assert found.tolist() == want.tolist() and score.tolist() == s[want].astype(int).tolist()


ARTICLE = "The house of the people is on the hill, and it was in the hands of a few who had been there for the summer. " * 3

PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head>
<body class="sidebar-left"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use the cookies of the site and it is for you.</div><!-- <p>not this</p> -->
<article class="post"><header class="entry-header"><h1>The &amp; title</h1></header><p>{ARTICLE}<p>Short.<br>One&nbsp;line
<b>bold</b></p><div class="share">Share <a href="#">here</a></div><form><p>Your name</p></form>
<ul><li>Item <a href="x">one</a> of the list</li></ul><section id="comments"><p>{ARTICLE}</p></section></article>
<aside><p>{ARTICLE}</p></aside><div class="ad">{ARTICLE}</div><footer>&copy; {ARTICLE}</footer></body></html>"""


def test_marked_article():
    whole = " ".join(ARTICLE.split())
    assert extract_text(PAGE).split("\n") == ["The & title", whole, "Short. One line bold", "Item one of the list"]


def test_unmarked_page_goes_by_words_and_neighbours():
    page = (f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>More of the news</a></div><h1>A headline</h1><p>{ARTICLE}</p>"
            f"<p>Short one.</p><p>{ARTICLE}</p><div><a href=4>Next</a></div><p>{'buy cheap pills now ' * 20}</p><p>Call us</p></body>")
    whole = " ".join(ARTICLE.split())
    assert extract_text(page).split("\n")[-3:] == [whole, "Short one.", whole]
    assert "pills" not in extract_text(page) and "Home" not in extract_text(page) and "Call" not in extract_text(page)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<article>a<b", "a"), ("<article><p>x &lt;b&gt; &am; &amp &#x41;", "x <b> &am; & A"),
    ("<article><p>a<!-- open <p>b", "a"), ("<article><p>a<script>if (1 < 2) '</p>'", "a"), ("<article><p title='>'>a</p>", "a"),
    ("<article><p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"), ("<article><p>a<br><br>b</p></article>", "a\nb"),
    ("<article><p>###$$$ 12345 %%%</p></article>", "###$$$ 12345 %%%"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ("<main><h1>t</h1><p>m</p></main><p>out of it</p>", "t\nm"), ("<article hidden><p>x</p></article><article><p>y</p></article>", "y")])
def test_awkward_pages(page, text):
    assert extract_text(page) == text


BROKEN = ["<a ", "<p title='", "<!--", "<div>", "&", "<script>", "<div", "<!x ", "</p ", "<script ", "a < b <c ", "</ul><div>", "</script ",
          "<b x='>'", '<b a="<i ', "a", "<p a", "<a=b ", "<?"]


@pytest.mark.parametrize("shape", BROKEN)
def test_broken_markup_stays_linear(shape):
    for page in (shape * 40_000, "<script>" + shape * 40_000, "<div>" * 20_000 + shape * 40_000 + "'>"):
        start = time.process_time()
        blocks_of(page)
        assert time.process_time() - start < 8


RUSSIAN = "Дом стоял на холме, и люди из деревни приходили туда каждое лето, когда было тепло и тихо. " * 4
CHINESE = "山上的房子很老，村里的人每年夏天都会去那里，因为那里很安静，也很凉快。" * 5


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE, "Huset låg på en kulle utanför byn där ingen bodde längre under vintern. " * 4])
def test_unmarked_pages_of_other_languages(text):
    whole = " ".join(text.split())
    page = (f"<body><div><a href=1>Главная</a> <a href=2>新闻</a></div><h1>Title</h1><p>{text}</p><p>{text}</p><p>Kort.</p><p>{text}</p>"
            f"<ul><li><a href=3>{whole[:60]}</a></li></ul><div class=footer>{text}</div></body>")
    assert extract_text(page).split("\n") == ["Title", whole, whole, "Kort.", whole]


def test_article_keeps_its_sections():
    whole = " ".join(ARTICLE.split())
    page = (f"<article><h1>T</h1><section class='legal'><p>{ARTICLE}</p></section><p><a href=x>{ARTICLE}</a></p>"
            f"<div class='menu'><p>Home</p></div><div class='comments'><p>{ARTICLE}</p></div><p>End</p></article>")
    assert extract_text(page).split("\n") == ["T", whole, whole, "End"]


class Splitter(HTMLParser):
    """A second way to the blocks of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.raw = [], [], 0

    def end(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.raw += tag in RAW
        if tag in RAW:
            self.parts.append(" ")
        elif tag in BLOCK:
            self.end()

    def handle_endtag(self, tag):
        self.raw -= tag in RAW
        if tag in BLOCK:
            self.end()

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)


def random_page(rnd, depth=0):
    out = []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.random()
        if kind < 0.4 or depth > 4:
            out.append(rnd.choice(["word", " two words ", "\n", "&amp; &lt;b&gt; &eacute;&#x41;", "x > y", "日本 ", "'\"", "&nbsp;a"]))
        elif kind < 0.5:
            tag = rnd.choice(["script", "style"])
            out.append(f"<{tag} a='1'>if (a &&  b) {{}} '</p>'</{tag}>")
        elif kind < 0.55:
            out.append("<!-- <p>no</p> -->")
        else:
            tag = rnd.choice(["div", "p", "b", "span", "li", "ul", "section", "td", "em", "h2"])
            attrs = rnd.choice(["", " class='x'", ' title="a > b"', " data-x=1", " hidden-x"])
            out.append(f"<{tag}{attrs}>{random_page(rnd, depth + 1)}</{tag}>")
    return "".join(out)


def test_blocks_are_those_of_a_second_parser():
    rnd = random.Random(12)
    for _ in range(400):
        page = random_page(rnd)
        parser = Splitter()
        parser.feed(page)
        parser.close()
        parser.end()
        assert [b.text for b in blocks_of(page)] == parser.blocks, page


def test_extract_pages(spark):
    rnd = random.Random(0)
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y"), (3, None, "<article><p>" + "é " * 70_000, "z")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_pages(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()), key=repr) == sorted(
        ((i, u, extract_text(h), len(extract_text(h))) for i, u, h, _ in rows), key=repr)
    assert extract_pages(df.where("false")).count() == 0
