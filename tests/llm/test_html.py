"""Extraction of pages, against a brute-force version over whole hosts."""

import random
import re
from collections import defaultdict

import pytest

from spanloom.llm import html

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav>Home Menu</nav><div class="cookie-banner">Accept all cookies</div>
<article><h1>Head &amp; more</h1><p>One  two<br>three</p><script>x()</script><p>a &lt; b <b>bold</b></p><div class="comments">no</div></article><footer>end</footer></body></html>"""


def test_page_blocks():
    assert html.parsed(PAGE) == (True, ["Head & more", "One two three", "a < b bold"])
    assert html.blocks_of("") == [] and html.blocks_of("<p") == []
    assert [t for _, t in html.blocks_of("a < b<p>c")] == ["a < b", "c"]
    kept = '<article><h1 class="entry-header">A</h1><p class="share-price">B</p><div class="form-of-life">C</div><section id="comment-on-law">D</section><figure><figcaption>E</figcaption></figure><p><math><mi>x</mi></math></p></article>'
    assert html.parsed(kept) == (True, ["A", "B", "C", "D", "E", "x"])
    dropped = '<main><p>A</p><div class="x ad-slot">B</div><aside>C</aside><form><p>D</p></form><ul role="navigation"><li>E</ul><div id=sidebar>F</div></main><p>G</p>'
    assert html.parsed(dropped) == (True, ["A"])


def brute(pages):
    """{page_id: text} by counting every run of LEAST tokens over all distinct pages of a host."""
    made = {i: (re.match(r"\w+://([^/?#]*)", url or ""), html.parsed(page or "")) for i, url, page in pages}
    made = {i: ((m[1].lower() if m else ""), (a, tuple(b))) for i, (m, (a, b)) in made.items()}
    hosts = defaultdict(set)
    for host, page in made.values():
        hosts[host].add(page)

    def tokens(page):
        out = []
        for j, block in enumerate(page[1]):
            out += ([("\n", -1)] if j else []) + [(t, j) for t in block.split(" ")]
        return out

    n, k = {}, html.LEAST
    for host, distinct in hosts.items():
        for page in distinct:
            t = [x for x, _ in tokens(page)]
            for run in {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}:
                n[host, page[0], run] = n.get((host, page[0], run), 0) + 1
    out = {}
    for i, (host, page) in made.items():
        t, gone = tokens(page), set()
        for a in range(len(t) - k + 1):
            if n[host, page[0], tuple(x for x, _ in t[a : a + k])] >= max(html.PAGES[page[0]], html.SHARES[page[0]] * len(hosts[host]) - 1e-9):
                gone.update(range(a, a + k))
        kept = []
        for j, block in enumerate(page[1]):
            own = [a for a, (_, b) in enumerate(t) if b == j]
            rest = block if page[0] else " ".join(t[a][0] for a in own if a not in gone)
            if rest and not set(own) <= gone:
                kept.append(rest)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("cohort_bytes", [2 << 20, 4000])
def test_hosts_against_brute_force(spark, cohort_bytes):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["ka", "lo", "mi", "nu", "pe"]) + str(rng.randrange(9)) for _ in range(n))
    shared = [say(rng.randrange(3, 20)) for _ in range(12)]
    rows = []
    for i in range(260):
        host = rng.choice(["a.example", "A.example", "b.example", "c.example"])
        blocks = [rng.choice(shared) if rng.random() < 0.5 else say(rng.randrange(1, 15)) for _ in range(rng.randrange(1, 8))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        rows.append((i, f"http://{host}/{i}", f"<nav>x</nav><article><p>{shared[0]}</p>{body}</article>" if host.startswith("c") else f"<body><div>{body}</div></body>"))
    rows += [(1000 + i, f"http://a.example/{i}", rows[5][2]) for i in range(40)] + [(2000, None, None), (2001, "odd", "")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), cohort_bytes).collect()}
    assert got == brute(rows)


def test_query_against_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    found = html.op5_html_extraction(spark, sf_dir).collect()
    assert {r.page_id: r.text for r in found} == brute(pages) and all(r.n_chars == len(r.text) for r in found)


def test_template_without_semantic_markup(spark):
    """One host of 600 pages, dealt into several cohorts: what all pages have goes, what a page says stays."""
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    top = "".join(f"<div>{x}</div>" for x in ("Home", "About us", "Products and prices", "Contact", "Write to our editors"))
    end = "<div>All rights of this fine site are reserved by its many owners</div>"
    own = [[say(40), say(25)] for _ in range(600)]
    rows = [(i, f"http://h.example/{i}", f"<body>{top}<div>{a}</div><div>{b}</div>{end}</body>", "x", 3) for i, (a, b) in enumerate(own)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, part int"), 30_000).collect()}
    assert got == {i: f"{a}\n{b}" for i, (a, b) in enumerate(own)}


def test_odd_rows(spark):
    long = "<p>" + "many words here " * 100_000 + "</p>"
    rows = [(1, None, None), (2, "http://a/1", long), (2, "http://a/1", long), (None, "http://a/1", "<p>null id</p>"), (3, "http://a/2", "<article>" + "<b>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, len(r.text), r.url) for r in html.extract(pages).fillna("", ["url"]).collect())
    assert got == [(0, 7, "http://a/1"), (1, 0, ""), (2, len("many words here " * 100_000) - 1, "http://a/1"), (2, len("many words here " * 100_000) - 1, "http://a/1"), (3, 4, "http://a/2")]
    assert html.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<article><header><h1>Title</h1></header><p>main</p></article>", "Title\nmain"),
    ("<header><h1>Site</h1></header><article><p>main</p><footer>by us</footer></article>", "main"),
    ('<article><p>main</p><article class="comment"><p>nice</p></article></article>', "main"),
    ('<article><p>main</p><div class="comment">nice</div></article>', "main"),
    ('<article><p>main</p><section id="reader-comments"><p>nice</p></section></article>', "main"),
    ('<article><p>main</p><ul class="commentlist"><li>nice</li></ul></article>', "main"),
    ('<article><p class="widget">A widget</p><p>and a <span class="banner">banner</span>, <a class="comment">noted</a></p></article>', "A widget\nand a banner, noted"),
    ('<article><p>main</p><div class="social">share</div><div role="complementary">more</div></article>', "main"),
    ("<article><p>a &amp;amp; b &am<b>p;</b> c &lt;i&gt;</p></article>", "a &amp; b &amp; c <i>"),
    ('<div class="comment">nice</div><p class="notice">note</p><p>main</p>', "main"),
])
def test_what_the_article_is(page, text):
    """From the contract, not from the parser's own lists."""
    assert "\n".join(html.parsed(page)[1]) == text
