import re
import time
from html import unescape

from wordloom.llm import html_text
from wordloom.llm.queries import op5_html_text

SF = "/root/testdata/sf0.01"
main = html_text.main_text


def test_article_without_what_surrounds_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) "</p>";</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- c --><div class="ad">Buy
    now.</div><div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b>
    text.<br>more<p>Of.</p><div class="ad">inner advert</div><aside>sidebar words</aside><p>Last.</p>
    <form>Your name <input></form><section id="comments"><p>Reader says.</p></section></article>
    <div id="sidebar">links</div><footer>&copy; me</footer></body></html>"""
    assert main(page) == "Head & line\n\nFirst bold text. more\n\nOf.\n\nLast."


def test_page_without_marked_article():
    body = "".join(f"<p>{'word ' * 40}{i}</p><p>Of.</p>" for i in range(4))
    page = f"<body><div><a href=a>One</a> <a href=b>Two</a></div><div><p>tiny</p></div><footer>f</footer>{body}<nav>x</nav><p>y</p></body>"
    want = "\n\n".join(x for i in range(4) for x in (f"{'word ' * 40}{i}", "Of."))
    assert main(page) == want


def test_surges_decide_on_pages_with_article_elements():
    """The article element is a hint: it holds its regions together, but what
    is main text is decided by the curve."""
    long = [f"{'word ' * 40}{i}" for i in range(4)]
    body = "".join(f"<p>{x}</p>" for x in long)
    text = "\n\n".join(long)
    teaser = "<article><h2>Teaser</h2><p>Read on.</p></article>"
    assert main(f"<body>{teaser}<div>{body}</div>{teaser}</body>") == text
    assert main(f"<body>{teaser}<article>{body}</article>{teaser}</body>") == text
    # two halves of the text in elements of their own
    assert main(f"<main>{body}</main><p>by line</p><aside>x</aside><div>{body}</div>") == f"{text}\n\n{text}"
    # short lines between dropped elements of the article stay, those outside it go
    page = f"<p>by line</p><article>{body}<div class=ad>Buy.</div><nav>n</nav><p>Last.</p></article><p>Posted in x.</p>"
    assert main(page) == f"{text}\n\nLast."


def test_odd_pages():
    assert main("") == "" and main("<p>") == "" and main("<article></article>") == ""
    assert main("<article>a &lt; b &am &#233; &nbsp; x") == "a < b &am é x"
    assert main("<article><p>a</p><p>cut <b>bo") == "a\n\ncut bo"
    assert main("<article><p>a<script>var x = '<p>no</p>'") == "a"
    assert main("<article><p title='>'>a <x-y/>b</p></article>") == "a b"
    assert main("<article><p>5 < 6 > 4</p>") == "5 < 6 > 4"
    assert main("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>") == "one\n\ntwo\n\nc1\n\nc2"
    assert main("<article>" + "<p>same</p>" * 3 + "</article>") == "same\n\nsame\n\nsame"
    assert main("<p hidden>no</p><main><p>yes</p><p style='display: none'>no</p></main>") == "yes"


def test_hostile_markup_takes_linear_time():
    for piece in ('<a """""""', "<!--", "<p ", "</p", "<b a='", "<script>", "<i><p></i>", '"<'):
        t = time.time()
        main("<article>" + piece * 4000)
        assert time.time() - t < 20, piece


def test_deep_and_unmatched_markup_takes_linear_time():
    """Twice the page takes about twice the time."""
    def seconds(make, n):
        page = "<article>" + make(n)
        t = time.process_time()
        main(page)
        return time.process_time() - t
    shapes = [lambda n: "<b>" * n + "<p>x</p>" * n, lambda n: "<x-y>" * n + "</zz>" * n, lambda n: "<div>" * n + "</b>" * n,
              lambda n: "<i>" * n + "<li>x" * n, lambda n: "<table><tr><td>" * n + "</p>" * n, lambda n: "<a>" * n + "</a>" * n]
    for make in shapes:
        main(make(2000))
        short, long = (min(seconds(make, n) for _ in range(3)) for n in (8000, 16000))
        assert long < 3.2 * short + 0.2
        assert long < 10


def test_names_inside_articles():
    text = "<article><p>" + "word " * 40 + "</p>{}<p>Last.</p></article>"
    for name in ("share-price", "ad-hoc", "header_note", "social-science", "notice-of-motion", "menu-du-jour"):
        assert "inner" in main(text.format(f"<p class='x {name}'>inner</p>")), name
    for name in ("share", "share-buttons", "ad-300x250", "reader-comments", "comment-list", "cookie-notice", "inner-ad", "related_links"):
        assert "inner" not in main(text.format(f"<div id='{name}'><p>inner</p></div>")), name


def test_table_against_structure(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op5_html_text(spark, SF).collect()
    assert len(rows) == len(html)
    for r in rows:
        inner = html[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"<[^>]*>?", " ", b) for b in re.split("</?(?:p|h1)>", inner)]
        blocks = [" ".join(unescape(b).split()) for b in blocks]
        want = "\n\n".join(b for b in blocks if b)
        assert r.text == want and r.n_chars == len(want)


def test_hard_rows(spark):
    rows = [(1, None, None, 1), (2, "u", "", 2), (3, "u", "<article><p>x</p>", 3), (3, "u", "<article><p>x</p>", 3), (None, None, "<p>y", 4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_text.extract(pages).collect()))
    assert got == [(0, "", "y", 1), (1, "", "", 0), (2, "u", "", 0), (3, "u", "x", 1), (3, "u", "x", 1)]
    assert html_text.extract(pages.limit(0)).columns == ["page_id", "url", "text", "n_chars"]
    assert html_text.extract(pages.limit(0)).count() == 0
