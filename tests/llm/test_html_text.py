import html
import re

from pyspark.sql import functions as F

from stratum.llm.html_text import extract_pages, main_text
from stratum.session import load
from tests.conftest import SF_SMOKE

LONG = "This paragraph has some length, a few commas, and no links, so it counts. "


def test_parts_left_out():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site name</h1></header>
    <nav><ul><li><a href=/>Home</a></ul></nav><div id="content"><h2>Head&shy;line</h2><p>{LONG * 3}</p><p>See <a href=x>this</a>,
    &amp; that.</p><script>document.write("</p>")</script><div class="comments"><p>{LONG}</p></div></div>
    <div class="SideBar"><p>{LONG}</p></div><form><label>Mail</label><input></form><div class="cookie-notice">We use cookies, ok.</div>
    <div style="display: none">hidden</div><div hidden>hidden</div><aside>{LONG}</aside><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == f"Head\xadline {(LONG * 3).strip()} See this, & that."


def test_broken_markup_and_white_space():
    assert main_text("<article><h1>A</h1><p><b>x<br>y<p>z\n\t z</article><footer>f") == "A x y z z"
    assert main_text("<p>a<b>b</b>c &nbsp;d <!-- no --> e <img alt='>'>f</p>") == "abc d e f"
    assert main_text("<div><p>kept<div") == "kept"
    assert main_text("<article><table><tr><td>1<td>2<tr><td>3</table><pre> a\n b </pre></article>") == "1 2 3 a b"
    assert main_text("<nav><a>m</a><article><p>text</p></article>") == "text"


def test_nothing_to_take():
    for page in (None, "", "   ", "<html><body></body></html>", "<script>x", "<nav>menu</nav><footer>f</footer>", "<"):
        assert main_text(page) in ("", "<")


def test_article_over_a_part_of_it():
    page = f"<main><article><h1>Title</h1><div class=body><p>{LONG * 4}</p></div></article><article class=related><p>Other, short.</p></article></main>"
    assert main_text(page) == f"Title {(LONG * 4).strip()}"


def test_names_in_longer_classes_and_anchors_leave_nothing_out():
    body = LONG.strip()
    parts = (f'<h2 id="related-work">Work</h2><section id="social-impact"><p>{LONG}</p></section><p id="notice-periods">{LONG}</p>'
             f'<p>A <span class="comment">b</span>.</p><div class="overflow-hidden"><p>{LONG}</p></div>')  # fmt: skip
    want = f"{body} Work {body} {body} A b. {body}"
    assert main_text(f"<article><p>{LONG}</p>{parts}</article>") == want
    page = f'<body><div class="layout has-sidebar"><main><article><p>{LONG}</p>{parts}</article></main><div class="sidebar"><p>{LONG}</p></div></div>'
    assert main_text(page) == want
    assert main_text(f'<div id="content"><p>{LONG}</p>{parts}</div>') == want.replace("A b.", "A .")


def test_names_never_leave_out_the_article_or_most_of_the_page():
    body = LONG.strip()
    for name in ("sidebar", "modal overlay", "hidden", "main-menu"):
        assert main_text(f'<div class="{name}"><article><h1>T</h1><p>{LONG}</p></article></div><div><p>Else.</p></div>') == f"T {body}"
        assert main_text(f'<div class="{name}"><p>{LONG}</p><p>{LONG}</p></div><div class="ad"><p>Buy.</p></div>') == f"{body} {body}"
    assert main_text(f'<article><h1>T</h1><div class="notice"><p>{LONG * 3}</p></div></article>') == f"T {(LONG * 3).strip()}"
    assert main_text(f'<span class="notice">{LONG}</span><span class="ad">Buy</span>') == body


def test_named_parts_stay_out_however_long():
    comments = "".join(f'<li class="comment"><article class="comment-body"><p>{LONG * 3}</p></article></li>' for _ in range(5))
    cards = f'<div class="related-posts"><article class="card"><p>{LONG}</p></article></div>'
    page = f'<main><article class="post"><h1>T</h1><p>{LONG * 2}</p><div class="share">Share</div></article>{cards}<div id="comments" class="comments-area"><ol>{comments}</ol></div></main>'
    assert main_text(page) == f"T {(LONG * 2).strip()}"


def test_lists_of_links_in_the_article_stay():
    names = [f"Reference number {i}" for i in range(12)]
    items = "".join(f"<li><a href=/{i}>{x}</a></li>" for i, x in enumerate(names))
    rows = "".join(f"<tr><td><a href=/{i}>{x}</a></td></tr>" for i, x in enumerate(names))
    menu = f"<ul>{items}</ul>"
    for inner in (f"<ol>{items}</ol>", f"<div><ul>{items}</ul></div>", f"<table>{rows}</table>", f"<section><ol>{items}</ol></section>"):
        for body in (f"<p>{LONG * 9}</p>{inner}", f"<div class=body><p>{LONG * 2}</p></div>{inner}"):
            want = f"{(LONG * (9 if body.startswith('<p>') else 2)).strip()} {' '.join(names)}"
            assert main_text(f"<body>{menu}<article>{body}</article><div>{menu}</div></body>") == want
    assert main_text(f"<body><div id=content><p>{LONG * 9}</p>{menu}</div></body>") == (LONG * 9).strip()


def test_comments_adverts_and_related_pages_in_the_article_go():
    body, said = LONG.strip(), f"<p>{LONG * 4}</p>"
    for part in (
        f'<div class="comments">{said * 3}</div>', f'<section id="comments">{said * 3}</section>', f'<div id="comments-area">{said}</div>',
        f'<div class="post-comments">{said * 9}</div>', f'<ul><li class="comment">{LONG * 4}</li></ul>', '<p class="ad">Buy this, now.</p>',
        '<p class="advertisement">Buy this, now.</p>', '<span class="sponsored">Buy this, now.</span>', f'<div class="related-posts">{said * 2}</div>',
    ):
        assert main_text(f"<body><article><h1>T</h1><p>{LONG}</p>{part}<p>End.</p></article></body>") == f"T {body} End.", part
        assert main_text(f"<body><main><h1>T</h1><p>{LONG}</p>{part}<p>End.</p></main></body>") == f"T {body} End.", part
    assert main_text(f'<div id="content"><p>{LONG}</p><p>{LONG}</p></div><div id="comments">{said * 9}</div>') == f"{body} {body}"
    assert main_text(f'<article><h2 class="related">Related</h2><pre>x <span class="comment"># y</span></pre><p>{LONG}</p></article>') == f"Related x # y {body}"


def test_titles_beside_the_text_stay():
    body, text = (LONG * 3).strip(), f"<p>{LONG * 3}</p>"
    assert main_text(f"<body><div class=post><h1>Title</h1><div class=entry>{text * 3}</div></div><div class=ad>x</div></body>") == f"Title {body} {body} {body}"
    assert main_text(f"<body><h1>Title</h1><div>{text * 2}</div><footer>f</footer></body>") == f"Title {body} {body}"
    assert main_text(f"<body><div><h1>Title</h1><h2>Sub</h2><div><div class=entry>{text * 3}</div></div></div></body>") == f"Title Sub {body} {body} {body}"
    assert main_text(f"<body><h1>Site</h1><nav>menu</nav><div>{text * 2}</div></body>") == f"{body} {body}"
    assert main_text(f"<body><h1>Site</h1><div><h1>Title</h1>{text * 2}</div></body>") == f"Title {body} {body}"


def test_short_parts_between_long_ones_stay():
    body, text = (LONG * 3).strip(), f"<p>{LONG * 3}</p>"
    short = "<section><h2>Short</h2><p>Brief note here.</p></section>"
    page = f"<body><nav>m</nav><section>{text * 2}</section>{short}<section>{text}</section><footer>f</footer></body>"
    assert main_text(page) == f"{body} {body} Short Brief note here. {body}"
    assert main_text("<body><div><p>One short text.</p></div><div><p>And another.</p></div></body>") == "One short text. And another."
    links = "".join(f"<tr><td><a href=/{i}>Part {i}</a></td></tr>" for i in range(3))
    assert main_text(f"<body><div id=content>{text * 2}<table>{links}</table></div></body>") == f"{body} {body} Part 0 Part 1 Part 2"
    assert main_text(f"<body><div id=content><table>{links}</table>{text * 2}</div></body>") == f"{body} {body}"


def test_long_pages_are_whole():
    page = "<body><div>" + "".join(f"<p>Paragraph {i}, of many.</p>" for i in range(20_000)) + "</div></body>"
    assert main_text(page) == " ".join(f"Paragraph {i}, of many." for i in range(20_000))


def test_pages_table(spark):
    pages = load(spark, SF_SMOKE, "pages")
    extra = spark.createDataFrame([(-1, None, None), (-1, None, None), (None, "u", "")], "page_id long, url string, html string")
    got = extract_pages(pages.unionByName(extra).withColumn("text", F.lit("clash")))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {}
    for r in got.collect():
        rows.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert [r.text for r in rows[-1]] == ["", ""] and rows[None][0].text == ""
    for r in pages.collect():  # these pages have one article of h1, p and inline elements
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(h1|p|br)>", " ", re.sub(r"</?b>", "", inner))).split())
        assert rows[r.page_id][0].text == want
    assert extract_pages(pages.limit(0)).collect() == []
