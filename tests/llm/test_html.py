import html
import re

import pytest

from sparklake.llm.html_text import extract_text, main_text
from sparklake.llm.queries import QUERIES

BODY = "<p>A long first paragraph, with commas, and stops. It goes on for a while &amp; more.</p><p>Second&nbsp;paragraph &lt;b&gt; goes\n on, too; with <b>bold</b> text.<br>After a break.</p><ul><li>one item</li><li>two item</ul><p>Short.</p>"
TEXT = "A long first paragraph, with commas, and stops. It goes on for a while & more.\n\nSecond paragraph <b> goes on, too; with bold text. After a break.\n\none item\n\ntwo item\n\nShort."
REST = "<aside>Read, also, this. And that.</aside><form>Name, please. <input><label>x, y.</label></form><div class='cookie-notice'>We use cookies, ok.</div><footer>(c) x, y.</footer>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>T, t.</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav><article><h1>Title</h1>{BODY}</article>{REST}</body></html>", f"Title\n\n{TEXT}"),
        (f"<body><div class=menu>Home About</div><div id=page-main>{BODY}</div>{REST}<script>var a='<p>x, y.</p>'</script>", TEXT),
        (f"<body><main class='content menu-open'><article><header><h1>Title</h1></header>{BODY}<section class=comments><article><p>Nice, post! Very, very nice.</p></article></section></article></main>{REST}", f"Title\n\n{TEXT}"),
        (f"<body><div class='ad'>Buy, now. Cheap, pills.</div><article>{BODY}<div class=ad-box>Buy, more.</div><!-- <p>x</p> --></article>", TEXT),
        (f"<ARTICLE>{BODY}", TEXT),
        ("<article><p><b>Title.<br><p>Text, more.</article>", "Title.\n\nText, more."),
        ("plain text, only.", "plain text, only."), ("", ""), ("<div></div>", ""), ("<nav>Home</nav>", ""), ("a < b and c > d", "a < b and c > d"), ("<p>x<script>if (a<b) {", "x"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><body><article>{BODY}</article>{REST}", f"<html><head><meta charset=utf-8><title>T</title><div>{BODY}</div>{REST}", f"<head><title>T</title>\n{BODY}", f"<html><head><title>T</title></head><body><article>{BODY}</article>",
        f'<body><article class="post comments-open">{BODY}</article>{REST}', f'<body><article class="has-sidebar">{BODY}</article><div class=comments><p>{"Nice, post! " * 90}</p></div>{REST}',
        f'<body><p>Ann, 2024.</p><div class="content with-sidebar">{BODY}<div class=sidebar>Read, this. Too.</div></div>{REST}', f'<body><div class="sidebar-main"><div class="widget">{BODY}</div></div>', f"<body><form id=aspnet><div>{BODY}</div></form>{REST}",
        f"<body><form><article>{BODY}</article></form>", f'<body><div class=post>{BODY}</div><div class=comments><p>{"Nice, post! " * 90}</p></div>',
    ],
)
def test_no_hint_leaves_out_the_article(page):
    text = main_text(page)
    assert TEXT in text and len(text) <= len(TEXT) + len("Ann, 2024.\n\n")


def test_pages_of_menus_only_stay_empty():
    assert main_text("<div class=menu><a>Home</a> <a>About</a></div><form>Name</form>") == "" == main_text("<head><title>T, t.</title><style>a, b.</style>")


def test_broken_pages_end_soon():
    for page in ("<" * 100_000, '<a b="' * 20_000, "<p>" * 20_000 + "x", "<div>" * 20_000 + "x", "</p>" * 50_000, "<b>" * 20_000, "<li>" * 20_000, "&amp" * 50_000, "<!--" * 20_000):
        main_text(page)


def test_query_against_the_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op4_html_extraction"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        text = "\n\n".join(b for b in blocks if b)
        assert got[p.page_id] == (p.url, text, len(text))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (2, "u", "<p>" + "word, " * 100_000, 3), (2, "u", "<p>a", 4)], "page_id long, url string, html string, text int")
    rows = extract_text(df).collect()
    assert sorted(r.n_chars for r in rows) == [0, 0, 1, 599_999] and extract_text(df.limit(0)).count() == 0
