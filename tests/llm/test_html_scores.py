"""The tag-path scores pick the article: shown with tag names and classes out of play, and by what goes wrong without them."""

import html
import re
from collections import Counter

import pytest

from sparklake.llm import html_text as h


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    return [r.html for r in spark.read.parquet(f"{folder}/pages.parquet").orderBy("page_id").collect()]


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def nameless(page):
    """The page without classes and ids, its sections as div: nothing but the paths' scores tells the article."""
    return re.sub(r' (class|id)="[^"]*"', "", re.sub(r"(</?)(?:nav|article|footer)\b", r"\1div", page))


def f1(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def test_scores_alone_find_the_article(pages):
    got = [(h.main_text(nameless(p)), article(p)) for p in pages]
    assert sum(f1(a, b) for a, b in got) / len(got) >= 0.97 and sum(a == b for a, b in got) >= 0.9 * len(got)


def test_without_a_threshold_no_page_is_right(pages, monkeypatch):
    monkeypatch.setattr(h, "THRESHOLD", 0.0)
    assert not any(h.main_text(p) == article(p) for p in pages) and not any(h.main_text(nameless(p)) == article(p) for p in pages)


def test_the_ratios_carry_the_score(pages, monkeypatch):
    """Ratios that are the same for every path, and a kernel over the whole page, tell nothing."""
    right = sum(h.main_text(nameless(p)) == article(p) for p in pages)
    monkeypatch.setattr(h, "POINTS", re.compile("(?!)"))
    monkeypatch.setattr(h, "KERNEL", h.KERNEL * 0 + 1 / len(h.KERNEL))
    assert sum(h.main_text(nameless(p)) == article(p) for p in pages) < 0.8 * right


def test_unlikely_elements_count_for_little():
    body = "<p>A long first paragraph, with commas, and stops. It goes on for a while, and on.</p>" * 3
    assert h.main_text(f"<body><div>{body}</div><footer>{body}</footer>").count("paragraph") == 3
