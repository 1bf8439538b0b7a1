"""Pages built of an article and what surrounds it: the article comes back, and nothing else."""

import random
import time

import pytest

from leadwright.llm import html_extract
from leadwright.llm.html_extract import extract_text, main_text

WORDS = "river stone bridge winter market letter garden engine window harbour valley silver copper teacher doctor".split()


def sentence(r, least, most):
    return " ".join(r.choices(WORDS, k=r.randint(least, most))).capitalize() + "."


def clutter(r, inside):
    """Something that surrounds an article. inside: such as also stands in the middle of one."""
    long = sentence(r, 30, 90)
    some = [
        f'<div class="ad-banner-300">{long}</div>', f'<div class="site-notice-bar-wide"><p>{long}</p></div>', f'<div id="cc-window" class="cc-window">{long}</div>', f"<aside><p>{long}</p></aside>",
        f'<article class="comment"><p>{long}</p></article>', f'<section class="comments-area"><div class="comment-body"><p>{long}</p></div></section>', f'<div role="complementary">{long}</div>',
        f"<form><p>{long}</p><button>Send</button></form>", f'<ul class="share-buttons"><li><a href="/a">{sentence(r, 1, 2)}</a></li></ul>', "<script>var a = '<p>no</p>';</script>",
    ]
    around = [
        "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.sample(WORDS, 5)) + "</ul></nav>", f"<header><h1>{sentence(r, 2, 4)}</h1></header>", f"<footer><p>{long}</p></footer>",
        "<div>" + "".join(f'<a href="/{w}">{w}</a><br>' for w in r.sample(WORDS, 6)) + "</div>", f'<div class="cookie-consent">{long}</div>',
    ]
    return r.choice(some if inside else some + around)


def page(seed, kind):
    r = random.Random(seed)
    text, body = [], []
    title = sentence(r, 3, 6)
    text.append(title)
    body.append(f"<header><h1>{title}</h1></header>" if kind != "sections" and r.random() < 0.5 else f"<h1>{title}</h1>")
    for n in range(r.randint(4, 9)):
        said = sentence(r, 25, 80) if n in (0, 2) or r.random() < 0.6 else sentence(r, 2, 5)
        text.append(said)
        link = r.random() < 0.15
        body.append(f'<p><a href="/x">{said}</a></p>' if link else f"<p>{said}</p>" if r.random() < 0.8 else f"<p>{said}")
        if r.random() < 0.4:
            body.append(clutter(r, True))
    start, end = {"article": ("<article>", "</article>"), "main": ('<main id="content">', "</main>"), "post": ('<div class="blog-post">', "</div>"), "sections": ("<section>", "</section>")}[kind]
    around = ["".join(clutter(r, False) for _ in range(r.randint(1, 3))) for _ in range(2)]
    return f"<html><head><title>t</title></head><body>{around[0]}{start}{''.join(body)}{end}{around[1]}</body></html>", " ".join(text)


@pytest.mark.parametrize("kind", ["article", "main", "post", "sections"])
def test_the_article_comes_back(kind):
    for seed in range(300):
        html, text = page(seed, kind)
        assert main_text(html) == text, (seed, html)


def test_clusters_choose_lines_inside_an_article(monkeypatch):
    long = " ".join(WORDS * 3).capitalize() + "."
    html = f"<article><div>By <b>Ann</b> | <i>3 min</i></div><div><span>Print</span> <span>Mail</span></div><p>{long}</p><p>Yes.</p><p>{long}</p><div>Filed <i>under</i> <b>Rivers</b></div></article>"
    assert main_text(html) == f"{long} Yes. {long}"
    monkeypatch.setattr(html_extract, "threshold", lambda values: -1e9)
    assert main_text(html) == f"By Ann | 3 min Print Mail {long} Yes. {long} Filed under Rivers"


def test_a_long_notice_beside_an_article_of_its_length():
    long = " ".join(WORDS * 4) + "."
    for name in ("cc-window", "strange"):
        assert main_text(f'<body><div class="{name}">{long}</div><article><h1>A title</h1><p>{long} End.</p></article></body>') == f"A title {long} End."


def test_names_that_are_subjects():
    long = " ".join(WORDS * 4) + "."
    assert main_text(f'<article class="post category-notices tag-ads"><p>{long}</p></article>') == long
    assert main_text(f'<div class="search-engines"><p>{long}</p></div>') == long


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x y z.", "<b>" * 100_000 + "x", "<p>a</i>" * 50_000, "<article>" * 30_000 + "some text." + "</article>" * 30_000, "<a>" * 50_000 + "x<p>" * 50_000, "<li><td>" * 50_000 + "</table>" * 50_000])
def test_deep_and_broken_pages_take_linear_time(html):
    began = time.perf_counter()
    main_text(html)
    assert time.perf_counter() - began < 15


def test_columns_named_like_helpers(spark):
    rows = spark.createDataFrame([(1, "s", "<p>One.</p>", 3.0, "o")], "page_id long, `_source` string, html string, n_chars double, `a.b` string")
    assert extract_text(rows).select("page_id", "_source", "`a.b`", "text", "n_chars").first() == (1, "s", "o", "One.", 4)
