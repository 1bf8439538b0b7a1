import math
import random

import pytest

from leadwright.llm.html_extract import Lines, clusters, main_text

L = "These words make up a sentence of an article that somebody may well want to read. "
P = L * 4
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/n">News</a></li></ul>'
BAR = '<div><a href="/">Home</a> <a href="/a">About</a> <a href="/n">News</a></div>'


def one(text):
    return " ".join(text.split())


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<div><div><p>{L * 20}</p></div><div><p>{L * 3}</p></div></div>", L * 23),
        (f"{MENU}<p>{P}</p><p>{P}</p>", P * 2),
        (f"<p>{P}</p>{MENU}<p>{P}</p>", P * 2),
        (f"{BAR}<div><p>{P}</p></div><div><p>{P}</p></div>{BAR}", P * 2),
        (f"<div><div><p>{P}</p></div>{BAR}<div><p>{P}</p></div></div>", P * 2),
        (f"<div><h1>Title</h1><p>{P}</p><p>Short.</p><p>{P}</p><p>End.</p></div><div>© 2024 Example. All rights reserved.</div>", f"Title {P} Short. {P} End."),
        (f"<p>{P}</p><p>End.</p><p>Copyright 2024 by the makers of this page.</p>", f"{P} End."),
        (f'<article><header class="entry-header"><h1>Title</h1></header><p>{P}</p></article>', f"Title {P}"),
        (f'<div class="post-header"><h1>Title</h1></div><article><p>{P}</p></article>', P),
        (f'<article><div class="post-header"><h1>Title</h1></div><p>{P}</p></article>', f"Title {P}"),
        (f'<article><p>{P}</p><div class="search-engines"><p>{L}</p></div><p class="share-holders">{L}</p></article>', f"{P} {L} {L}"),
        (f'<article><p>{P}</p><div class="share-buttons">Tell it</div><div class="main-nav">x</div><div id="comment_list"><p>{P}</p></div></article>', P),
        (f"<article><p>{P}</p>{MENU}</article>", f"{P} Home About us News"),
        (f"<div>{L * 2}</div><main><p>{P}</p><p>{P}</p></main>", P * 2),
        ('<div><a href="/">All</a></div>', "All"),
        (f"<table><tr><td>{MENU}</td><td><p>{P}</p><p>More.</p></td></tr></table>", f"{P} More."),
    ],
)
def test_shapes(body, text):
    assert main_text(f"<html><head><title>T</title></head><body>{body}</body></html>") == one(text)


def brute_clusters(lines):
    ratios = [len(text) / max(1, tags) for text, tags, *_ in lines]
    smooth = []
    for i in range(len(ratios)):
        near = [(math.exp(-0.5 * (i - j) ** 2), ratios[j]) for j in range(max(0, i - 2), min(len(ratios), i + 3))]
        smooth.append(math.log(sum(w * x for w, x in near) / sum(w for w, _ in near)))
    low, high = min(smooth), max(smooth)
    for _ in range(20):
        middle = (low + high) / 2
        below, over = [x for x in smooth if x < middle], [x for x in smooth if x >= middle]
        now = (sum(below) / len(below) if below else low), (sum(over) / len(over) if over else high)
        if now == (low, high):
            break
        low, high = now
    return [x >= (low + high) / 2 - 1e-12 for x in smooth]


def test_ratio_smoothing_and_clusters_by_hand():
    r = random.Random(7)
    for _ in range(60):
        body = "".join(r.choice(["<p>{}</p>", "<div><b>{}</b><br></div>", "<li><a>{}</a></li>", "<p>{}<i>x</i><i>y</i></p>"]).format("w " * r.choice([1, 3, 20, 200])) for _ in range(r.randrange(1, 30)))
        page = Lines()
        page.feed(body)
        page.close()
        page.flush()
        assert clusters(page.lines).tolist() == brute_clusters(page.lines)
