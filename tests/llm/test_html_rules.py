"""What leaves a page: names of containers, hidden elements, and subtrees that recur on a host."""

import pytest

from geoflow.llm import html


@pytest.mark.parametrize(
    ("block", "stays"),
    [
        ('<div class="ad-slot">x</div>', False),
        ('<section class="newsletter-signup"><p>x</p></section>', False),
        ('<ul class="comment-list"><li>x</ul>', False),
        ('<div id="comments_area">x</div>', False),
        ('<p class="social">x</p>', True),
        ('<p class="notice">x</p>', True),
        ('<h2 class="share">x</h2>', True),
        ('<div class="share-price">x</div>', True),
        ('<div class="share">x</div>', False),
        ('<div class="advice">x</div>', True),
        ('<p style="display: none">x</p>', False),
        ('<div style="color:red;visibility:hidden">x</div>', False),
        ('<div style="color:red">x</div>', True),
        ('<header><p>x</p></header>', True),
    ],
)
def test_inside_an_article(block, stays):
    assert html.main_text(f"<body><article><p>a</p>{block}<p>b</p></article></body>") == ("a\nx\nb" if stays else "a\nb")


@pytest.mark.parametrize(("block", "stays"), [('<div class="site-header">x</div>', False), ('<div class="right-col">x</div>', False), ('<div class="top_bar">x</div>', False), ('<div class="main-col">x</div>', True), ('<p class="share">x</p>', True), ('<div class="post-header">x</div>', True)])
def test_without_an_article(block, stays):
    assert html.main_text(f"<body>{block}<div><p>a</p></div></body>") == ("x\na" if stays else "a")


def brute(pages):
    """Texts of (id, host, body) with subtrees counted page by page: a container of the same markup on five different pages goes."""
    from collections import Counter

    out = {}
    for _, host, _ in pages:
        mine = {body for _, h, body in pages if h == host}
        seen = Counter(part for body in mine for part in {p for p in body.split("|") if p})
        for i, h, body in pages:
            if h == host:
                out[i] = "\n".join(p for p in body.split("|") if p and (seen[p] < 5 or p[0] == "p" and seen[p] < len(mine) / 2))
    return out


def test_recurring_subtrees_by_brute_force(spark):
    """Containers (d) go from five pages of their host on, paragraphs (p) only from half of them; copies of a page are one."""
    pages = []
    for i in range(60):
        parts = [f"p own {i}", *(["d menu"] * (i % 10 == 0)), *(["d rare"] * (i % 20 == 0)), *(["p often"] * (i % 2 == 0)), *(["p some"] * (i % 6 == 0))]
        pages.append((i, "hot.org", "|".join(parts)))
    pages += [(100 + i, "copies.org", "d same|p text") for i in range(9)] + [(200 + i, "small.org", f"d same|p text {i}") for i in range(4)]
    markup = lambda body: "".join(f"<div>{p}</div>" if p[0] == "d" else f"<p>{p}</p>" for p in body.split("|"))
    df = spark.createDataFrame([(i, f"https://{h}/{i}", f"<html><body>{markup(b)}</body></html>") for i, h, b in pages], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}
    assert got == brute(pages)
    assert "d menu" not in got[0] and "d rare" in got[0] and "p some" in got[0]
