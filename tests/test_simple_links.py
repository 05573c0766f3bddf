"""Links read without Python, or without the element tree, are those that the whole reader finds."""

import random

from pyspark.sql import functions as F

from shelfwatch.operators import selectors as S
from shelfwatch.operators.extract import extract_links, simple_links

HREFS = ["/p1?seller=2", "/a/b.html", "https://ads.example/7", "../up", "/x/../y", "/p?", "//other.example/z", "", "a&amp;b", "/p;q", "/p#f", "x=", "/p1\n",
         "http://[bad", "/.x", "HTTP://UP.example/a", "/p 1", "https://shop.example", "?q=1"]
PIECES = ["text & more", "<br/>", "<br />", "<!DOCTYPE html>", "<title>t</title>", "<title>a<a class=\"product-item\" href=\"/t\">b</title>", "</a>", "</p>", "<p>",
          "<!-- <a class=\"product-item\" href=\"/comment\"> -->", "<script>'<a class=\"product-item\" href=\"/script\">'</script>", "<", "<img alt=\"<a href='/alt'>\">",
          "<a>", "<a/>", "<abbr class=\"product-item\" href=\"/abbr\">", "<title x=\"1\">t</title>", "<textarea><a href=\"/area\"></textarea>", "<plaintext>", "\"", ">", None]
PAGES = ["https://shop.example/o1", "http://shop.example", "shop", None, "https://shop.example/o1\n", "https://shop.example:8080/a/b?c", "https://shop.example?x/", "HTTPS://shop.example/"]


def _anchor(rng):
    href = rng.choice(HREFS)
    attrs = [f'href="{href}"', 'class="product-item wide"', 'class="menu"', 'title="x class="', 'data-x="1 href=2"', f"href='{href}'", "class=product-item", f'HREF="{href}"', "hidden"]
    return f"<a {' '.join(rng.sample(attrs[:5], 2) if rng.random() < 0.7 else rng.sample(attrs, 3))}{rng.choice(('', '', ' ', '/', ' /'))}>x</a>"


def _pages(n, seed):
    rng = random.Random(seed)
    plain = [f'<div><a class="product-item wide" href="{h}">x</a><a class="menu" href="/home">home</a></div>' for h in HREFS]
    rows = [(p, h) for p in PAGES for h in [*plain, None, ""]]
    for _ in range(n):
        parts = [_anchor(rng) if rng.random() < 0.5 else rng.choice(PIECES[:3] + PIECES[3:] * (rng.random() < 0.3)) or "" for _ in range(rng.randrange(6))]
        rows.append((rng.choice(PAGES[:2] * 4 + PAGES), "".join(parts)))
    return rows


def _whole(page, html, selector, resolve):
    """The reader with the element tree, and the standard library's address rules."""
    from urllib.parse import urljoin
    if html is None:
        return []
    found = S._read(html, {"x": selector}).found["x"]
    out = []
    for href in found:
        try:
            out.append(urljoin(page, href) if resolve and page is not None and href else href)
        except ValueError:
            out.append(href)
    return [x for x in out if x]


def test_links_are_those_of_the_whole_reader(spark):
    rows = [(i, p, h) for i, (p, h) in enumerate(_pages(3000, 5))]
    pages = spark.createDataFrame(rows, "n int, url string, html string").repartition(4)
    for token in (None, "product-item"):
        selector = S.Selector("a", "class", token=token, take="attribute", name="href") if token else S.Selector("a", take="attribute", name="href")
        for resolve in (True, False):
            want = sorted((p or "", x) for _, p, h in rows for x in _whole(p, h, selector, resolve))
            got = extract_links(pages, class_token=token, resolve=resolve).collect()
            assert sorted((r["page"] or "", r["href"]) for r in got) == want and len(want) > 500
            assert all((S.read_page(h, {"x": selector})["x"] or []) == S._read(h, {"x": selector}).found["x"] for _, _, h in rows if h is not None)
    ready = simple_links(pages, "url", "html", "product-item", True).select(F.col("_ready").isNotNull().cast("int").alias("r"))
    assert 0.1 < ready.agg(F.avg("r")).first()[0] < 0.9


def test_simple_pages_do_not_travel_to_python(spark):
    html = '<div><a class="product-item wide" href="/p1?seller=7">product</a><a class="menu" href="/home">home</a></div>'
    pages = spark.createDataFrame([("https://shop.example/o1", html)] * 3, "url string, html string")
    links = simple_links(pages, "url", "html", "product-item", True).collect()
    assert [r["_ready"] for r in links] == [["https://shop.example/p1?seller=7"]] * 3
    deep = "<p>" * 20_000 + "<b" + ' x="1"' * 20_000 + ">" + '<a href="' + "/a" * 20_000 + '">'
    assert spark.createDataFrame([("https://shop.example/", deep)], "url string, html string").transform(extract_links, class_token=None).count() == 1
