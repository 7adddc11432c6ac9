"""Site templates: counted as brute force counts them, decisive where no markup names the article, and safe for odd pages."""

from collections import defaultdict

import pytest
from helpers import DATA

from rangeloom.llm import html_text

SCHEMA = "page_id long, url string, html string"


def test_templates_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    seen, keys = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for r in rows:
        host = r.url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].split(":")[0].lower()
        root = html_text.parse(r.html)
        kept = html_text.kept_elements(root)
        key = html_text.main_text(root, kept=kept)
        keys[host].add(key)
        for h, inside, _ in html_text.subtree_hashes(root, kept):
            seen[host][inside, h].add(key)
    expected = set()
    for host, found in seen.items():
        for (inside, h), held in found.items():
            least, share = (5, 0.5) if inside else (2, 0.1)
            if len(held) >= least and len(held) >= share * len(keys[host]):
                expected.add((host, inside, h))
    got = html_text.site_templates(spark.read.parquet(f"{DATA}/pages.parquet"), share=0.5, min_pages=5, beside_share=0.1, beside_pages=2).collect()
    assert expected and {(r.host, inside, h) for r in got for inside, hs in ((False, r.templates), (True, r.inner)) for h in hs or ()} == expected


def test_templates_decide_without_article_markup(spark):
    def page(i):
        return f"<body><div><p>Our shops</p><ul><li><a href=/x>Buy now</a></ul></div><div><p>Story {i} of the day, told at some length.</p></div><div><p>Write to us {i % 2}</p></div></body>"

    pages = spark.createDataFrame([(i, f"http://h.org/{i}", page(i)) for i in range(9)] + [(100, "http://lone.org/", page(3))], SCHEMA)
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert all(got[i].text == f"Story {i} of the day, told at some length." and got[i].n_templates > 0 for i in range(9))
    assert got[100].text == "Our shops Buy now Story 3 of the day, told at some length. Write to us 1" and got[100].n_templates == 0


def shuffled(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("words_of_class", [("menu", "ad", "story"), ("k1", "k2", "k3")])
def test_menus_and_adverts_of_random_words_go_by_shape(spark, rng, words_of_class):
    """No mark names the article, nothing recurs word by word, and some adverts are longer than their article."""
    menu, advert, story = words_of_class
    rows, want = [], {}
    for i in range(40):
        links = "".join(f"<li><a href='/{rng.random()}'>{shuffled(rng, 1)}</a></li>" for _ in range(rng.randrange(2, 9)))
        told = [shuffled(rng, rng.randrange(30, 90)) for _ in range(rng.randrange(1, 4))]
        ad = shuffled(rng, 400 if i % 13 == 5 else 12)
        rows.append((i, "http://h.org/x", f"<body><div class={menu}><ul>{links}</ul></div><div class={advert}>{ad}</div><div class={story}>{''.join(f'<p>{t}</p>' for t in told)}</div><div class=foot{i}>{shuffled(rng, 5)}</div></body>"))
        want[i] = " ".join(told)
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_templates >= 3 for r in got.values())


def test_hints_lower_the_threshold(spark, rng):
    """A named block of few pages goes, one without such a name stays; a host of few pages has hints alone."""
    def page(i, extra=""):
        return f"<body><div><p>{shuffled(rng, 40)} end{i}.</p>{extra}</div></body>"

    rows = [(i, "http://h.org/", page(i, f"<div class=newsletter>{shuffled(rng, 3)}</div>" if i < 2 else f"<div class=box>{shuffled(rng, 3)} kept</div>" if i < 4 else "")) for i in range(20)]
    rows += [(100, "http://few.org/", page(100, "<div class=newsletter>gone</div>"))]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].endswith(f"end{i}.") for i in (0, 1, 100)) and all(got[i].endswith("kept") for i in (2, 3))


@pytest.mark.parametrize("changes", [(("article", "div"),), (("article", "div"), ("nav", "div"), ("footer", "div"), ("header", "div"), ("aside", "div"))])
def test_given_pages_without_their_marks(spark, changes):
    import html
    import re

    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1]))).split()) for r in pages.collect()}
    for a, b in changes:
        pages = pages.withColumn("html", F.regexp_replace("html", rf"<(/?){a}\b", f"<$1{b}"))
    pages = pages.withColumn("url", F.lit("http://one.org/"))
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert sum(got[i] == t for i, t in want.items()) >= 0.95 * len(want)


def test_paragraphs_shared_by_near_copies_are_no_template(spark):
    pages = [(i, f"http://h.org/{i}", f"<article><p>Part one of it.</p><p>Part two, seen by {i}.</p></article>") for i in range(6)]
    pages += [(10 + i, f"http://h.org/o{i}", f"<article><p>Other story {i}.</p></article>") for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert all(got[i] == f"Part one of it. Part two, seen by {i}." for i in range(6))


@pytest.mark.parametrize("depth", [3_000, 60_000])
def test_any_depth(depth):
    source = "<div>" * depth + "x" + "</div>" * depth
    assert html_text.clean_page(source, {1}, {1}) == ("x", 0)
    assert html_text.clean_page("<nav>" * depth + "menu", set(), set())[0] == ""


def test_prose_of_an_article_keeps_odd_names():
    source = '<article><p>a</p><p class="share-price">b</p><p id="social-history">c</p><ul class="related"><li>d</ul><p class="skip">e</p><p class="ad">f</p></article>'
    assert html_text.clean_page(source, set(), set())[0] == "a b c e"


def test_clashing_columns_and_repeated_rows(spark):
    columns = "page_id long, url string, html string, text string, templates string, inner string, host string, _host string, page_key long, n_templates int"
    row = (1, "http://h.org", "<p>x</p>", "old", "t", "i", "h", "gone", 5, 7)
    got = html_text.extract_text(spark.createDataFrame([row, row, (None, None, "", *row[3:])], columns)).collect()
    assert sorted(r.text for r in got) == ["", "x", "x"]
    assert all((r.templates, r.inner, r.host, r.page_key, r.n_templates) == ("t", "i", "h", 5, 0) for r in got)
