"""Articles that stand under names like those of boilerplate, and copies of an article with differing menus."""

import pytest

from rangeloom.llm import html_text

STORY = "<p>The whole story, told at some length.</p>"
ALONE = "The whole story, told at some length."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='has-sidebar'>{STORY}</div></body>",
        f"<body><div class='page no-comments'>{STORY}</div></body>",
        f"<body><div id='social-science'>{STORY}</div></body>",
        f"<body><div class='sidebar'>Ad</div><article class='post category-advertising'>{STORY}</article></body>",
        f"<body><div class='widget'><article>{STORY}</article></div></body>",
        f"<body><article class='sponsored'>{STORY}</article></body>",
        f"<body><div class='content-with-banner'><div class='banner'>Buy</div><div class='adSlot'>Now</div>{STORY}</div></body>",
        f"<body><form id=aspnet><div class='hidden-menu'>Go</div><main>{STORY}</main></form></body>",
        f"<body><div class='popup'>{STORY}</div><div class='ad-300x250'>Buy</div></body>",
    ],
)
def test_article_under_odd_names_stays(page):
    assert html_text.main_text(html_text.parse(page)) == ALONE


def test_small_boilerplate_still_goes():
    for name in ("ad-slot", "cookie-notice", "site-footer", "relatedPosts", "comments", "page-header"):
        assert html_text.main_text(html_text.parse(f"<body><div class='x {name}'>Gone</div><div>{STORY}</div></body>")) == ALONE


def test_copies_with_differing_menus_are_no_template(spark):
    def page(i, article, note):
        return f"<body><nav><a href=/{i}>Menu {i}</a></nav><div class='ad'>Advert {i}</div><article><p>{article}</p>{note}</article></body>"

    note = "<p>All rights reserved</p>"
    pages = [(i, f"http://h.org/{i}", page(i, "One story in many copies", note)) for i in range(30)]
    pages += [(100 + i, f"http://h.org/o{i}", page(100 + i, f"Story {i}", note)) for i in range(15)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "One story in many copies" for i in range(30))
    assert all(got[100 + i] == f"Story {i}" for i in range(15))
