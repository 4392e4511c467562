"""Main text where names mislead, are missing, or stand inside parts that are left out."""

from __future__ import annotations

import pytest

from siltworks.llm import html_extract
from siltworks.llm.frames import table

SAID = [
    "The council voted on Tuesday to widen the old bridge, and work is to begin before the end of spring.",
    "Short one.",
    "Engineers who looked at the piers last year found that three of the five need new footings, which will take most of the money.",
    "Traffic will be led over the northern road until then, the mayor said, and buses will stop at the mill.",
]
TEXT = "<h1>Bridge</h1>" + "".join(f"<p>{s}</p>" for s in SAID)
WANT = " ".join(["Bridge", *SAID])
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/news>News of the day</a></li></ul>"
OPINION = "<p>I think that this is a very good plan, and I hope they will keep to it.</p>"

PAGES = {
    "a comment that is an article": f'<nav>{MENU}</nav><article>{TEXT}</article><div id="comments"><article class="comment-body">{OPINION}</article></div>',
    "more comments than article": f'<article>{TEXT}</article><div id="comments">{"".join(f"<div class=comment>{OPINION}</div>" for _ in range(12))}</div>',
    "a class inside a footer": f'<article>{TEXT}</article><footer><div class="text-muted">Our paper has been printed in this town since 1911. Write to us.</div></footer>',
    "content of a notice": f'<div class="cookie-notice"><div class="content">We use cookies to make this site better. Please accept them now.</div></div><article>{TEXT}</article>',
    "an article in an aside": f'<article>{TEXT}</article><aside class="related"><article><h2>Mill</h2><p>The mill is to open again in May, its owners said.</p></article></aside>',
    "no names, a menu and fine print": f"{MENU}{TEXT}<p>&copy; 2020 The Paper. All rights reserved.</p>",
    "no names, in sections": f"<div><div>{MENU}</div><div>{TEXT}</div></div><div><p>&copy; 2020 The Paper</p></div>",
    "a menu called content": f'<div class="content">{MENU}{TEXT}</div>',
    "the main part in a sidebar": f'<div class="sidebar"><main>{TEXT}</main><div><p>Some more words here, from us.</p></div></div>',
    "what an element has": f'<div class="layout has-sidebar">{TEXT}</div>',
}


@pytest.mark.parametrize("body", PAGES.values(), ids=PAGES)
@pytest.mark.parametrize("named", ["<body>", '<body class="page with-sidebar footer-page">'])
def test_names_do_not_mislead(body, named):
    page = f"<html>{named}{body}</body></html>"
    for weights in (html_extract.PRIOR, html_extract.fit([f"<body><nav>{MENU}</nav><article>{TEXT}</article><footer>&copy; 2020</footer></body>"])):
        assert html_extract.main_text(page, weights)[0] == WANT


def test_lists_tables_and_linked_titles_of_the_article_stay():
    inner = "<ul><li>one pier</li><li>two piers</li></ul><table><tr><td>Cost</td><td>9</td></tr></table>"
    page = f"<body><article>{TEXT.replace('Bridge', '<a href=/b>Bridge</a>')}{inner}</article></body>"
    assert html_extract.main_text(page, html_extract.PRIOR)[0] == WANT + " one pier two piers Cost 9"


def test_a_paragraph_about_copyright_is_no_fine_print():
    page = f"<body><article>{TEXT}<p>Copyright law says otherwise.</p></article></body>"
    assert html_extract.main_text(page, html_extract.PRIOR)[0] == WANT + " Copyright law says otherwise."


def test_the_cut_overrules_names():
    page = f'<body><div class="content">{MENU}{TEXT}</div></body>'
    found = html_extract.blocks(page)
    kept = html_extract.minimum_cut(html_extract.page_graph(found, html_extract.PRIOR))
    assert [b.text for b, k in zip(found, kept) if k != (b.place > 0)] == ["Home", "News of the day"]


def test_a_slash_ends_a_value_or_a_tag():
    assert [(b.text, b.linked) for b in html_extract.blocks("<p><a href=/>Home</a></p><p><a name='x'/>text")] == [("Home", 4), ("text", 0)]


def test_training_takes_pages_that_fit(spark):
    rows = [(i, f"<body><article>{TEXT}</article></body>") for i in range(5)] + [(9, "<article>" + "x" * 5000), (10, None), (11, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    size = len(rows[0][1])
    assert html_extract.train(pages, page_bytes=size).tolist() == html_extract.fit([rows[0][1]] * 5).tolist()
    assert html_extract.train(pages, page_bytes=size, sample_bytes=2 * size + 1).tolist() == html_extract.fit([rows[0][1]] * 2).tolist()
    assert html_extract.train(pages, page_bytes=1).tolist() == html_extract.PRIOR.tolist()


def test_without_class_names_the_given_pages_keep_their_articles(spark, small):
    pages = table(spark, small, "pages")
    weights = html_extract.train(pages)
    shares = []
    for r in pages.collect():
        named = html_extract.main_text(r["html"], weights)[0]
        bare = r["html"].replace("<article>", "<div>").replace("</article>", "</div>").replace(' class="ad"', "").replace("<footer", "<div").replace("<nav>", "<div>").replace("</nav>", "</div>")
        got = html_extract.main_text(bare, weights)[0]
        shares.append(named in got and len(got) <= len(named) + 160)
    assert sum(shares) >= 0.9 * len(shares)
