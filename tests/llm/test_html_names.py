"""Names of page parts, wrapped articles, and time on hostile pages."""

import time

import pytest

ARTICLE = " ".join(f"Sentence number {k} of the article, which is long enough, says something worth reading." for k in range(4))
MARKED = "".join(f"<p>{s.strip()}.</p>" for s in ARTICLE.split(".") if s.strip())
NAMES = "layout has-sidebar|with-sidebar|main no-sidebar|social-science|ad-hoc report|notice-board|layout-header-fixed|login-required-content|entry-header|post-content"
PARTS = "site-header|siteHeader|page-footer|sidebar|sidebar-left|main-nav|nav-bar|cookie-notice|ad-slot|ad-container|share-buttons|related-posts|newsletter-signup|comment-list|commentList|widget-area|social-links|header-top"


@pytest.mark.parametrize("name", NAMES.split("|"))
def test_names_of_layouts_and_subjects_keep_the_article(name):
    from barloom.llm.html_extract import extract

    assert extract(f"<html><body><div class='{name}'>{MARKED}</div><div><p>Another text, short, which stands beside it.</p></div></body></html>").startswith(ARTICLE[:-1])


@pytest.mark.parametrize("name", PARTS.split("|"))
def test_names_of_page_parts_are_left_out(name):
    from barloom.llm.html_extract import extract

    part = "<p>This part of the page, whatever it says, is long and has commas, but it is no article text.</p>" * 2
    assert extract(f"<body><div class='{name}'>{part}</div><div id='text'>{MARKED}</div></body>") == ARTICLE
    assert extract(f"<body><main>{MARKED}<div id='{name}'>{part}</div></main></body>") == ARTICLE


def test_a_whole_page_under_a_dropped_name_stays_but_comments_never_do():
    from barloom.llm.html_extract import extract

    assert extract(f"<body><div class='sidebar'>{MARKED}</div><p>Short.</p></body>").startswith(ARTICLE[:40])
    assert extract(f"<body><div class='comments'>{MARKED}</div><div><p>One line, short.</p></div></body>") == "One line, short."


def test_headers_and_wrappers_inside_an_article():
    from barloom.llm.html_extract import extract

    assert extract(f"<body><article><header class='entry-header'><h1>Its title</h1></header>{MARKED}</article></body>") == f"Its title {ARTICLE}"
    for wrapped in (f"<div><div>{MARKED}</div></div><div><div>{MARKED}</div></div>", f"<div>{MARKED}</div><section><div><div>{MARKED}</div></div></section>"):
        assert extract(f"<body><div id='c'>{wrapped}</div></body>") == f"{ARTICLE} {ARTICLE}"


def test_time_is_linear_on_open_declarations_and_spans():
    from barloom.llm.html_extract import extract

    def seconds(page):
        began = time.process_time()
        extract(page)
        return time.process_time() - began

    for make in (lambda n: "<!" * n, lambda n: "<p>" + "<span>" * n + "<h2>x" * n, lambda n: "<li>" + "<span>" * n + "<li>x" * n):
        assert seconds(make(16_000)) < 12 * max(seconds(make(4_000)), 0.02)
