"""What class names declare: never the page or its article, always what lies beside it."""

from __future__ import annotations

import pytest

from strata.llm import html_text


@pytest.mark.parametrize("page,want", [
    ('<html class="no-js cookie-consent-ok"><body class="has-sidebar"><article><p>Body text here.</p></article></body></html>', "Body text here."),
    ('<body><main class="search-layout with-menu"><p>Body text here.</p></main></body>', "Body text here."),
    ('<article><p>Body.</p><div class="post-comments"><p>Nice post!</p></div></article>', "Body."),
    ('<article><header class="x">Gone</header><div class="entry-header"><h1>Title</h1></div><p>Body.</p><div class="article-share">Share</div>'
     '<div class="entry-related">More</div><div class="ad-slot">Buy</div></article>', "Title Body."),
    ('<div class="page has-sidebar"><div class="post-content">Body.</div><div id="sidebar-left">Links</div></div>', "Body."),
    ('<article hidden><p>Gone.</p></article><article class="post sidebar"><p>Body.</p></article>', "Body."),
])
def test_names_declare_what_they_name(page, want):
    lines = html_text.lines_of(page)
    assert " ".join(lines[i].text for i in html_text.candidates(lines)) == want

