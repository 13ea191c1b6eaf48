"""HTML extraction on the hard cases: repeated pages, names inside articles, unclosed quotes, headlines, recurring blocks."""

import pytest

from statloom.llm.htmltext import Page, main_text, names_clutter


def texts(spark, path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.mode("overwrite").parquet(str(path))
    return {r.page_id: r.text for r in main_text(spark.read.parquet(str(path))).collect()}


def test_repeated_pages_keep_their_text(spark, tmp_path):
    """Copies of a page are one page of their host, so that their text is no template; what differing pages share is."""
    site = "<div><p>Motto of the site</p></div>"
    rows = [(i, "http://h.example/a", f"<body>{site}<div><p>the one page</p></div></body>") for i in range(6)]
    rows += [(10 + i, f"http://h.example/{i}", f"<body>{site}<div><p>page number {i}</p></div></body>") for i in range(9)]
    assert texts(spark, tmp_path / "p", rows) == {i: "the one page" for i in range(6)} | {10 + i: f"page number {i}" for i in range(9)}


def test_recurring_blocks_in_articles(spark, tmp_path):
    """A paragraph on over half of a host's pages goes; a heading or a quotation that some share stays."""
    rows = [(i, "http://h.example/", f"<article><h2>Background</h2><p>text {i}</p>{'<p>a quotation</p>' if i % 3 == 0 else ''}<p>Follow us for <b>more</b></p></article>") for i in range(20)]
    assert texts(spark, tmp_path / "p", rows) == {i: f"Background text {i}" + (" a quotation" if i % 3 == 0 else "") for i in range(20)}


@pytest.mark.parametrize(("html", "want"), [
    ('<article><p>see <a class="related">the related law</a> now</p></article>', "see the related law now"),
    ('<article><p>a <span class="search-term">term</span></p><div class="notice-board">board</div></article>', "a term board"),
    ('<article><p>a</p><div class="cookie-notice">no</div><section id="user-comments">no</section><div class="ad-slot">no</div></article>', "a"),
    ("""<p title='it>one <b title="x>two</b>""", "one two"),
    ("<main><h1>Headline</h1><article><p>text</p></article></main>", "Headline text"),
    ("<body><header><h1>Site</h1></header><article><p>text</p></article></body>", "text"),
    ("<body><div><h1>Beside</h1></div><article><h1>Own</h1><p>text</p></article></body>", "Own text"),
    ("<article><p>&lt;b&gt; &amp;amp; &#233;</p><form>f</form><nav>n</nav></article>", "<b> &amp; é"),
])
def test_text(html, want):
    assert Page(html).text() == want


def test_names():
    assert all(map(names_clutter, ['"site-comments"', "adBanner", "x sidebar-left", "'newsletter_signup'", "ad", "menu-items"]))
    assert not any(map(names_clutter, ["search-term", "notice-board", "shared", "reader", "form-of-words", "", "social-history"]))
