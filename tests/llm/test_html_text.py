import pytest

from logloom.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="ad">Buy</div>
{}<aside>more</aside><div id="comments"><p>Nice one</p></div><form><p>Mail</p></form><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>one\n  two<br>three</p><p>&eacute;&#233;&#xe9;</p></article>", "A & B\none two three\nééé"),
        ("<article><p>a <b>bold</b>word</p><!-- <p>no</p> --><p>x &lt; y</p></article>", "a boldword\nx < y"),
        ("<article><p>s</p></article>", "s"),
        ("<article><p>unclosed <b>bold<br><p>next</article>", "unclosed bold\nnext"),
        ("<article><p>text</p><div class='share'>Share</div><p>end</p></article>", "text\nend"),
        ("<article><p>read <a href=x>a linked word</a></p></article>", "read a linked word"),
        ("<article></article>", ""),
        ('<article><p>intro</p><div class="social-history"><p>He lives alone.</p></div><p class="side-effects">It may cause sleep.</p><p>end</p></article>', "intro\nHe lives alone.\nIt may cause sleep.\nend"),
        ('<article><p>intro</p><p id="notice">A notice of the court was sent to all who had an interest in it.</p><p>end</p></article>', "intro\nA notice of the court was sent to all who had an interest in it.\nend"),
        ('<article><p>one</p><div class="ad-banner">Buy now, it is cheap.</div><div id="shareButtons">Tell all your friends</div><p class="ad">Ad text that is not short at all, no.</p><p>two</p></article>', "one\ntwo"),
        ("<div class='story'><h2>Head</h2><p>Some longer text of the story.</p><p>And more of it.</p></div>", "Head\nSome longer text of the story.\nAnd more of it."),
    ],
)
def test_main_text(body, text):
    assert html_text.main_text(PAGE.replace("{}", body)) == text


@pytest.mark.parametrize("html", [None, "", "<", "<p", "&", "<script>x", "<!--", "<p title='", "< notatag"])
def test_odd_html_does_not_fail(html):
    assert html_text.main_text(html) in ("", "<", "&", "< notatag")


def test_long_page_is_whole():
    body = "".join(f"<p>paragraph {k} with words</p>" for k in range(20000))
    assert html_text.main_text(PAGE.replace("{}", f"<article>{body}</article>")).count("\n") == 19999


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a é</p></article>"), (2, None, None), (1, "u", "<article><p>a é</p></article>"), (None, "u", "")], "page_id long, url string, html string").selectExpr("*", "'old' text", "'old' N_CHARS")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()), key=str)
    assert got == [(1, "a é", 3), (1, "a é", 3), (2, "", 0), (None, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


LONG = "This line is long enough to count although its element has a doubtful name."


def test_the_distribution_decides_on_marked_pages():
    doubtful = f'<p id="notice">{LONG}</p>'
    page = "<body><article>{}</article></body>"
    assert html_text.main_text(page.format(f"<p>one</p>{doubtful}<p>two</p>")) == f"one\n{LONG}\ntwo"
    assert html_text.main_text(page.format(f"{doubtful}<p>one</p><p>two</p>{doubtful}")) == "one\ntwo"  # before the surge, after the dive
    assert html_text.main_text(page.format(f"<p>one</p>{doubtful * 3}<p>two</p>")) == "one\ntwo"  # a dive between two surges
    assert html_text.main_text(page.format(f"<p>one</p>{doubtful * 3}<p>two</p>"), window=4) == "\n".join(["one", LONG, LONG, LONG, "two"])


def test_unmarked_pages():
    body = "".join(f"<p>Paragraph {k} of the story, with words enough to be the largest stretch.</p>" for k in range(8))
    adverts = "<div class='ad'>Buy</div>" * 3
    links = "".join(f"<li><a href=x>Link number {k}</a></li>" for k in range(5))
    want = "\n".join(f"Paragraph {k} of the story, with words enough to be the largest stretch." for k in range(8))
    page = f"<body><ul>{links}</ul><p>It opens here.</p>{adverts}{body}{adverts}<p>It ends here.</p><ul>{links}{links}</ul><div>Imprint and terms</div></body>"
    assert html_text.main_text(page) == f"It opens here.\n{want}\nIt ends here."
    assert html_text.main_text(f"<body>{body}<ul>{links}{links}</ul><div>Some far text.</div></body>") == want
    between = f"<body>{body}{adverts}<p>small</p>{adverts}{body}</body>"
    assert html_text.main_text(between) == f"{want}\nsmall\n{want}"


@pytest.mark.parametrize(("value", "kind"), [("ad", 2), ("site-footer", 2), ("cookieNotice", 2), ("notice", 1), ("social-links", 1), ("social-history", 0), ("side-effects", 0), ("shared-values", 0), ("article", 0), ("", 0), ("commentary", 0), ("x ad", 2)])
def test_names_of_parts(value, kind):
    assert html_text.names_part(value) == kind


def test_broken_markup_takes_linear_time():
    """Open elements that nothing closes, and end tags that close nothing."""
    import time

    began = time.perf_counter()
    got = html_text.main_text("<div>" * 100_000 + "</span>" * 100_000 + "<p>" + "Some words of an article. " * 20 + "</p>")
    assert time.perf_counter() - began < 10 and got.startswith("Some words")
