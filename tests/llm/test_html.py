import pytest
from vigila.llm.html import extract_main_text, main_text

HEAD = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>x</p>';</script></head><body>"
        "<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies, as all do. Accept them, please.</div>")
TAIL = ("<aside><p>Read also this, and that, and more of it.</p></aside><form>Your mail, please: <input></form>"
        "<div id='comments'><p>Great text, thanks. I liked it, really.</p></div><footer>&copy; Site, 2020.</footer></body></html>")
BODY = ("<h1>A title &amp; more</h1><p><b>First  paragraph, with\n points.<br><p>Second one; it is longer. Much longer, in fact.</p>"
        "<p>Short.</p><ul><li>one<li>two <i>x</i>y</ul><table><tr><td>c1<td>c2</table><div class=ad>Buy, buy.</div>")
TEXT = "A title & more\nFirst paragraph, with points.\nSecond one; it is longer. Much longer, in fact.\nShort.\none\ntwo xy\nc1\nc2"


@pytest.mark.parametrize("box", [
    "<article>%s</article>", "<main><div>%s</div></main>", "<div class=post>%s</div>", "<div id=wrapper><div class=x>%s</div></div>",
    "<main><article><header></header>%s</article></main>"])
def test_article(box):
    assert main_text(HEAD + box % BODY + TAIL) == TEXT


def test_one_large_form():
    page = f"<body><form id=f><div class=content>{BODY}</div></form><div class='side-bar'><a>link one</a></div></body>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<article></article>", ""),
    ("<div>x</span></p></div>", "x"), ("<p>&#233;&eacute;&zzz;&lt;", "éé&zzz;<"),
    ("<article><p>" + "long text, yes. " * 20_000, ("long text, yes. " * 20_000).strip())])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_query_rows(spark):
    rows = [(1, "u", HEAD + f"<article>{BODY}</article>" + TAIL, "x"), (1, "u", None, "y"), (None, None, "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(df).collect()
    assert [tuple(r) for r in got] == [(1, "u", TEXT, len(TEXT)), (1, "u", "", 0), (None, None, "", 0)]
    assert extract_main_text(df.limit(0)).count() == 0


def test_every_page_of_the_table(spark):
    """The generator's pages mark their article; compare with a plain reading of it."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extract_main_text(pages).join(pages, "page_id").collect():
        art = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1|li|ul|div)[^>]*>", art)
        clean = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in x else "", x)).split()) for x in parts]
        assert r.text.replace(" ", "") == "\n".join(x for x in clean if x).replace(" ", "")


def test_unclosed_head():
    body = "<article><h1>T</h1><p>Some text, of the page. And more.</p></article>"
    text = "T\nSome text, of the page. And more."
    assert main_text(f"<html><head><title>x</title><meta charset=a><body>{body}</body></html>") == text
    assert main_text(f"<head><title>x</title><script>var a = 1;</script>{body}") == text


def test_wrapper_class():
    text = "T\nSome text, of the page. And more, as it is the longest."
    inner = "<h1>T</h1><p>Some text, of the page. And more, as it is the longest.</p>"
    for name in ("has-sidebar", "no-sidebar", "with-ads", "menu-open"):
        for box in (f"<div class={name}><article>{inner}</article><div class=sidebar>Other, text.</div></div>",
                    f"<div class='page {name}'><div class=x>{inner}</div><div class=sidebar>Other, text.</div></div>"):
            assert main_text(f"<body>{box}</body>") == text, box
    assert main_text(f"<div class=comments><article>Hi, there.</article></div><div><p>{inner}</div>") == text


def test_nothing_else_dropped():
    text = "Some text, of the page. And more, as it is the longest."
    # a heading above the text's own container, and short blocks of sibling sections
    assert main_text(f"<body><div class=content><h1>T</h1><div class=body><p>{text}</p></div></div></body>") == f"T\n{text}"
    page = "".join(f"<section id={n}><h2>{n}</h2><p>{text}</p><p>Short {n}.</p></section>" for n in ("intro", "results"))
    assert main_text(f"<body><div class=content>{page}</div></body>") == \
        f"intro\n{text}\nShort intro.\nresults\n{text}\nShort results."
    # a marked article is kept whole, links included
    assert main_text(f"<article><p>{text}</p><p><a href=/x>A linked line.</a></p><ul><li><a href=/y>one</a></ul></article>") \
        == f"{text}\nA linked line.\none"


def test_deep_pages_take_little_memory():
    import tracemalloc
    page = "<div>" * 100_000 + "<p>A paragraph, at last. It has two sentences.</p>"
    steps = "<div>Some words here, and more.\n" * 20_000
    tracemalloc.start()
    assert main_text(page) == "A paragraph, at last. It has two sentences."
    assert main_text(steps).count("\n") == 19_999
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_a_marked_article_keeps_what_one_word_names():
    page = """<article><h1>Title</h1><p>Some long text of the article, as it is. Yes.</p>
    <section id="related-work"><p>Prior work, as such.</p></section><h2 id="search">Search</h2>
    <p class="share-price">The price fell.</p><div class="share-buttons">Share</div><div class="ad-box">Buy</div>
    <aside>Aside</aside></article>"""
    assert main_text(page).split("\n") == [
        "Title", "Some long text of the article, as it is. Yes.", "Prior work, as such.", "Search", "The price fell."]
