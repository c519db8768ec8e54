"""Pages that a careless reader would take very long for, or read wrongly; and pages without an article element."""

import time

import pytest

from quern.llm import html_text
from quern.llm.html_text import main_text

LONG = 200_000
PAGES = {
    "no end": "<p>text</p>" + "<a " * LONG,
    "one end": "<p>text</p>" + "<a " * LONG + "'>'",
    "quotes": "<p>text</p>" + "<a =\">\"" * LONG,
    "open quote": "<p>text</p><a href='" + "<b x=" * LONG + ">",
    "deep": "<div>" * 100_000 + "<p>text</p>",
    "deep lists": "<ul>" * 100_000 + "<p>text</p>",
    "deep, odd ends": "<div>" * 100_000 + "</section>" * 100_000 + "<p>text</p>",
    "items far from their list": "<p>text</p><ul><li>" + "<blockquote>" * 50_000 + "<li></li>" * 50_000,
    "pictures without end": "<p>text</p>" + "<svg>" * LONG,
    "boxes": "<div>" * 40_000 + "<div><p>text</p></div>" * 2,
    "comments": "<p>text</p>" + "<!-- " * LONG,
}


@pytest.mark.parametrize("name", PAGES)
def test_reading_is_linear(name):
    start = time.process_time()
    text = main_text(PAGES[name], None)
    assert "text" in text and len(html_text.candidates(PAGES[name])) >= 1
    assert time.process_time() - start < 20


def test_odd_marks():
    read = lambda html: "\n".join(text for _, text, _ in html_text.Page(html).blocks)
    assert read("<p>one <![CDATA[two]]> three</p>") == "one two three"
    assert read("<p>one <![CDATA[two three") == "one two three"
    assert read("<p>a < b and c > d</p><p>x <3</p>") == "a < b and c > d\nx <3"
    assert read("<p>one<!-->two</p><p>three<!-- four") == "onetwo\nthree"
    assert read("<p title='it's'>one</p><p>it's two</p>") == "one\nit's two"
    assert read("<p title=\"a > b\">one</p>") == "one"
    assert read("<p>İİİ one</p><SCRIPT>var x = '<p>no</p>'</ScRiPt ><p>two</p>") == "İİİ one\ntwo"
    assert read("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>") == "one\ntwo\nthree\nfour"
    assert read("<table><tr><td>one<td>two<tr><td><table><tr><td>three</table><td>four</table>") == "one\ntwo\nthree\nfour"
    assert read("<p>one<p>two<div>three<p>four</div>five") == "one\ntwo\nthree\nfour\nfive"


def test_pages_without_article(spark):
    """Hosts with layouts of their own: the text is that of the box that holds the paragraphs."""
    def page(k, n):
        body = "".join(f"<p>Paragraph {i} of page {n} has some words of running text.</p>" for i in range(n % 5 + 2))
        menu = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(12))
        return (
            f"<html><body><div id=menu><ul>{menu}</ul></div><div class='box{k} x'><h1>Title {n}</h1>{body}</div><div class='sidebar'><p>Some other text that stands beside.</p></div></body></html>",
            f"<html><body><table><tr><td class=nav><ul>{menu}</ul></td><td class=text>{body}<blockquote>Quoted words of page {n} too.</blockquote></td></tr></table></body></html>",
            f"<body><main><h2>Title {n}</h2><div>{body}</div><footer>foot</footer></main><div class=comments><p>{'Very long comment. ' * 40}</p></div></body>",
        )[k]

    rows = [(10 * k + n, f"http://h{k}.example.org/{n}", page(k, n)) for k in range(3) for n in range(8)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(3):
        for n in range(8):
            body = [f"Paragraph {i} of page {n} has some words of running text." for i in range(n % 5 + 2)]
            assert got[10 * k + n] == "\n".join([[f"Title {n}", *body], [*body, f"Quoted words of page {n} too."], [f"Title {n}", *body]][k])
