import html
import os
import re

import pytest

from rowlens.llm.html_text import extract, main_text

LONG = "The river went by the house and it was the best of all that there is in the valley, so they were there with us for the day and for the night. " * 2
SF = "/root/testdata/sf0.01"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<nav><a href=1>Home</a></nav><article><h1>Head</h1><p>One &amp; two.</p><p>Three</article><footer>&copy; x</footer>", "Head One & two. Three"),
        (f"<header><p>{LONG}</p></header><main><p>{LONG}</p></main><aside><p>{LONG}</p></aside>", " ".join(LONG.split())),
        (f'<div id="cookie-notice"><p>{LONG}</p></div><div class="content"><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class="comments"><p>{LONG}</p></div>', f"{LONG}Short. {LONG}".strip()),
        (f"<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><p>{LONG}</p>", LONG.strip()),
        (f"<h2>Heading</h2><p>{LONG}</p><form><p>{LONG}</p><button>Go</button></form>", f"Heading {LONG}".strip()),
        ('<article><p>A<script>if (a<b) "</p>"</script>b.<!-- <p>no</p> -->c</p><p class="ad">Buy</p><div class="adverts">Now</div></article>', "Ab.c"),
        ("<article><p>&lt;b&gt; &#233;&nbsp;&#x41;\n\t x</p></article>", "<b> é A x"),
        ('<article><p>Keep</p><section class="comments"><article><p>Not this</p></article></section></article>', "Keep"),
        ("<article><p><b>open<br>second<p>third</article>", "open second third"),
        ('<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article><div hidden>no</div>', "one two x y"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ('<div role="main"><p>Main</p></div><p>Other</p>', "Main"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ],
)
def test_rules(body, expected):
    assert extract(page(body)) == expected


def test_odd_input_ends():
    assert extract(None) == extract("") == extract("<p></p>") == ""
    assert extract("plain text") == "plain text"
    for odd in ("<" * 50_000, '<a "' * 20_000, "<!--" * 1000, "<script>" * 1000, "<div>" * 20_000 + "x", "</p>" * 5000, "<p " + "a=b " * 50_000):
        extract(odd)


def test_pages(spark):
    rows = [(1, "u", page("<article><p>Hi é</p></article>")), (2, None, None), (3, "", ""), (1, "u", page("<article><p>Hi é</p></article>")), (None, "v", "<p>x")]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=str) == sorted([(1, "u", "Hi é", 4), (2, None, "", 0), (3, "", "", 0), (1, "u", "Hi é", 4), (None, "v", "x", 1)], key=str)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_the_drivers_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    texts = {r.page_id: r.text for r in main_text(pages).collect()}
    for r in pages.collect():
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = re.split(r"</?(?:p|h1|br)>", inside)
        assert texts[r.page_id] == " ".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"</?b>", "", b)).split())))


TEXT = LONG.strip()
CARD = "<article><h3>Teaser</h3><p>A card of another page.</p></article>"


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        (f'<div class="layout has-sidebar"><article><p>{TEXT}</p></article><div class="sidebar"><p>{TEXT}</p></div></div>', TEXT),
        (f'<div class="sidebar-layout"><div><p>{TEXT}</p></div><div class="comments"><p>No. {TEXT}</p></div></div><p>Copyright</p>', TEXT),
        (f'<article class="post tags-x"><p>{TEXT}</p></article>', TEXT),
        (f'<main id="search-engines"><p>{TEXT}</p><p class="tags">x y</p></main>', TEXT),
        (f'<main><p>{TEXT}</p></main><div class="related"><article><p>{TEXT}</p></article></div>', TEXT),
    ],
)
def test_hints_are_weighed(body, expected):
    assert extract(page(body)) == expected


def test_a_small_article_does_not_decide_for_the_page():
    paragraphs = "".join(f"<div><p>{TEXT}</p></div>" for _ in range(5))
    text = extract(page(paragraphs + CARD + "<div><a href=1>One</a> <a href=2>Two</a></div>"))
    assert text.count(TEXT) == 5 and "One" not in text


def test_no_language_is_boilerplate():
    russian = "Река текла мимо дома, и это было лучшее место в долине, поэтому они остались там на весь день и на всю ночь. " * 3
    chinese = "河水从屋旁流过，这是山谷里最好的地方，所以他们整天整夜都留在那里，看着水面上的月亮和远处的山，一直到天亮才回家，后来他们每年夏天都回到这里来，带着孩子们一起，坐在河边听老人讲从前的故事。"
    code = "for (int i = 0; i < n; ++i) { buffer[i] = table[index[i]] ^ mask; } " * 5
    for body in (russian, chinese):
        body = body.strip()
        menu = "<nav><a href=1>x</a></nav><div><a href=1>Один</a> <a href=2>Два</a></div>"
        assert extract(page(f"{menu}<h1>Т</h1><p>{body}</p><p>{body}</p>{menu}")) == f"Т {body} {body}"
    assert extract(page(f"<p>{TEXT}</p><pre>{html.escape(code)}</pre><p>{TEXT}</p>")) == f"{TEXT} {code.strip()} {TEXT}"
