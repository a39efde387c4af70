"""Main text of web pages by two passes of rules over blocks.

A page is read once, tolerantly, into blocks of text between block-level tags,
each with its length, its share of link text, its share of stop words, and
what its open elements say of it. The first pass decides most blocks: those in
menus, page headers, footers, asides, forms (by element), those in notices,
adverts or comments (by words of class, id and role) and those that are mostly
links are boilerplate; those of an article or main element are text, and where
a page has neither, or only a small part of its text there, so are long blocks
with many stop words. Words of elements that hold nearly all of the page's text
don't count. A page with hardly any stop words is decided by length and links.
Short blocks, headings and those in between stay open; in the second pass they
take the label of the nearest decided block on either side, of two as near and
unlike the following one's for a heading and boilerplate otherwise.

Defined cases: null html is an empty page; a page without text gives ''; other
columns than page_id, url and html are ignored; equal rows are extracted each
on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import fields, ship, sliced

#: Share of link text from which a block is links; of stop words for text; code points of short and of long blocks.
LINKS, STOPS_LOW, STOPS_HIGH, SHORT, LONG = 0.5, 0.15, 0.25, 70, 200
#: Share of stop words below which a page, or a block, is in none of their languages.
STOPS_PAGE, STOPS_NONE = 0.05, 0.02
#: Share of a page's text that is too little to be all of it; share from which an article element decides for the page.
LITTLE, PART = 0.1, 0.25

#: Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it
    its just like more most my no not of on one only or other our out over she so some such than that the their them then there these they
    this to two up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur leurs lui mais me même mes moi mon ne
    nos notre nous on ou où par pas pour qu que qui sa se ses si son sont sur ta te tu un une vos votre vous y été être
    aber alle als also am auch auf aus bei bin bis bist da damit dann das dass dem den der des die dies dieser doch du durch ein eine einem
    einen einer er es für hat hatte ich ihr im ist ja kann mit nach nicht noch nur oder ohne sein sich sie sind so über um und uns unter
    vom von vor war was wenn wer wie wir wird zu zum zur
    al algo con como cual cuando del desde donde dos el ella ellos era eres es esa ese esta este esto están fue ha hasta hay las lo los más
    mi muy nada ni no nos o otra otro para pero poco por porque que quien se ser si sin sobre son su sus también te tiene todo una uno y ya
    """.split()
)

#: Elements whose text is never the article's.
_DROPPED = frozenset("head script style noscript template iframe svg math canvas object audio video nav footer aside form button select textarea dialog menu".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    """address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark what isn't the article.
_HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising advertorial banner banners breadcrumb breadcrumbs byline comment comments commentlist
    complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr hidden login masthead menu menubar modal nav navbar
    navigation newsletter notice notices overlay pager pagination popup privacy promo promoted promotion recommended recommendations related
    reply replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar
    tooltip topbar widget widgets""".split()
)
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
_END = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.IGNORECASE) for name in _RAW}
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+")
_WITH = re.compile(r"\b(?:has|with|no|without)[-_]+[a-z]+")  # of the page's layout, not of the element
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    link_chars: int
    dropped: bool
    article: bool
    heading: bool
    hints: int = 0  # hinted elements around it
    label: bool | None = None


def _hinted(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether attributes hint at what isn't the article; whether they mark it; whether they hide it."""
    words: set[str] = set()
    parts: set[str] = set()
    good = hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id", "role", "aria-label", "data-role"):
            if key != "aria-label":
                words |= set(value.lower().split())
            parts |= set(_PART.findall(_WITH.sub(" ", _CAMEL.sub("-", value).lower())))
            good |= key == "role" and value.lower() in ("main", "article")
        elif key == "itemprop":
            good |= value.lower() == "articlebody"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value.lower()):
            hidden = True
    # an article's names may say what it is about, so there only a whole word counts
    return bool((words if good or name in ("article", "main") else parts) & _HINTS), good, hidden


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    out: list[Block] = []
    # name, dropped, article, link, heading, quiet (dropped within a block, which goes on behind it), hints
    stack: list[tuple[str, bool, bool, bool, bool, bool, int]] = [("", False, False, False, False, False, 0)]
    text: list[str] = []
    links = 0
    state = stack[0]

    def flush() -> None:
        nonlocal text, links
        if text:
            whole = " ".join(_html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, links, state[1], state[2], state[4], state[6]))
        text, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not state[5]:
            text.append(raw)
            if state[3]:
                links += len(raw)

    at = 0
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing = name.lower(), m[1] or m[4]
        if name in _BLOCK:
            flush()
        if closing:
            if any(s[0] == name for s in stack[1:]):
                if name in _BLOCK or name in _DROPPED:
                    while stack.pop()[0] != name:
                        pass
                else:  # not through a block that is still open
                    k = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name)
                    if not any(s[0] in _BLOCK for s in stack[k + 1 :]):
                        del stack[k:]
                state = stack[-1]
            continue
        if name in _VOID:
            continue
        attributes = m[3] or m[6] or ""
        if name in _BLOCK:  # an open paragraph or item ends where a block begins
            ends = ("li", "p") if name == "li" else ("p", "h1", "h2", "h3", "h4", "h5", "h6") if name in _HEADING else ("p",)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCK:
                    break
            state = stack[-1]
        hint, good, hidden = _hinted(name, attributes) if attributes.strip(" /\t\r\n") else (False, False, False)
        if name in ("html", "body"):
            hint = hidden = False
        inside = state[2]
        own = good or name in ("article", "main")
        hint = hint and not state[1]
        # within an article, hints decide; around one, they are weighed
        dropped = state[1] or hidden or name in _DROPPED or (name == "header" and not inside) or (hint and (inside or name not in _BLOCK))
        article = not dropped and (inside or own)
        if name in _RAW:
            end = _END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if attributes.rstrip().endswith("/") and name not in _BLOCK:
            continue
        quiet = state[5] or (dropped and not state[1] and name not in _BLOCK)
        stack.append((name, dropped, article, state[3] or name == "a", state[4] or name in _HEADING, quiet, state[6] + hint))
        state = stack[-1]
    add(page[at:])
    flush()
    return out


def _stops(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _by_density(b: Block, foreign: bool) -> bool | None:
    """A block's label by its length, links and stop words; foreign: the page has hardly any of these."""
    n = len(b.text)
    if b.link_chars > LINKS * n:
        return False
    if n < SHORT or b.heading:
        return None
    if foreign:
        return True if n >= LONG or b.link_chars < LINKS / 2 * n else None
    stops = _stops(b.text)
    if n >= LONG:  # code or a foreign quotation goes with what is around it
        return stops >= STOPS_LOW or (None if stops < STOPS_NONE else False)
    return True if stops >= STOPS_HIGH else None


def classify(found: list[Block]) -> None:
    """Labels every block: True for text."""
    open_ = [b for b in found if not b.dropped]
    long = " ".join(b.text for b in open_ if len(b.text) >= SHORT and not b.heading and b.link_chars <= LINKS * len(b.text))
    foreign = bool(long) and _stops(long) < STOPS_PAGE
    density = {id(b): _by_density(b, foreign) for b in open_ if not b.article}
    # hints count from the least depth on at which the page has text without them
    texts = [b for b in open_ if density.get(id(b)) or b.article and not b.heading and b.link_chars <= LINKS * len(b.text)]
    whole = sum(len(b.text) for b in texts)
    least = next((h for h in sorted({b.hints for b in texts}) if sum(len(b.text) for b in texts if b.hints <= h) >= LITTLE * whole), 0)
    kept = [b for b in texts if b.hints <= least]
    in_article = sum(len(b.text) for b in kept if b.article)
    outside = sum(len(b.text) for b in kept if not b.article)
    has_article = any(b.article and b.hints <= least for b in open_) and in_article >= PART * (in_article + outside)
    for b in found:
        if b.dropped or b.hints > least or (has_article and not b.article):
            b.label = False
        elif b.article:
            b.label = None if b.heading or b.link_chars > LINKS * len(b.text) else True
        else:
            b.label = density[id(b)]
    # the second pass: nearest decided blocks on either side, found in one walk each way
    first = [b.label for b in found]
    before, after = [-1] * len(found), [-1] * len(found)
    for near, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        last = -1
        for i in order:
            near[i] = last
            if first[i] is not None:
                last = i
    for i, b in enumerate(found):
        if b.label is not None:
            continue
        j, k = before[i], after[i]
        if b.article and b.heading:
            b.label = True
        elif j < 0 and k < 0:
            b.label = True  # nothing speaks against any block of the page
        elif j < 0 or k < 0:
            b.label = first[max(j, k)]
        elif i - j != k - i:
            b.label = first[j if i - j < k - i else k]
        else:
            b.label = first[k] if b.heading else first[j] and first[k]


def extract(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return " ".join(b.text for b in found if b.label)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 2):
        texts = [extract(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per page."""
    ship(pages.sparkSession)
    rows = fields(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
