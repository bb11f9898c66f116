"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags; a block has a text, the
share of it that lies in links, and the share of its words that are stop words.
The first pass judges each block alone. What stands in a container that is no
article by its tag, role or class (menus, forms, adverts, comments and so on) is
out. Of the rest, blocks made of links are bad; long ones with many stop words are good,
long ones with few are bad; short ones are ambiguous. In the second pass every
ambiguous block takes the label of the nearest decided block of its region,
which two sweeps find. A region is the page's article where it has one, else its
main part, else its body; nothing outside of it is text. Inside an article a block is not bad for a lack
of stop words, and bad blocks (lists of links between paragraphs) decide nothing about others. A heading
goes with the block after it, a tie with the text, but not in a body.

One linear scan of a page in one task; no shuffle. A page's tags that are not
closed, and references that are not, are read as browsers do.

Defined cases: a null page counts as empty and gives an empty text; so does one
without main text. White space is a run of space, tab, line feed, form feed or carriage
return, and the same characters written as references. Rows that repeat stay; ids and addresses
pass through, nulls too; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stop words of the languages that are told from noise.
STOP_WORDS = frozenset("""
a about all an and are as at be been but by can for from had has have he her his i if in into is it its more my no not of
on one or our out she so some that the their them there these they this to up was we were what when which who will with
would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für
haben hat ich ihr im in ist ja kann mehr mein mit nach nicht noch nur oder sein sich sie sind so über um und uns unter
vom von vor war was wenn werden wie wir wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais me même ne nous on ont ou
par pas plus pour qu que qui sa sans se ses si son sont sur tout très un une vous
al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o
para pero por porque que se sin sobre son su sus también te todo tu un una uno y ya
""".split())
#: Shares of stop words, shares of text in links, and lengths, that decide a block.
STOP_LOW, STOP_HIGH = 0.15, 0.3
LINKS_SOME, LINKS_MANY = 0.2, 0.5
SHORT, LONG = 70, 200
#: Tags whose content is never main text, and containers that are not part of an article.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
OUT = frozenset("nav aside form footer head noscript button select option datalist dialog template svg math object "
                "canvas audio video map menu fieldset legend label output progress meter".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
                  "ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that a closing tag is matched with; others (p, li, b, a and so on) are not kept open.
CONTAINERS = (OUT | frozenset("html body article main section div header ul ol dl table blockquote figure details "
                              "center td th".split())) - frozenset("option label".split())
#: Words of a class, id or role that name what is not the article.
NOT_TEXT = frozenset("""
ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners
sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer
cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe
subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus
respond reply replies reactions widget widgets search form copyright disclaimer complementary contentinfo
""".split())
#: Words of a class or id that name a page's main part where no tag does.
MAIN_PART = frozenset("article content entry main post story articlebody postbody".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*'|"[^"]{0,4096}"|'[^']{0,4096}')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""",
                        re.I)
_SPACE = re.compile(r"[ \t\n\f\r\x0b]+")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NEGATED = re.compile(r"(?:has|with|without|no|is|not)[-_]")
_NAME_PART = re.compile(r"[^a-z0-9]+")

_ENDING, _ENDED = ("body", "main", "article"), ("head", "nav", "select", "button")

# Where a block stands; the first region that has text is the page's.
ARTICLE, MAIN, PART, BODY = range(4)
GOOD, BAD, AMBIGUOUS = 1, -1, 0


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    linked: int
    region: int
    out: bool
    heading: bool


def _names(attributes: str) -> tuple[set[str], bool]:
    """Words of a tag's class, id and role; whether it is hidden."""
    words: set[str] = set()
    hidden = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role", "itemprop"):
            for one in value.split():
                if not _NEGATED.match(one):
                    words.update(_NAME_PART.split(one))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or _HIDDEN.search(value):
            hidden = True
    return words, hidden


class _Open:
    """An open container: its tag, the region inside, and whether it keeps its content out of the text."""

    __slots__ = ("tag", "region", "out", "header")

    def __init__(self, tag, region, out, header):
        self.tag, self.region, self.out, self.header = tag, region, out, header


def _opened(tag: str, attributes: str, above: _Open) -> _Open:
    words, hidden = _names(attributes) if attributes else (set(), False)
    whole = tag in ("html", "body", "main")
    out = above.out or hidden or tag in OUT or (not whole and not NOT_TEXT.isdisjoint(words))
    region = above.region
    if tag == "article":
        region = ARTICLE
    elif tag == "main" or words & {"main"} and region == BODY:
        region = min(region, MAIN)
    elif not whole and not MAIN_PART.isdisjoint(words):
        region = min(region, PART)
    # the header of an article holds its heading; nothing else of it is text
    header = above.header or tag == "header" or ("header" in words and not whole and tag != "article")
    return _Open(tag, region, out, header)


def blocks(page: str) -> Iterator[Block]:
    """The blocks of a page in order, text decoded and white space folded."""
    stack = [_Open("", BODY, False, False)]
    parts: list[str] = []
    linked, links, heading, out, at, n = 0, 0, False, False, 0, len(page)

    def flush():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip(" ")
            if text:
                top = stack[-1]
                yield Block(text, linked, top.region, top.out or out or (top.header and not heading), heading)
            parts, linked = [], 0

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            piece = html.unescape(page[at:start])
            parts.append(piece)
            if links:
                linked += len(piece) - piece.count(" ")
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1:start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        found = _TAG.match(page, start) or _PLAIN_TAG.match(page, start)
        if not found:
            if page[start + 1:start + 2].isalpha() or page.startswith("</", start):
                break  # a tag that the page's end cuts off
            parts.append("<")
            at = start + 1
            continue
        at = found.end()
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = n if end is None else end.start()
            continue
        if tag == "br" or tag in VOID and tag not in BLOCK:
            if tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in BLOCK or tag in CONTAINERS:
            yield from flush()
            heading = tag in HEADINGS and not closing
            out = bool(attributes) and not closing and tag not in CONTAINERS and _opened(tag, attributes, stack[-1]).out
            links = 0
        if tag in CONTAINERS:
            if not closing:
                if tag in _ENDING:  # a page's head or menu that was never closed ends where its text begins
                    for k in range(1, len(stack)):
                        if stack[k].tag in _ENDED:
                            del stack[k:]
                            break
                stack.append(_opened(tag, attributes, stack[-1]))
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in ("article", "body") and tag not in ("article", "main", "body", "html"):
                        break  # a stray end tag closes nothing around the article
    yield from flush()


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def alone(block: Block) -> int:
    """The first pass: a block's own label."""
    size = len(block.text) - block.text.count(" ")
    links = block.linked / size if size else 0.0
    if block.out:
        return BAD
    article = block.region == ARTICLE
    if links >= LINKS_MANY:
        return AMBIGUOUS if block.heading else BAD
    if block.text.startswith(("©", "(c) ", "Copyright")) and len(block.text) < LONG and not article:
        return BAD
    if len(block.text) < SHORT:
        return BAD if links >= LINKS_SOME and not article else AMBIGUOUS
    share = _stop_share(block.text)
    if share >= STOP_HIGH or (share >= STOP_LOW and len(block.text) >= LONG):
        return GOOD
    if share >= STOP_LOW or article:
        return AMBIGUOUS
    return BAD


def labels(found: list[Block]) -> list[int]:
    """The second pass: ambiguous blocks take the label of the nearest decided block in their region."""
    own = [alone(b) for b in found]
    out = list(own)
    for region in {b.region for b in found}:
        # what is kept out decides nothing around it, but in a body, where it is a neighbour like others
        places = [k for k, b in enumerate(found)
                  if b.region == region and (region == BODY or not b.out) and (region != ARTICLE or own[k] != BAD)]
        before, after = [], []
        last = None
        for p, k in enumerate(places):
            if own[k] != AMBIGUOUS:
                last = p
            before.append(last)
        last = None
        for p in range(len(places) - 1, -1, -1):
            if own[places[p]] != AMBIGUOUS:
                last = p
            after.append(last)
        after.reverse()
        tie = BAD if region == BODY else GOOD
        for p, k in enumerate(places):
            if own[k] != AMBIGUOUS:
                continue
            b, a = before[p], after[p]
            near = [own[places[q]] for q in (b, a) if q is not None]
            if found[k].heading and a is not None:
                out[k] = own[places[a]]
            elif not near:
                out[k] = GOOD
            elif len(near) == 1:
                out[k] = near[0]
            elif near[0] == near[1] or p - b < a - p:
                out[k] = near[0]
            else:
                out[k] = near[1] if a - p < p - b else tie
    return out


def main_text(page: str) -> str:
    """The main text of one page; empty if it has none."""
    found = list(blocks(page))
    label = labels(found)
    for region in (ARTICLE, MAIN, PART, BODY):
        text = " ".join(b.text for b, x in zip(found, label) if x == GOOD and b.region <= region)
        if text:
            return text
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    def run(batches):
        for batch in batches:
            texts = [main_text(page or "") for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64(), size=len(texts))], ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
