"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks on their own:
blocks inside menus, footers, side columns, forms, notices, adverts or reader comments (by element,
role, or a word of class or id) are boilerplate, so is a block of mostly links; a long block with
many stop words is content, a long one with few is boilerplate; the rest is ambiguous.  Where the
page marks its article (``article``, ``main``, ``role=main``, ``itemprop=articleBody``, or a word such as
``content`` in the class or id of a container), blocks of it without such evidence against them are
content whatever their words, and blocks outside it are boilerplate; inside the article, a block of mostly
links or under a name that only often means boilerplate stays if it reads like running text.  On a page
in a language without stop words here, length and link density decide.  In the second pass an ambiguous block inherits the label of its nearest decided
neighbour: content if the nearest ones disagree at equal distance and it has stop words enough to
be nearly content, else boilerplate.

Defined results: null, empty and text-free pages give an empty text; null urls and ids stay null;
repeated pages are extracted alike; unclosed tags, comments and raw elements end with the page;
further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, slices

# Elements by their role in a page.
RAW = ("script", "style", "noscript", "template", "title", "textarea", "select", "button", "iframe", "svg", "math",
       "object", "canvas", "audio", "video", "datalist", "xmp", "noembed", "noframes")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset(
    "article aside blockquote body center details dialog div dl fieldset figure footer form head header li main menu "
    "nav ol search section table tbody td tr ul".split())
BOILER_TAGS = frozenset("nav footer aside form dialog menu search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu "
                         "menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner menu nav "
    "navbar navigation navi breadcrumb breadcrumbs footer sidebar aside widget widgets related recommended "
    "recommendations teaser share sharing social comment comments disqus respond replies discussion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin "
    "search pagination pager toolbar skip masthead topbar copyright legal form "
    "commentlist usercomments adsbygoogle adslot cookiebar topnav sidenav subnav footnav mainmenu".split())
# Of these, the words that sections of an article may have as well.
WEAK_WORDS = frozenset("legal social menu copyright search skip alert banner".split())
CONTENT_WORDS = frozenset("article content post entry story main".split())
# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their "
    "they this to was we were what which who will with you "
    "aber als am an auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit "
    "nach nicht noch oder sich sie sind so um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour "
    "qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos es esta este ha hay las lo los más me mi muy no nos o para pero por porque se sin "
    "sobre su sus también te tiene y ya".split())

SHORT_CHARS, LONG_CHARS = 70, 200
# For the short lists above; running text has about twice as many.
STOP_LOW, STOP_HIGH = 0.08, 0.16
LINK_DENSITY = 0.33

_COMMENT = r"<!--(?:.*?--!?>|.*)"
_RAW_OPEN = r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])"
_RAW_REST = r">(?:(?<=/>)|.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z))"
_QUOTED = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_OTHER = r"|<[!?/][^>]*+(?:>|\Z)"
_TEXT = r"|(?P<text>[^<]+|<)"
#: Markup with quoted attribute values.  ``broken`` is a tag that no > outside quotes ends: from there on LOOSE
#: reads the page, where quotes hide nothing, so that every character is looked at a bounded number of times.
TOKEN = re.compile(
    _COMMENT + _RAW_OPEN + _QUOTED + _RAW_REST
    + r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>" + _QUOTED + r")>|(?P<broken></?[a-z])" + _OTHER + _TEXT, re.S | re.I)
LOOSE = re.compile(
    _COMMENT + _RAW_OPEN + r"[^<>]*+" + _RAW_REST
    + r"|<(?P<close>/?)(?P<tag>[a-z][^\s/<>]*+)(?P<attrs>[^<>]*+)>|</?[a-z][^<>]*+\Z|(?P<broken></?(?=[a-z]))" + _OTHER + _TEXT,
    re.S | re.I)
ATTR = re.compile(r"""(?<![a-z-])(?:([a-z][a-z-]*+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))|(hidden)\b)""", re.I)
WORD_SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
GOOD, BAD, UNSURE, NEARLY = "good", "bad", "unsure", "nearly"


@dataclass
class Block:
    text: str
    link_chars: int
    boiler: bool
    suspect: bool  # inside an article, under a name that boilerplate often has
    heading: bool
    article: int  # 0: outside, 1: in a main element, 2: in an article


def attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(raw)}


def tokens(page: str):
    """Matches of the page's markup and text, in order."""
    for m in TOKEN.finditer(page):
        if m["broken"]:
            yield from LOOSE.finditer(page, m.start())
            return
        yield m


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, white space folded and trimmed, empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # container, inside boilerplate, suspect, inside the article
    opened: Counter = Counter()  # containers of each name in the stack
    parts: list[str] = []
    link_chars, in_link, breaks, heading = 0, False, 0, False

    def end_block():
        nonlocal link_chars, breaks
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, link_chars, *(stack[-1][1:3] if stack else (False, False)), heading, stack[-1][3] if stack else 0))
        parts.clear()
        link_chars, breaks = 0, 0

    for m in tokens(page):
        if (t := m["text"] or m["broken"]) is not None:
            t = html.unescape(t) if "&" in t else t
            parts.append(t)
            if (n := len("".join(t.split()))):
                breaks = 0
                link_chars += n * in_link
            continue
        if not m["tag"]:
            if m["raw"]:
                parts.append(" ")
            continue
        tag = m["tag"].lower()
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                end_block()
            continue
        if tag == "a":
            in_link = not m["close"]
            continue
        if tag not in BLOCK:
            continue
        end_block()
        heading = not m["close"] and tag in HEADINGS
        if tag not in CONTAINER:
            continue
        if m["close"]:
            if opened[tag]:
                while (last := stack.pop()[0]) != tag:
                    opened[last] -= 1
                opened[tag] -= 1
                in_link = False
            continue
        boiler, suspect, article = stack[-1][1:] if stack else (False, False, 0)
        if tag in ("body", "html"):
            continue
        found = attributes(m["attrs"]) if m["attrs"] else {}
        words = set(WORD_SPLIT.split(CAMEL.sub("-", f"{found.get('class', '')} {found.get('id', '')}").lower()))
        role = found.get("role", "").lower()
        against = (tag in BOILER_TAGS or role in BOILER_ROLES or "hidden" in found
                   or found.get("aria-hidden", "").lower() == "true"
                   or "display:none" in found.get("style", "").replace(" ", "").lower()
                   or bool(words & (BOILER_WORDS - WEAK_WORDS if article else BOILER_WORDS))
                   or (not article and (tag == "header" or "header" in words)))
        if tag == "article" and words & {"article", "post", "main"} and not words & {"comment", "comments", "teaser", "related"}:
            against = False
        boiler, suspect = boiler or against, suspect or bool(article and words & WEAK_WORDS)
        if not boiler:
            if tag == "article" or "articlebody" in found.get("itemprop", "").lower():
                article = 2
            elif tag == "main" or role == "main" or tag in ("div", "section", "td") and words & CONTENT_WORDS:
                article = max(article, 1)
        opened[tag] += 1
        stack.append((tag, boiler, suspect, article))
    end_block()
    return out


def stop_density(text: str) -> float:
    words = [w.strip(".,;:!?\"'()[]«»„“”’…-").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def weight(text: str) -> int:
    """Length of a text in letters of an alphabet: a sign of a script without word spaces counts for three."""
    return len(text) if text.isascii() else len(text) + 2 * sum(c >= "\u2e80" for c in text)


def first_pass(blocks: list[Block]) -> list[str]:
    """A label for each block on its own.

    If no long block of an unmarked page has stop words of the lists, the page is in another language: then
    length and link density decide, and a long block of few links is content.
    """
    marked = max((b.article for b in blocks if not b.boiler), default=0)
    links = [b.link_chars / len(b.text.replace(" ", "")) for b in blocks]
    size = [weight(b.text) for b in blocks]
    own = [not b.boiler and x <= LINK_DENSITY for b, x in zip(blocks, links)]
    known = marked or any(stop_density(b.text) >= STOP_LOW for b, n, ok in zip(blocks, size, own) if ok and n >= SHORT_CHARS)
    labels = []
    for b, x, n, ok in zip(blocks, links, size, own):
        if b.boiler or not ok and not (marked and b.article == marked and (x <= 0.8 or running(b.text))):
            labels.append(BAD)
        elif marked:
            labels.append(GOOD if b.article == marked and (not b.suspect or running(b.text)) else BAD)
        elif n < SHORT_CHARS:
            labels.append(BAD if b.link_chars else UNSURE)
        elif not known:
            labels.append(GOOD if n > LONG_CHARS else NEARLY)
        else:
            stops = stop_density(b.text)
            if n > LONG_CHARS:
                labels.append(GOOD if stops >= STOP_HIGH else NEARLY if stops >= STOP_LOW else BAD)
            else:
                labels.append(NEARLY if stops >= STOP_LOW else BAD if b.link_chars else UNSURE)
    return labels


def running(text: str) -> bool:
    """Whether a block reads like a sentence or more, whatever its links and names."""
    return weight(text) >= SHORT_CHARS and stop_density(text) >= STOP_LOW


def second_pass(labels: list[str], headings: list[bool]) -> list[bool]:
    """Whether each block is content; at equal distance a heading goes with what follows."""
    n = len(labels)
    before, after = [n] * n, [n] * n  # distance to the nearest decided neighbour, with its label
    left, right = [BAD] * n, [BAD] * n
    for i in range(n):
        if i and labels[i - 1] in (GOOD, BAD):
            before[i], left[i] = 1, labels[i - 1]
        elif i:
            before[i], left[i] = before[i - 1] + 1, left[i - 1]
    for i in range(n - 2, -1, -1):
        if labels[i + 1] in (GOOD, BAD):
            after[i], right[i] = 1, labels[i + 1]
        else:
            after[i], right[i] = after[i + 1] + 1, right[i + 1]
    kept = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            kept.append(label == GOOD)
        elif left[i] == right[i]:
            undecided_page = before[i] >= n and after[i] >= n
            kept.append(label == NEARLY if undecided_page else left[i] == GOOD)
        elif before[i] != after[i]:
            kept.append((left[i] if before[i] < after[i] else right[i]) == GOOD)
        else:
            kept.append(label == NEARLY or headings[i] and right[i] == GOOD)
    return kept


def extract_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, second_pass(first_pass(blocks), [b.heading for b in blocks])) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``."""
    kinds = dict(pages.dtypes)

    def run(batches):
        for b in slices(batches):
            texts = [extract_text(t) for t in b.column(2).to_pylist()]
            out = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out, pc.cast(pc.utf8_length(out), pa.int64())],
                                             ["id", "url", "text", "n_chars"])

    found = map_arrow(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                                   F.col(html_col).cast("string").alias("html")),
                      run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
