"""Main text of web pages by line-block distribution.

Markup is stripped into blocks (lines): the text between block-level tags. Each
line gets a length as evidence of article text. Parts that never are article
text by their element or role (menus, headers, footers, sidebars, forms), or by
a class or id whose words all name such parts, have none; on pages that mark
their article, neither has what lies outside. Lines that are doubtful, by the
name of a text element or by their links, have a part of their length, or none
if they are short. The others have all of it.

The block distribution is the sum of lengths over a window of lines. Where that
of the sure lines leaves zero it surges, where it falls back it dives; what lies
between is article text, doubtful lines too. A doubtful line before the surge or
after the dive is not, and `window` such lines on end make a dive. Without
article marks, stretches that are small beside the largest one go, unless they
lie between large ones or close to one and read as sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.common import map_texts

WINDOW = 3
#: Without article marks: a stretch with less than this share of the largest one's text goes.
SMALL = 0.15
#: A block with at least this share of link text is doubtful.
LINKED = 0.6
#: Share of a doubtful line's length that counts, and the least that does.
DOUBT = 0.25
LEAST = 10

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is not text at all.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video xmp noembed noframes".split())
#: Elements that never are part of an article's text.
ASIDE = frozenset("nav footer aside form header menu button select dialog head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id that name such parts, on any element; and those that do on containers but may be subjects of text.
PARTS = frozenset("ad ads adbox adsense advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus footer menu nav navbar navigation newsletter pagination paywall popup promo promos promoted promotion share sharing sidebar sponsor sponsored sponsors subscribe subscription".split())
MAYBE = frozenset("banner consent copyright header masthead modal notice notices notification notifications related replies respond side social toolbar widget widgets".split())
#: Words beside them that say where or in what form, not about what.
LAYOUT = frozenset("site main page post posts entry article articles story content box bar block area section container wrap wrapper inner outer list item items link links button buttons icon icons left right top bottom primary secondary global local mobile desktop user sign signup form text slot unit module row col column panel group js sticky fixed inline reader readers".split())
#: Elements that hold text rather than parts of a page.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre span b i em strong u small figcaption caption a code".split())
_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<decl>[!?][^>]*(?:>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_MARKS = re.compile(r"[\W_]+")
_SPACE = re.compile(r"\s+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_]+")
_ENDS = (".", "!", "?", "…", ":", '"', "”", "»", ")")


def names_part(value: str) -> int:
    """For a class or id: 2 if one of its names stands for a part of PARTS, 1 for one of MAYBE, else 0.

    A name counts if every word of it is a part's or says where or in what form it is.
    """
    found = 0
    for name in value.split():
        words = [w.lower() for w in _PART.findall(name) if not w.isdigit()]
        if words and all(w in PARTS or w in MAYBE or w in LAYOUT for w in words):
            found = max(found, 2 if any(w in PARTS for w in words) else int(any(w in MAYBE for w in words)))
    return found


def _noisy(name: str, attrs: str, article: int) -> int:
    """2 for an element that never is article text, 1 for a doubtful one, else 0."""
    if name in ASIDE and not (name == "header" and article):  # an article's own header holds its title
        return 2
    if name in ("html", "body", "article", "main") or not attrs:
        return 0
    found = 0
    for m in _NAMED.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return 2
        if key == "role" and value.lower() in _ROLES:
            return 2
        if key in ("class", "id") and not (article and value.lower() == "header"):
            kind = names_part(value)
            found = max(found, (2 if name not in TEXTUAL or (kind == 2 and key == "class") else 1) if kind else 0)
    return found


def blocks(html: str) -> list[tuple[str, int, int, bool]]:
    """(text, letters and digits of links, 2 or 1 in a part that is not or may not be article text, in an article) of each block."""
    out: list[tuple[str, int, int, bool]] = []
    held: list[str] = []
    linked = 0
    open_: list[tuple[str, int]] = []  # elements and how noisy they are
    number = Counter()  # open elements by name: an end tag that closes none looks at none
    noisy = [0, 0, 0]
    article = links = 0

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append((text, linked, 2 if noisy[2] else int(noisy[1] > 0), article > 0))
        held.clear()
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if s:
            s = unescape(s) if "&" in s else s
            held.append(s)
            if links:
                linked += len(_MARKS.sub("", s))

    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in RAW and not m["end"]:
            if m["attrs"].endswith("/") and name in ("svg", "math", "object"):
                continue
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            if stop is None:
                at = len(html)
            else:
                end = html.find(">", stop.end())
                at = len(html) if end < 0 else end + 1
            continue
        if name in BLOCKS:
            close()
        elif name in ("br", "wbr", "img"):
            held.append(" " if name == "br" else "")
        if name in VOID:
            continue
        if m["end"]:
            for k in range(len(open_) - 1, -1, -1) if number[name] else ():
                if open_[k][0] == name:
                    for gone, bad in open_[k:]:
                        noisy[bad] -= 1
                        number[gone] -= 1
                        article -= gone in ("article", "main")
                        links -= gone == "a"
                    del open_[k:]
                    break
        elif not m["attrs"].endswith("/") or name not in ("path", "use"):
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and open_ and open_[-1][0] == name:
                noisy[open_.pop()[1]] -= 1
                number[name] -= 1
            if name == "a" and links:
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == "a":
                        noisy[open_[k][1]] -= 1
                        del open_[k]
                        links -= 1
                        number["a"] -= 1
                        break
            bad = _noisy(name, m["attrs"], article)
            open_.append((name, bad))
            number[name] += 1
            noisy[bad] += 1
            article += name in ("article", "main")
            links += name == "a"
    close()
    return out


def evidence(got: list[tuple[str, int, int, bool]]) -> tuple[np.ndarray, np.ndarray, bool]:
    """(length, whether sure) of each line, and whether the page marks its article."""
    marked = any(a and bad < 2 for _, _, bad, a in got)
    length, sure = np.zeros(len(got), dtype=np.int64), np.zeros(len(got), dtype=bool)
    for k, (t, n, bad, a) in enumerate(got):
        if bad == 2 or (marked and not a):
            continue
        doubtful = bad == 1 or (not marked and n > 0 and n >= LINKED * len(_MARKS.sub("", t)))
        counts = int(len(t) * DOUBT) if doubtful else len(t)
        if not doubtful or counts >= LEAST:
            length[k], sure[k] = counts, not doubtful
    return length, sure, marked


def stretches(length: np.ndarray, sure: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(first, last) line between each surge and its dive of the distribution of sure lengths."""
    own = np.where(sure, length, 0)
    total = np.concatenate([[0], np.cumsum(own), np.full(window, own.sum())])
    spread = total[window : window + len(own)] - total[: len(own)]  # the lengths of the lines from each line on
    up = np.flatnonzero((spread > 0) & (np.concatenate([[0], spread[:-1]]) == 0))
    down = np.flatnonzero((spread > 0) & (np.concatenate([spread[1:], [0]]) == 0))
    at = np.flatnonzero(own)
    return [(int(at[np.searchsorted(at, a)]), int(b)) for a, b in zip(up.tolist(), down.tolist(), strict=True)]


def main_text(html: str | None, window: int = WINDOW) -> str:
    """The article's blocks, joined by line feeds; empty if there is none."""
    got = blocks(html) if html else []
    if not got:
        return ""
    length, sure, marked = evidence(got)
    found = stretches(length, sure, window)
    size = [int(length[a : b + 1].sum()) for a, b in found]
    large = [marked or n >= SMALL * max(size) for n in size]
    keep = np.zeros(len(got), dtype=bool)
    for k, (a, b) in enumerate(found):
        if not large[k] and not (any(large[:k]) and any(large[k:])):
            gap = min((max(a - y, x - b) for (x, y), big in zip(found, large, strict=True) if big))
            if gap > 2 * window or not all(got[n][0].endswith(_ENDS) for n in range(a, b + 1) if length[n]):
                continue
        keep[a : b + 1] = True
    keep &= length > 0
    return "\n".join(t for (t, *_), k in zip(got, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """pages (all columns, or those named) with the main text and its code points.

    Null, empty and markup-only html gives the empty text. Whole pages are read,
    nothing is cut or capped. Repeated rows each return; an empty table stays
    empty. Columns named text_col or n_chars are replaced.
    """
    def run(htmls: list) -> list[list]:
        got = [main_text(h) for h in htmls]
        return [got, [len(t) for t in got]]

    return map_texts(pages, html_col, [(text_col, "string", pa.string()), ("n_chars", "long", pa.int64())], run, columns)
