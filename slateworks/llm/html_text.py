"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of the page is a line. What counts is the length of a line outside of links, 0 for
a line that is mostly links. Over these lengths slide windows of WINDOW lines: a stretch of text surges where a window's
sum reaches SURGE, and dives where it falls to nothing. The text between stays, short lines too; menus and lists of links
are dives wherever they are.

Elements that are never text (scripts, forms, menus, ..) leave one blank line, so a single one does not part a text. Names
of elements (class, id, role) only count where the head of a whole name says so, and only for blocks that are short or
beside a text that surges without them. A marked article ends stretches at its borders and keeps its own short ones; text
outside stays beside it if it is no shorter than half of it, and an article that is short beside the text around is a teaser.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateworks.llm._common import bounded_batches

WINDOW, SURGE = 3, 80
#: Share of a line's characters inside links above which it counts as links only.
LINKS = 0.5
#: Characters up to which a block is dropped for what it is named.
SHORT = 1000
#: Share of the longest article from which text outside stays, and of the text outside below which an article is a teaser.
BESIDE, TEASER = 0.5, 0.25

#: Elements without text of their own.
_NEVER = frozenset("script style noscript template svg math iframe object embed applet canvas audio video map head title select option datalist button textarea input form nav footer aside menu dialog".split())
#: Their content is not markup, up to their end tag.
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element may be called that is no part of the text.
_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist respond replies reply disqus discussion share sharing social related recommended newsletter subscribe subscription signup login search widget widgets toolbar pagination pager copyright disclaimer complementary contentinfo skip header top".split())
#: Parts of a name behind its head, and parts before it that deny it.
_TAILS = frozenset("area bar block body box buttons col column container content form group holder inner item items link links list module outer panel region row section slot text thread unit wrap wrapper".split())
_DENIALS = frozenset("has with no without not non".split())
#: Names that head an article as well as a page.
_HEADERS = frozenset("header top".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s|["'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _hidden(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _named(attributes: str, inside: bool) -> int:
    """2 where a whole class, id or role is one of the words, 1 where it is the head of one, else 0; inside: in an article."""
    most = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() not in ("class", "id", "role"):
            continue
        for token in value.strip("\"'").split():
            parts = [x.lower() for x in _PART.findall(token)]
            if not parts or parts[0] in _DENIALS:
                continue
            last = len(parts) - 1
            while last and (parts[last] in _TAILS or parts[last].isdigit()):
                last -= 1
            if parts[last] in _WORDS and not (inside and parts[last] in _HEADERS):
                most = max(most, 2 if len(parts) == 1 else 1)
    return most


@dataclass
class Page:
    """The lines of a page, blank ones where something was removed: text, length outside of links, article or 0, whether in
    main, and the innermost named element around, or -1; the named elements: how surely named, and the next one around."""

    text: list[str] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    article: list[int] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    named: list[int] = field(default_factory=list)
    elements: list[tuple[int, int]] = field(default_factory=list)


def lines(page: str) -> Page:
    """The blocks of a page in order."""
    out = Page()
    #: name, whether skipped, whether it is a named element
    stack: list[tuple[str, bool, bool]] = []
    around: list[int] = []
    text: list[str] = []
    linked: list[str] = []
    skipped = links = mains = articles = count = titles = 0
    at, end = 0, len(page)

    def add(line: str, length: int) -> None:
        out.text.append(line)
        out.length.append(length)
        out.article.append(count if articles else 0)
        out.main.append(mains > 0)
        out.named.append(around[-1] if around else -1)

    def flush(blank: bool = False) -> None:
        joined = " ".join(html_.unescape("".join(text)).split())
        if joined:
            inside = len(" ".join(html_.unescape("".join(linked)).split()))
            add(joined, len(joined) if titles else 0 if inside > LINKS * len(joined) else len(joined) - inside)
        if blank:
            add("", 0)
        text.clear()
        linked.clear()

    def close(n: int) -> None:
        nonlocal skipped, articles, links, mains, titles
        while len(stack) > n:
            name, skip, is_named = stack.pop()
            skipped -= skip
            articles -= name == "article"
            mains -= name == "main"
            links -= name == "a"
            titles -= name == "h1"
            if is_named:
                around.pop()

    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not skipped:
            text.append(piece)
            if links:
                linked.append(piece)
        if not m:
            break
        if m.end() == at:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not skipped:
                text.append(html_.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1] or m[4]:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in _BLOCK and not skipped:
                flush()
            if found is not None:
                before = skipped
                close(found)
                if before and not skipped:
                    flush(True)
            continue
        attributes = m[3] if m[2] else m[6]
        if name == "br" or name == "wbr":
            if not skipped and name == "br":
                text.append(" ")
            continue
        if name in _BLOCK:
            if not skipped:
                flush()
            # A new block of these kinds ends an open one of the same kind.
            same = ("p",) if name not in ("li", "dd", "dt", "td", "th", "tr", "option") else {"li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "option": ("option",)}[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same:
                    close(i)
                elif stack[i][0] in _BLOCK:
                    break
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            continue
        inside = articles + mains > 0
        skip = name in _NEVER or name == "header" and not inside or name not in ("html", "body") and _hidden(attributes)
        if skip and not skipped:
            flush()
        if name in _RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end if name in ("script", "style") else at
            continue
        sure = 0 if skip or skipped or name not in _BLOCK or name in ("html", "body", "article", "main") or name in _HEADINGS else _named(attributes, inside)
        if sure:
            out.elements.append((sure, around[-1] if around else -1))
            around.append(len(out.elements) - 1)
        stack.append((name, skip, bool(sure)))
        skipped += skip
        count += name == "article" and not articles
        articles += name == "article"
        mains += name == "main"
        links += name == "a"
        titles += name == "h1"
    flush()
    return out


def surges(lengths: list[int], least: int = SURGE, window: int = WINDOW) -> list[tuple[int, int, bool]]:
    """Stretches of lines, begin and end, and whether they surge: from where the sum over a window rises above nothing to
    where it dives to nothing again; it surges if some window's sum reaches the least."""
    upto = [0, *accumulate(lengths)]
    n = len(lengths)
    sums = [upto[min(i + window, n)] - upto[i] for i in range(n)]
    out, begin = [], 0
    while begin < n:
        if not lengths[begin]:
            begin += 1
            continue
        end = begin
        while end < n and sums[end]:
            end += 1
        out.append((begin, end, max(sums[begin:end]) >= least))
        begin = end
    return out


def _dropped(page: Page) -> set[int]:
    """Named elements that go: short ones, and long ones beside a text that surges without any of them."""
    size = [0] * len(page.elements)
    for text, i in zip(page.text, page.named):
        if i >= 0:
            size[i] += len(text)
    for i in range(len(size) - 1, -1, -1):
        if page.elements[i][1] >= 0:
            size[page.elements[i][1]] += size[i]
    gone: set[int] = set()
    clear = {-1}

    def beside() -> tuple[bool, bool]:
        lengths = [x if i in clear else 0 for x, i in zip(page.length, page.named)]
        return any(lengths), any(s for _, _, s in surges(lengths))

    some, surging = beside() if size else (False, False)
    for i, (sure, parent) in enumerate(page.elements):
        if parent in gone or surging or size[i] <= SHORT and (some or sure == 2):
            gone.add(i)
        else:
            clear.add(i)
            some, surging = beside()
    return gone


def main_text(page: str | None) -> str:
    """The blocks of the main text, each with single spaces, joined by two line feeds; empty if there is none."""
    if not page:
        return ""
    found = lines(page)
    gone = _dropped(found)
    text = ["" if i in gone else t for t, i in zip(found.text, found.named)]
    lengths = [x if t else 0 for t, x in zip(text, found.length)]
    zone = found.article if any(z and t for z, t in zip(found.article, text)) else [int(m) for m in found.main]
    stretches: dict[int, list[tuple[int, int, bool]]] = {}
    begin = 0
    for z, group in groupby(zone):
        end = begin + len(list(group))
        stretches.setdefault(z, []).extend((begin + b, begin + e, s) for b, e, s in surges(lengths[begin:end]))
        begin = end
    mass = lambda runs: sum(sum(lengths[b:e]) for b, e, _ in runs)
    outside = stretches.pop(0, [])
    peaks = [i for i, run in enumerate(outside) if run[2]]
    outside = outside[peaks[0] : peaks[-1] + 1] if peaks else []
    articles = {z: mass(runs) for z, runs in stretches.items() if mass(runs)}
    kept = [run for z in articles for run in stretches[z] if articles[z] >= TEASER * mass(outside)]
    if mass(outside) >= BESIDE * max(articles.values(), default=0):
        kept += outside
    if not kept:
        every = [run for run in surges(lengths) if run[1] > run[0]]
        kept = sorted(every, key=lambda r: -mass([r]))[:1] or [(0, len(text), False)] * any(zone)
        if not every:
            text = [t if z else "" for t, z in zip(text, zone)]
    return "\n\n".join(t for b, e, _ in sorted(kept) for t in text[b:e] if t)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    A null or empty html, and one without text, give an empty text of 0 characters. Repeated rows give repeated results, other
    columns are not read, and an empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h) for h in batch], dtype=object)

    out = pages.select("page_id", "url", run(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
