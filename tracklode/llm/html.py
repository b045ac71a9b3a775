"""Operator 5: main text of web pages by maximum-scoring subsequence.

A page becomes a row of events: words score positive, tags and dropped
containers negative, and one linear scan finds the contiguous region with the
largest sum.  The weights come from labelled pages, those that mark their text
with one ``<article>`` or ``<main>`` element: the log-odds of each kind of
event outside and inside of it, over about ``SAMPLE`` pages taken by a hash.
Kinds that never lie inside are barriers, but not where one article ends and
another begins.  The region is then drawn out to the ends of the marked
elements that it begins and ends in, or, where the page marks nothing, to those
of the element around it, so that short blocks at its edges stay whatever their
tags weigh.  The text of the region is its block elements in page order,
without containers that are not text (menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments).  Those are known by
their element or by a part of a class name or id: the first or last one, and
for some names any one.  One known by such a name alone stays if it holds more
than half of the page's words and the page marks no text outside of it.

Pages of any length are read whole, in one scan.  Null or empty html gives an empty text; so does a page without words.  Equal
sums go to the region that starts first and, then, ends first.  Repeated rows
give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_field, map_rows, struct

SAMPLE = 2_000
BARRIER = -1000.0
#: Weight of kinds that no labelled page has, where none of their sort has one either.
UNSEEN = -1.0

# Element and class names.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu".split())
PAGE_ONLY = frozenset(["header"])
EXEMPT = frozenset("html body main".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription menu nav navbar navigation breadcrumb breadcrumbs sidebar related recommended share sharing social comment comments disqus footer masthead pagination pager login signup widget toolbar skip".split()
)
ANYWHERE = frozenset("comment comments cookie cookies sidebar disqus gdpr newsletter".split())
SITE = frozenset("site global top".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

_name = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_stop = re.compile("[<>\"']")
_angle = re.compile("[<>]")
#: A tag that the page ends in.
_unended = re.compile("<[a-zA-Z/!?]")
_attribute = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_split = re.compile("[^a-z0-9]+")
_hump = re.compile("(?<=[a-z0-9])(?=[A-Z])")
#: Parts of a class name that say what a container goes without, or beside.
BESIDE = frozenset("no not without with has".split())


def names_dropped(value: str, inside: bool = False) -> bool:
    """Whether one of the class names names something dropped; ``no-sidebar`` and ``market-share-report`` do not."""
    for token in value.split():
        parts = [p for p in _split.split(_hump.sub("-", token).lower()) if p]
        if parts and BESIDE.isdisjoint(parts) and (parts[0] in DROPPED_NAMES or parts[-1] in DROPPED_NAMES or not ANYWHERE.isdisjoint(parts)):
            return True
        if len(parts) == 2 and parts[0] in SITE and parts[1] == "header" and not inside:
            return True
    return False


def dropped(name: str, attributes: str, inside: bool) -> bool | None:
    """Whether an element is a container that is not part of the text; null if only its attributes say so."""
    if name in DROPPED or (name in PAGE_ONLY and not inside):
        return True
    return None if attributes and name not in EXEMPT and by_attributes(attributes, inside) else False


def by_attributes(attributes: str, inside: bool = False) -> bool:
    for m in _attribute.finditer(attributes):
        key, given = m[1].lower(), (m[2] or "").strip("\"'")
        value = given.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if key in ("class", "id") and names_dropped(given, inside):
            return True
        if key == "role" and value in DROPPED_ROLES:
            return True
    return False


def next_tag(html: str, at: int, last: dict[str, int]) -> tuple[int, int, str, str, str] | None:
    """Start, end, "/" of a closing tag, name and attributes of the next tag; the name of comments and declarations is empty.

    Quoted values may have any length and any characters but their quote.  A
    tag with a quote that is never closed (``last`` has the last place of each
    quote) or that meets ``<`` outside of values ends at the next ``>`` if no
    ``<`` stands before it; otherwise its ``<`` is text.
    """
    while (at := html.find("<", at)) >= 0:
        m = _name.match(html, at)
        if m:
            stop = _stop.search(html, m.end())
            while stop and stop[0] in last and stop.start() < last[stop[0]]:
                stop = _stop.search(html, html.find(stop[0], stop.end()) + 1)
            if not stop or stop[0] != ">":
                stop = _angle.search(html, m.end())
            if stop and stop[0] == ">":
                return at, stop.end(), m[1], m[2], html[m.end() : stop.start()]
        elif html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            return at, end + 3 if end >= 0 else len(html), "", "", ""
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at + 2)
            if end >= 0:
                return at, end + 1, "", "", ""
        at += 1
    return None


def events(html: str) -> list[tuple]:
    """(kind, text, inside): kind is "word" with its text, or a tag's name, "/name" or "-name" of a dropped container.

    A container that only its attributes would drop stays if it holds more
    than half of the page's words and no ``<article>`` or ``<main>`` lies
    outside: there the learned weights decide.
    """
    made: list[tuple] = []
    stack: list[tuple[str, int]] = []  # name, and the number of its container or -1
    containers: list[list] = []  # first event, last + 1, whether an element's name drops it
    open_count: dict[str, int] = {}
    inside = 0
    at, n = 0, len(html)
    last = {quote: html.rfind(quote) for quote in "\"'"}

    def close() -> str:
        nonlocal inside
        top, container = stack.pop()
        open_count[top] -= 1
        inside -= top in ("article", "main")
        if container >= 0:
            containers[container][1] = len(made)
        return top

    while at < n:
        tag = next_tag(html, at, last)
        text = html[at : tag[0]] if tag else _unended.split(html[at:], 1)[0]
        if text:
            made.append(("word", text, inside > 0))
        if not tag:
            break
        _, at, closing, name, attributes = tag
        if not name:
            continue
        name = name.lower()
        if closing:
            if name in VOID or not open_count.get(name):
                continue
            was = inside
            while stack[-1][0] != name:
                close()
            if stack[-1][1] >= 0:
                close()
            else:
                close()
                made.append(("/" + name, "", inside > 0 and was > 0))
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        drop = False if name in VOID else dropped(name, attributes, inside > 0)
        if drop is False:
            made.append((name, "", inside > 0))
        else:
            containers.append([len(made), None, bool(drop)])
            made.append(("-" + name, "", inside > 0))
        if name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((name, -1 if drop is False else len(containers) - 1))
            open_count[name] = open_count.get(name, 0) + 1
            inside += name in ("article", "main")
        elif drop is not False:
            containers[-1][1] = len(made)
    return without_dropped(made, containers)


def without_dropped(made: list[tuple], containers: list[list]) -> list[tuple]:
    """The events without what lies in dropped containers; of one that stays, the element's own name."""
    words, marks = [0], [0]
    for kind, text, _ in made:
        words.append(words[-1] + (len(text.split()) if kind == "word" else 0))
        marks.append(marks[-1] + (kind in ("article", "main")))
    ranges = [(a, len(made) if b is None else b, hard) for a, b, hard in containers]
    total, upto = words[-1], 0
    for a, b, hard in ranges:  # what elements drop by their name does not count
        if hard and a >= upto:
            total, upto = total - (words[b] - words[a]), b
    kept, at = [], 0
    for a, b, hard in ranges:
        if a < at:
            continue
        kept += made[at:a]
        if not hard and 2 * (words[b] - words[a]) > total and marks[b] - marks[a] == marks[-1]:
            kept.append((made[a][0][1:], *made[a][1:]))
            at = a + 1
        else:
            kept.append(made[a])
            at = b
    return kept + made[at:]


def count_events(pages: DataFrame, html_col: str, id_col: str, sample: int) -> dict[str, tuple[int, int]]:
    """Of each kind, how many events lie inside and outside of the marked text of labelled pages."""
    total = pages.count()
    share = min(1.0, sample / total) if total else 0.0
    few = pages.filter((F.pmod(F.xxhash64(id_col, html_col), F.lit(1 << 40)) < int(share * (1 << 40))) & F.col(html_col).rlike("(?i)<(article|main)[\\s>]"))
    schema = struct(("kind", "string"), ("inside", "bigint"), ("outside", "bigint"))

    def make():
        def f(cols):
            counts: dict[str, list[int]] = {}
            for html in cols["__html"]:
                found = events(html)
                if sum(k in ("article", "main") for k, _, _ in found) == 1:
                    for kind, text, inside in found:
                        n = len(text.split()) if kind == "word" else 1
                        counts.setdefault(kind, [0, 0])[not inside] += n
            return {"kind": list(counts), "inside": [a for a, _ in counts.values()], "outside": [b for _, b in counts.values()]}

        return f

    counts = map_rows(few.select(F.col(html_col).alias("__html")), make, schema)
    counts = counts.groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    return {r["kind"]: (r["i"], r["o"]) for r in counts.collect()}  # the element names of about ``sample`` pages


def weigh(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Positive weight of words, negative weights of tags."""
    weights = {}
    for kind, (inside, outside) in counts.items():
        odds = math.log((inside + 0.5) / (outside + 0.5))
        if kind == "word":
            weights[kind] = min(3.0, max(0.5, odds))
        elif inside * 99 < outside and outside >= 5 and not kind.startswith("-"):
            weights[kind] = BARRIER
        else:
            weights[kind] = -min(3.0, max(0.05, 0.5 - odds))
    return {"word": 3.0, "article": BARRIER, "/article": BARRIER, "main": BARRIER, "/main": BARRIER} | weights


def sort_of(kind: str) -> tuple[bool, bool]:
    """Tags that no labelled page has weigh like others of their sort: opening or closing, block or not."""
    return kind.startswith("/"), kind.lstrip("/-") in BLOCKS


def weight_of(weights: dict[str, float]) -> Callable[[str], float]:
    """Weights of all kinds: a kind that was not learned has the mean of its sort, barriers aside."""
    sorts: dict[tuple[bool, bool], list[float]] = {}
    for kind, w in weights.items():
        if kind != "word" and not kind.startswith("-") and w > BARRIER:
            sorts.setdefault(sort_of(kind), []).append(w)
    means = {k: sum(v) / len(v) for k, v in sorts.items()}
    return lambda kind: weights[kind] if kind in weights else UNSEEN if kind.startswith("-") else means.get(sort_of(kind), UNSEEN)


def drawn_out(found: list[tuple], start: int, end: int) -> tuple[int, int]:
    """The region up to the ends of the marked elements around its first and last event, or of the element around all of it."""
    if start >= end:
        return start, end
    open_: list[tuple[int, str]] = []  # first event and name of the open elements
    count: dict[str, int] = {}
    around: list[tuple] = []  # first, last + 1 and name of the elements that hold the first or the last event

    def close(at: int) -> None:
        first, name = open_.pop()
        count[name] -= 1
        if first <= start < at or first < end <= at:
            around.append((first, at, name))

    for k, (kind, _, _) in enumerate(found):
        if kind == "word" or kind.startswith("-") or kind in VOID:
            continue
        if not kind.startswith("/"):
            open_.append((k, kind))
            count[kind] = count.get(kind, 0) + 1
        elif count.get(kind[1:]):
            while open_[-1][1] != kind[1:]:
                close(k)
            close(k + 1)
    while open_:
        close(len(found))
    marked = [e for e in around if e[2] in ("article", "main")]
    first = [e for e in marked if e[0] <= start < e[1]]
    last = [e for e in marked if e[0] < end <= e[1]]
    if first or last:
        return max((e[0] for e in first), default=start), min((e[1] for e in last), default=end)
    if any(kind in ("article", "main") for kind, _, _ in found):
        return start, end
    whole = [e for e in around if e[0] <= start and end <= e[1]]
    innermost = max(whole, key=lambda e: e[0], default=None)
    return (innermost[0], innermost[1]) if innermost and innermost[2] not in ("html", "body") else (start, end)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run with the largest positive sum."""
    best, at, total, start, end = 0.0, 0, 0.0, 0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, at = 0.0, i
        total += s
        if total > best:
            best, start, end = total, at, i + 1
    return start, end


def main_text(html: str | None, weights: dict[str, float]) -> str:
    found = events(html or "")
    word, weight = weights["word"], weight_of(weights)
    scores = [word * len(text.split()) if kind == "word" else weight(kind) for kind, text, _ in found]
    # Where one article ends and another begins there is no barrier: several articles of one region stay together.
    edges = [k for k, (kind, _, _) in enumerate(found) if kind in ("article", "/article")]
    for k in edges[1:-1]:
        scores[k] = UNSEEN
    start, end = drawn_out(found, *best_region(scores))
    blocks: list[str] = []
    part: list[str] = []
    for kind, text, _ in [*found[start:end], ("/p", "", False)]:
        if kind == "word":
            part.append(text)
        elif kind in ("br", "td", "th", "/td", "/th"):
            part.append(" ")
        elif kind.lstrip("/-") in BLOCKS:
            block = " ".join(unescape("".join(part)).split())
            if block:
                blocks.append(block)
            part = []
    return "\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sample: int = SAMPLE) -> DataFrame:
    """Columns ``keep`` with ``text`` and ``n_chars`` (code points) of each page."""
    weights = weigh(count_events(pages, html_col, keep[0], sample))
    schema = T.StructType([*(id_field(pages, c) for c in keep), *struct(("text", "string"), ("n_chars", "bigint"))])

    def make():
        def f(cols):
            texts = [main_text(h, weights) for h in cols["__html"]]
            return {c: cols[c] for c in keep} | {"text": texts, "n_chars": [len(t) for t in texts]}

        return f

    return map_rows(pages.select(*keep, F.col(html_col).alias("__html")), make, schema)
