"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one a block element.  Each line weighs its text
outside links; the sum over a window of lines is the distribution.  Text
starts at a surge (a window above ``surge``) and ends at a dive (a window that
fell to nothing).

The distribution of lengths alone cannot tell a one-sentence advert from a
one-sentence paragraph, so lines inside elements that name themselves as
something else (nav, aside, footer, form, class="ad" ...) weigh nothing and
are never text, and where the page marks its article the distribution is
taken over the article's lines with a surge threshold of one character, unless
the lines outside hold more text by the distribution than the article does
(teaser cards marked as articles).  A form or a class hint names something
else only while it holds little: where its unlinked text reaches the surge and
is more than half of the page's, it is a wrapper and its lines count, unless an
article stands outside of it.
Every other line between a surge and its dive is kept whole.

On a page that marks no article, position and boxes (div, section, table cell
...) join the distribution.  A surge must begin at a line of some weight of its
own, and a dive comes where a window weighs less than such a line, so a word
above the title or a line of terms below the last paragraph belongs to no
surge.  The lines of a surge are taken box by box: boxes at its ends that hold
under a quarter of the heaviest box of the page (a notice before the text, a
card after it) go, what lies between heavy boxes stays.  Short lines next to
what is kept stay when they stand in its box, and headings right above it.

Defined results: a null, empty or text-free page gives the empty text; markup
that is never closed ends with its enclosing element, a head at the body or
the first element or text that cannot be in it, a title at the next tag; only
a comment, script or style runs to the page's end, as in HTML; repeated rows
give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick, table
from .textnum import map_blocks

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
#: Comments and tags.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
#: Elements whose content is no markup, and elements whose content is no text.
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "iframe", "title")}
_NO_TEXT = frozenset("noscript template select svg math object textarea iframe".split())
_IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript template head html".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter "
                    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav aside footer header menu dialog button figure".split())
_ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|"
    r"side-?bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|header|masthead|comments?|disqus|"
    r"respond|replies|reply|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|"
    r"popup|modal|overlay|widget|toolbar|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Class names that tell of a page's state, not of what the element is.
_STATE = re.compile(r"(?:^|(?<=\s))(?:with|has|have|is|no|not|without|hide|show)[_-]\S+", re.I)
_BOX = frozenset("div section td th fieldset blockquote center details form".split())
_HEADING = ("h1", "h2", "h3", "h4", "h5", "h6")
_ARTICLE_HINT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)(?:$|[\s_-])", re.I)


class _Line:
    __slots__ = ("parts", "linked", "article", "soft", "box", "heading")

    def __init__(self, article: bool, soft: tuple[int, ...]):
        self.parts: list[str] = []
        self.linked = 0
        self.article = article
        self.soft = soft  # the forms and hinted elements around it
        self.box = 0  # the box it stands in, 0: the page itself
        self.heading = False


def _kind(name: str, attrs: str, in_article: bool) -> str:
    """What an element is: "aside", "soft" (aside while it holds little), "article" or ""."""
    if name in ("article", "main"):
        return "article"
    if name in ("body", "html"):
        return ""
    if name in _NO_TEXT or name == "head" or name in _ASIDE and not (name in ("header", "figure") and in_article):
        return "aside"
    hints = " ".join(_STATE.sub("", v.strip("\"'")) for _, v in _ATTR.findall(attrs))
    return "soft" if name == "form" or hints and _HINT.search(hints) and not _ARTICLE_HINT.search(hints) else ""


def page_lines(page: str) -> list[_Line]:
    """The page's blocks in order, without those inside asides."""
    lines = [_Line(False, ())]
    stack: list[tuple[str, str]] = []  # open block elements: name, what they are
    boxes: list[int] = []  # open boxes
    n_boxes = 0
    open_names: Counter[str] = Counter()
    soft: tuple[int, ...] = ()
    asides = articles = links = softs = 0
    at = 0
    unclosed: set[str] = set()  # raw elements without an end tag further on

    def pop() -> str:
        nonlocal asides, articles, soft
        name, kind = stack.pop()
        open_names[name] -= 1
        asides -= kind == "aside"
        articles -= kind == "article"
        if kind == "soft":
            soft = soft[:-1]
        if name in _BOX:
            boxes.pop()
        return name

    def text(raw: str) -> None:
        if stack and stack[-1][0] == "head" and raw.strip():
            pop()
        if asides or not raw:
            return
        if lines[-1].article != (articles > 0) or lines[-1].soft != soft:
            lines.append(_Line(articles > 0, soft))
        if raw.strip() and not "".join(lines[-1].parts).strip():
            lines[-1].box = boxes[-1] if boxes else 0
            lines[-1].heading = any(open_names[h] for h in _HEADING)
        lines[-1].parts.append(raw)
        if links:
            lines[-1].linked += len(raw.strip())

    while m := _TOKEN.search(page, at):
        text(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1] and open_names["head"]:  # the end tag of a head may be left out
            if name == "body" or stack[-1][0] == "head" and name not in _IN_HEAD:
                while pop() != "head":
                    pass
        if not m[1] and name in _RAW:
            end = None if name in unclosed else _RAW[name].search(page, at)
            if end:
                at = end.end()
                continue
            unclosed.add(name)
            if name in ("script", "style"):
                at = len(page)
                break
            if name == "title":
                at = page.find("<", at) if page.find("<", at) >= 0 else len(page)
                continue
        if name == "a":
            links = 0 if m[1] else 1
            continue
        kind = "" if m[1] or name in _VOID else _kind(name, m[3], articles > 0)
        if name in _INLINE and not kind and not (m[1] and open_names[name]):
            continue
        if m[1]:
            if open_names[name]:
                while pop() != name:  # elements left open inside end here
                    pass
        elif name not in _VOID and not m[3].endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1] == (name, ""):
                pop()  # the end tag may be left out
            stack.append((name, kind))
            open_names[name] += 1
            if name in _BOX:
                n_boxes += 1
                boxes.append(n_boxes)
            asides += kind == "aside"
            articles += kind == "article"
            if kind == "soft":
                softs += 1
                soft = (*soft, softs)
        if lines[-1].parts or lines[-1].article != (articles > 0) or lines[-1].soft != soft:
            lines.append(_Line(articles > 0, soft))
        links = 0
    text(page[at:])
    return lines


def spans_of_text(weights: list[int], surge: int, window: int) -> list[tuple[int, int]]:
    """(from, to) of the line ranges between a surge and its dive."""
    n = len(weights)
    sums = [sum(weights[i:i + window]) for i in range(n)]
    out, start = [], None
    for i in range(n):
        if start is None:
            if sums[i] >= surge and weights[i]:
                start = i
        elif not sums[i]:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, n))
    return out


def unmarked_spans(lines: list[_Line], weights: list[int], surge: int, window: int, line: int) -> list[tuple[int, int]]:
    """(from, to) of the line ranges of a page that marks no article."""
    n = len(weights)
    sums = [sum(weights[i:i + window]) for i in range(n)]
    runs, start = [], None
    for i in range(n + 1):
        if start is None:
            if i < n and sums[i] >= surge and weights[i] >= line:
                start = i
        elif i == n or sums[i] < line:
            runs.append((start, i))
            start = None
    held = Counter()
    for i in range(n):
        held[lines[i].box] += weights[i] if weights[i] >= line else 0
    heaviest = max(held.values(), default=0)
    out, done = [], 0
    for a, b in runs:
        heavy = [i for i in range(a, b) if 4 * held[lines[i].box] >= heaviest and weights[i] >= line]
        if not heavy:
            continue
        a, b = heavy[0], heavy[-1] + 1
        kept = {lines[i].box for i in heavy} - {0}
        while a > done and weights[a - 1] and (lines[a - 1].box in kept or lines[a - 1].heading):
            a -= 1
        while b < n and weights[b] and lines[b].box in kept:
            b += 1
        a = max(a, done)
        if a < b:
            out.append((a, b))
            done = b
    return out


def _without_asides(lines: list[tuple[_Line, str]], surge: int) -> list[tuple[_Line, str]]:
    """The lines outside forms and hinted elements, and those inside the ones
    that hold most of the page's text."""
    total, held = Counter(), {}  # unlinked text by "is it the article's", and that of each element
    for x, t in lines:
        n = max(0, len(t) - x.linked)
        total[x.article] += n
        for i in x.soft:
            held.setdefault(i, Counter())[x.article] += n
    wrappers = {i for i, n in held.items()
                if n.total() >= surge and 2 * n.total() > total.total() and n[True] == total[True]}
    return [(x, t) for x, t in lines if wrappers.issuperset(x.soft)]


def main_text(page: str | None, surge: int = 86, window: int = 3, line: int = 40) -> str:
    lines = [(x, " ".join(html.unescape("".join(x.parts)).split())) for x in page_lines(page or "")]
    lines = _without_asides([(x, t) for x, t in lines if t], surge)
    weights = [max(0, len(t) - x.linked) for x, t in lines]
    if any(x.article for x, _ in lines):
        rest = [w for w, (x, _) in zip(weights, lines) if not x.article]
        outside = sum(sum(rest[a:b]) for a, b in spans_of_text(rest, surge, window))
        if outside <= sum(w for w, (x, _) in zip(weights, lines) if x.article):
            lines, surge = [(x, t) for x, t in lines if x.article], 1
            weights = [len(t) for _, t in lines]
    if any(x.article for x, _ in lines):
        ranges = spans_of_text(weights, surge, window)
    else:
        ranges = unmarked_spans([x for x, _ in lines], weights, surge, window, line)
    if not ranges and any(weights):  # a short page: its only text
        ranges = spans_of_text(weights, 1, window)
    return "\n".join(t for a, b in ranges for _, t in lines[a:b])


def extract_pages(pages: DataFrame, surge: int = 86, window: int = 3) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    p = pick(pages, page_id="page_id", url="url", text="html")

    def extract(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x, surge, window) for x in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return map_blocks(p, extract, SCHEMA)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
