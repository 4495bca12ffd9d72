"""Main text of web pages by the line-block distribution (operator 3).

The markup is stripped to lines, one for each block of the page.  A line weighs the length of its
text, or nothing if the markup says that it is no content (menu, advert, form, ...).  The weights
are summed over a sliding window of lines; the text starts where the sum surges and ends where it
dives to nothing, and what lies between is kept.  An article or main element only adds weight.

A block is what a block element holds.  A line break (br) within one is white space like any other, so it
becomes one space; a rule (hr) ends a block.
"""

from __future__ import annotations

import dataclasses
import html
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A window must weigh so much to be text.
SURGE = 80
#: A character in an article or main element weighs so much; the others weigh OUTSIDE where such elements hold most of the text.
INSIDE, OUTSIDE = 8, 0.25
#: A block that is named like a form or a menu may be a wrapper if it is so many times as long as the text outside it.
REST = 10

_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template textarea iframe svg object title select".split()}
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']*)))?""")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NO_CONTENT = frozenset("head nav footer aside form menu dialog button header".split())
#: Parts of a name that say what a block is.  Before it may stand anything but a word that says what a block has or has not.
_NO_CONTENT_NAME = re.compile(
    r"""(?<![a-z])(?<!has[-_])(?<!with[-_])(?<!without[-_])(?<!no[-_])(?:
        (?P<remark>comments?|disqus)
      | (?P<extra>ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|share|sharing|social|breadcrumbs?|newsletter|subscribe|popup|login|pagination|contentinfo|complementary|aside|sidebar|notice|footer)
      | (?P<frame>nav|navbar|navigation|menu|header|banner|modal)
      | (?P<word>form|related|search)(?=\Z|[-_](?:posts?|articles?|links?|stories|news|content|items?|reading|pages?|videos?|topics|box|bar|list|group|row|field|fields|input|wrap|wrapper|widget|container|results|area|block|section|panel|left|right|top|bottom|main|\d+)\b)
    )(?![a-z])(?![-_](?:free|less|off)\b)""",
    re.I | re.X,
)
#: What stands within a text and doesn't end it; other marked blocks (menus, footers, ...) do.
_ASIDES = re.compile(r"(?:ads?|advert.*|sponsor.*|promo.*|aside|form|notice|banner|share|sharing|social|related|newsletter|subscribe|search|popup|button|dialog)\Z", re.I)
#: Extras that may be wrappers where the page has no other text.
_LAST = re.compile(r"(?:sidebar|aside|notice|footer)\Z", re.I)
_CONTENT = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_TEXTS = frozenset("p li dt dd td th pre blockquote figcaption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclasses.dataclass(eq=False)
class _Mark:
    """A block that the markup says is no content.

    ``kind``: tag (always dropped), remark, extra, frame or word; ``within`` an article.  ``direct`` is the text in it and in no block inside it, ``size`` also
    that of those inside it that may be wrappers, ``beside`` what is text outside it if it goes.
    """

    name: str
    by: str
    kind: str
    within: bool
    parent: _Mark | None
    depth: int = 1
    size: int = 0
    direct: int = 0
    beside: int = 0
    heading: bool = False
    article: bool = False
    others: bool = False
    away: _Mark | None = None

    @property
    def gap(self) -> int:
        return 1 if self.within or _ASIDES.match(self.by) else WINDOW


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the markup of a page in order, names in lower case; '' for comments and the like.

    Linear in the page: where a quote or a bracket isn't closed once, it isn't looked for again.
    """
    at, size = 0, len(page)
    open_quotes: set[str] = set()  # quotes of which no further one follows
    lost: set[int] = set()  # places outside quotes from which no bracket follows outside quotes
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        named = _NAME.match(page, start)
        if not named and page[start + 1 : start + 2] not in ("!", "?", "/"):
            at = start + 1
            continue
        if (bracket := page.find(">", start)) < 0:
            return
        end = bracket
        if named:
            k, seen = named.end(), []
            while True:
                m = _QUOTE_OR_END.search(page, k)
                if not m or k in lost:
                    lost.update(seen)
                    break
                if m[0] == ">":
                    end = m.start()
                    break
                close = -1 if m[0] in open_quotes else page.find(m[0], m.end())
                if close < 0:
                    open_quotes.add(m[0])
                    lost.update(seen)
                    break
                seen.append(k)
                k = close + 1
        at = end + 1
        name = named[1].lower() if named else ""
        closing = page[start + 1] == "/"
        if name in _RAW and not closing:
            over = _RAW[name].search(page, at)
            at = over.end() if over else size
            yield start, at, "", False, ""
        else:
            yield start, at, name, closing, page[named.end() : end] if named else ""


_QUOTE_OR_END = re.compile(r"""[>"']""")


def _called(name: str, attrs: str, article: bool) -> re.Match | None:
    """What the class, id or role of an element says it is, if that is no content.

    The id of a heading, or of a text in an article, is an anchor called after what is said there; a paragraph that is called by an ordinary word
    is a paragraph.
    """
    values: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    texts = name in _HEADINGS or (name in _TEXTS and article)
    for key in ("class", "id", "role"):
        for token in values.get(key, "").split() if not (key == "id" and texts) else ():
            m = _NO_CONTENT_NAME.search(token)
            if m and not (m["word"] and (name in _TEXTS or name in _HEADINGS)):
                return m
    return None


def _marked_lines(page: str) -> tuple[list[tuple[str, int, bool, _Mark | None]], list[_Mark]]:
    """(text, weight, within an article, innermost marked block) for each line, and the marked blocks in the order in which they begin."""
    lines: list[tuple[str, int, bool, _Mark | None]] = []
    parts: list[str] = []
    marks: list[_Mark] = []
    known: list[_Mark] = []
    by_name: dict[str, list[_Mark]] = {}
    article = links = linked = 0
    heading = False

    def end() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            weight = 0 if not article and 2 * linked > len(text) else len(text) + SURGE * heading
            lines.append((text, weight, article > 0, marks[-1] if marks else None))
        parts.clear()
        linked = 0

    def leave() -> None:
        by_name[marks.pop().name].pop()

    at = 0
    for start, after, name, closes, attrs in _tokens(page):
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += start - at
        at = after
        if not name:
            continue
        if name == "a":
            links = 0 if closes else 1
        if name == "br":
            parts.append(" ")
        elif name not in _INLINE:
            end()
            heading = name == "h1" and not closes
            if marks and heading:
                marks[-1].heading = True
        if name in _VOID:
            continue
        if marks and marks[-1].name == "p" and name not in _INLINE and not closes:  # a paragraph ends where another block begins
            leave()
        own = by_name.get(name)
        own = own[-1] if own else None
        if closes and own:
            own.depth -= 1
            if own.depth <= 0:
                end()
                while marks[-1] is not own:
                    leave()
                leave()
        named = None if closes or name in ("body", "html") else _called(name, attrs, article > 0)
        tagged = not closes and name in _NO_CONTENT and not (name == "header" and article)
        if name in _CONTENT:
            if not closes and marks and not article:
                marks[-1].article = True
            article = max(0, article + (-1 if closes else 1))
            while not article and marks and marks[-1].within:
                leave()
            named = named if named and named["remark"] else None
        if tagged or named:
            end()
            kind = "tag" if tagged and name != "form" else "word" if tagged else named.lastgroup
            if marks:
                marks[-1].others = True
            mark = _Mark(name, name if tagged else next(filter(None, named.groups())), kind, article > 0, marks[-1] if marks else None)
            marks.append(mark)
            known.append(mark)
            by_name.setdefault(name, []).append(mark)
        elif not closes and own:
            own.depth += 1
    parts.append(page[at:])
    end()
    return lines, known


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, within an article) for each block of the page, in order; empty ones are left out.

    The weight is the length of the text, 0 for links; a top heading weighs a surge more.  A marked block
    is one line without text where it stands within a text, and a window of them where it ends one.

    Names mislead, so a named block is no marked block but a wrapper
    - if the top heading of the page lies in it (and in no marked block inside it),
    - if it is named like a frame or a form and an article begins in it, or it holds other marked blocks and ten times the text that stands outside it,
    - if it is named like these, or called a sidebar, notice or footer, and there is no text outside it (of an article: none in articles).
    Comments are wrappers for their heading only, and what is named like adverts and the like also: their length says nothing.
    """
    lines, known = _marked_lines(page)
    free = sum(len(text) for text, weight, _, mark in lines if weight and mark is None)
    inside_free = sum(len(text) for text, weight, inside, mark in lines if weight and inside and mark is None)
    for text, weight, _, mark in lines:
        if mark and weight:
            mark.size += len(text)
            mark.direct += len(text)
    for mark in reversed(known):  # blocks inside come later
        if mark.parent and mark.kind in ("frame", "word"):
            mark.parent.size += mark.size
            mark.parent.heading |= mark.heading
            mark.parent.article |= mark.article
    for mark in known:
        outer = mark.parent
        mark.beside = outer.beside + outer.direct if outer and not outer.away else inside_free if mark.within else free
        if mark.kind == "tag":
            wrapper = False
        elif mark.heading and not mark.within:
            wrapper = True
        elif mark.kind in ("frame", "word"):
            wrapper = mark.article or (mark.size > 0 if not mark.beside else not mark.within and mark.others and mark.size > REST * mark.beside)
        else:
            wrapper = mark.kind == "extra" and bool(_LAST.match(mark.by)) and not mark.beside and mark.size > 0
        mark.away = outer.away if outer and outer.away else None if wrapper else mark

    out: list[tuple[str, int, bool]] = []
    last = None
    for text, weight, inside, inner in lines:
        mark = inner.away if inner else None
        if mark is None:
            out.append((text, weight, inside))
        elif mark is not last:
            out.extend([("", 0, mark.within)] * mark.gap)
        last = mark
    return out


def _kept(weights: list[float]) -> list[bool]:
    """Which lines of a stretch are text: from a surge on to where a whole window weighs nothing."""
    out, within = [], False
    for i, weight in enumerate(weights):
        block = sum(weights[i : i + WINDOW])
        within = block >= SURGE or (within and block > 0)
        out.append(within and weight > 0)
    return out


def main_text(page: str | None) -> str:
    """The main text; '' for a null or empty page or one without any."""
    lines = page_lines(page or "")
    inner, outer = (sum(weight for _, weight, inside in lines if inside == side) for side in (True, False))
    outside = OUTSIDE if inner > outer else 1
    kept: list[str] = []
    # Elements that hold an article begin and end a stretch.
    for side, stretch in itertools.groupby(lines, lambda line: line[2]):
        own = list(stretch)
        weights = [weight * (INSIDE if side else outside) for _, weight, _ in own]
        kept += [text for (text, _, _), keep in zip(own, _kept(weights), strict=True) if keep]
    if not kept:  # a page of a few words has no surge
        kept = [text for text, weight, _ in lines if weight]
    return "\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``, nulls in either key too; other columns are ignored.  There are no ties: a line
    is text or not by its place in its page.

    A null or empty page, and one of nothing but markup and marked blocks, has the empty text.  Rows that
    repeat, and pages with one id, give a row each; the text depends on the page alone.  A page of any
    length is read as a whole, one at a time.
    """

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    out = pages.select("page_id", "url", text_of(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
