"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser is fed piece by piece; its events become lines, one a block of text. Each line has a
text-to-tag ratio: its characters outside links by the tags within it. The ratios, smoothed over neighbouring lines, are split in two
clusters at a threshold; lines above it seed content regions. A region grows over the article, main or other element that
most of it lies in, so short paragraphs between long ones and at the ends stay, but link lists and other blocks of many links don't. Lines in elements
that never hold an article (menus, footers, forms and such) are no candidates, nor are those in elements whose class, id or
role marks them as such, unless these hold the article or most of the content.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import free, table, with_python

SKIP = frozenset("script style noscript template svg math iframe object canvas head title select option textarea button nav header footer aside form menu dialog audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Words that mark what surrounds an article, and words that may stand beside them in one class or id name: "site-header" and "share-buttons" are
#: marks, as all their words are in these two, but "related-work", "has-sidebar" and "article-header" aren't. A name of the latter alone marks nothing.
MARKS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies copyright disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe widget".split())
BESIDE = frozenset("area bar block body bottom box btn button buttons cell col column container content form global group inner item items left link links list outer page panel posts region right row section signup site slot stories top unit web wrap wrapper".split())
#: What a head may hold; anything else ends it where its end tag is left out.
IN_HEAD = frozenset("title style script noscript template meta link base".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: An open p ends where one of these begins; an li, dd, dt, td, th or tr ends at the next of its kind.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: What the implied end of an element doesn't reach across.
SCOPE = frozenset("table ul ol dl div article section main body html td th blockquote".split())

#: Marked sections that the standard parser knows.
SECTIONS = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])", re.I)
#: Ends of a tag, a comment and a marked section, as the standard parser takes them.
TAG_END, COMMENT_END, SECTION_END = re.compile(">"), re.compile(r"--\s*>"), re.compile(r"\]\s*\]\s*>|\]\s*>")

#: What may hold a run of paragraphs; and blocks that go from a region when they hold no content line and many links.
HOLDS = frozenset("div section article main td th blockquote center".split())
BLOCKS = HOLDS | frozenset("ul ol dl table details fieldset figure address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@lru_cache(65536)
def _marked(names: str) -> bool:
    """Whether one of the class and id names says that its element isn't content."""
    for name in names.lower().split():
        words = set(re.split(r"[^a-z]+", name)) - {""}
        if not MARKS.isdisjoint(words) and words <= MARKS | BESIDE:
            return True
    return False


class _Lines(HTMLParser):
    """Turns events into lines: [text parts, tags, characters in links, main element or None, element, innermost marked element around it or 0].

    All takes time in proportion to the page: what has no end isn't looked for again and again, and open elements are found by name.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, whether it is skipped with all in it, whether it is marked, and whether it is in boxes
        self.named: dict[str, list[int]] = {}  # places of each name in open
        self.scopes: list[int] = []  # and of those of SCOPE
        self.boxes = [0]  # the open elements that aren't inline
        self.kind, self.up = [""], [0]  # of each of these elements, 0 being the page: name, and the element around it
        self.mark = 0  # the innermost open marked element, 0 without any
        self.mark_up = [0]  # of each marked element, the marked one around it
        self.main_marks: list[int] = []  # of each article and main, the innermost marked element around it
        self.skipped = self.links = 0
        self.mains: list[int] = []
        self.n_mains = 0
        self.lines: list[list] = []
        self.line: list | None = None
        self.ending = False
        self.held, self.none_from = "", {}

    def _absent(self, what: str, i: int, end: re.Pattern[str]) -> bool:
        """Whether no `end` follows place i of what is held just now; once that is known, it isn't looked for again."""
        if self.held is not self.rawdata:
            self.held, self.none_from = self.rawdata, {}
        if i >= self.none_from.get(what, len(self.rawdata)):
            return True
        if end.search(self.rawdata, i):
            return False
        self.none_from[what] = i
        return True

    def parse_starttag(self, i: int) -> int:
        return -1 if self._absent("tag", i, TAG_END) else super().parse_starttag(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        return -1 if self._absent("comment", i + 4, COMMENT_END) else super().parse_comment(i, report)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Declarations without a known name are comments up to the next >, where the standard parser gives up the page."""
        if not SECTIONS.match(self.rawdata, i):
            return self.parse_bogus_comment(i, report)
        end = -1 if self._absent("section", i + 3, SECTION_END) else super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, report) if end < 0 and self.ending else end

    def close(self) -> None:
        """What follows the last > of the page can't end a tag, so it is text."""
        self.ending = True
        cut = self.rawdata.rfind(">") + 1
        tail, self.rawdata = self.rawdata[cut:], self.rawdata[:cut]
        super().close()
        if tail and self.cdata_elem is None:
            self.handle_data(unescape(tail))

    def _break(self) -> None:
        self.line = None

    def _tag(self) -> None:
        if self.line is not None:
            self.line[1] += 1

    def _end_head(self) -> None:
        """Leaves a head without an end tag."""
        if self.open and self.open[-1][0] == "head":
            self._pop()
            self._break()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in CLOSES_P:
            self._implied({"p"})
        if tag in SAME:
            self._implied(SAME[tag])
        if tag not in INLINE:
            self._break()
        self._tag()
        if tag == "br" and self.line is not None:
            self.line[0].append(" ")
        if tag in VOID:
            return
        a = dict(attrs)
        skip = (tag in SKIP and not (tag == "header" and self.mains)) or "hidden" in a or (a.get("aria-hidden") or "") == "true"
        mark = tag not in ("html", "body", "article", "main") and (_marked(f"{a.get('class') or ''} {a.get('id') or ''}") or (a.get("role") or "").lower() in ROLES)
        self.named.setdefault(tag, []).append(len(self.open))
        if tag in SCOPE:
            self.scopes.append(len(self.open))
        self.open.append((tag, skip, mark, tag not in INLINE))
        if tag not in INLINE:
            self.up.append(self.boxes[-1])
            self.boxes.append(len(self.kind))
            self.kind.append(tag)
        self.skipped += skip
        if mark:
            self.mark_up.append(self.mark)
            self.mark = len(self.mark_up) - 1
        self.links += tag == "a"
        if tag in ("article", "main"):
            self.mains.append(self.n_mains)
            self.n_mains += 1
            self.main_marks.append(self.mark)

    def _pop(self) -> str:
        tag, skip, mark, box = self.open.pop()
        self.named[tag].pop()
        if tag in SCOPE:
            self.scopes.pop()
        if box:
            self.boxes.pop()
        self.skipped -= skip
        if mark:
            self.mark = self.mark_up[self.mark]
        self.links -= tag == "a"
        if tag in ("article", "main"):
            self.mains.pop()
        return tag

    def _implied(self, names: set[str]) -> None:
        at = max((self.named[n][-1] for n in names if self.named.get(n)), default=-1)
        if at >= 0 and at >= (self.scopes[-1] if self.scopes else -1):
            while len(self.open) > at:
                self._pop()
            self._break()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._break()
        self._tag()
        if own := self.named.get(tag):
            at = own[-1]
            while len(self.open) > at:
                self._pop()

    def handle_data(self, data: str) -> None:
        if self.skipped and data.strip():
            self._end_head()
        if self.skipped:
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = [[], 0, 0, self.mains[0] if self.mains else None, self.boxes[-1], self.mark]
            self.lines.append(self.line)
        self.line[0].append(data)
        if self.links:
            self.line[2] += len(data)


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean over neighbours; at the ends over those there are."""
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, k)[r : r + len(x)] / np.convolve(np.ones(len(x)), k)[r : r + len(x)]


def _threshold(x: np.ndarray) -> float:
    """Halfway between the means of the two clusters that two-means finds; below all if they don't differ."""
    t = x.mean()
    for _ in range(20):
        low, high = x[x <= t], x[x > t]
        if not len(low) or not len(high):
            return float(x.min()) - 1
        if (new := (low.mean() + high.mean()) / 2) == t:
            break
        t = new
    return float(t) if high.mean() > 3 * low.mean() else float(x.min()) - 1


def _content(lines: list[tuple], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line's smoothed ratio is in the upper cluster, and whether its own ratio is."""
    ratio = np.array([max(0, len(t) - links) / max(1, tags) for t, tags, links, *_ in lines], dtype=float)
    smooth = _smooth(ratio, sigma)
    limit = _threshold(smooth)
    return (smooth > limit) & (ratio > 0), (ratio > limit) & (ratio > 0)


def _unmarked(lines: list[tuple], main_marks: list[int], mark_up: list[int], sigma: float) -> list[tuple]:
    """Lines without those in marked elements, such as comments; a marked element around the content itself is a wrapper and doesn't count.

    That is one around an article or main, if no other article or main with text stands outside the marked ones; or on
    pages without these elements, one with more than half of the content characters in it.
    """
    if not any(mark for *_, mark in lines):
        return lines
    wrapper = [False] * len(mark_up)
    if around := [main_marks[m] for m in {x[3] for x in lines} if m is not None]:
        for mark in around if all(around) else ():
            while mark and not wrapper[mark]:
                wrapper[mark], mark = True, mark_up[mark]
    else:
        weight, total = [0] * len(mark_up), 0
        for (t, *_, mark), good in zip(lines, _content(lines, sigma)[0], strict=True):
            if good:
                total += len(t)
                weight[mark] += len(t)
        for mark in range(len(mark_up) - 1, 0, -1):  # inner ones have larger numbers
            wrapper[mark] = 2 * weight[mark] > total
            weight[mark_up[mark]] += weight[mark]
    clear = [True] * len(mark_up)  # only wrappers around
    for mark in range(1, len(mark_up)):
        clear[mark] = wrapper[mark] and clear[mark_up[mark]]
    return [x for x in lines if clear[x[-1]]]


def main_text(html: str, sigma: float = 1.0) -> str:
    """The blocks of the main content in page order, joined by two line ends; empty if there are none."""
    parser = _Lines()
    for at in range(0, len(html), 65536):  # streaming: the parser keeps only what an event needs
        parser.feed(html[at : at + 65536])
    parser.close()
    lines = [(t, *rest) for parts, *rest in parser.lines if (t := " ".join("".join(parts).split()))]
    lines = _unmarked(lines, parser.main_marks, parser.mark_up, sigma)
    if not lines:
        return ""
    return "\n\n".join(x[0] for x, good in zip(lines, _region(lines, parser.kind, parser.up, sigma), strict=True) if good)


def _region(lines: list[tuple], kind: list[str], up: list[int], sigma: float) -> list[bool]:
    """Whether each line belongs to a content region; seeds are the lines of the upper cluster that aren't mostly links.

    A region closes over the lines between and beside its seeds: all of an article or main where these hold at least half of the seeds'
    characters; else, in the innermost element with three quarters of them, lines between its first and last seed, and lines that
    stand in one container with a seed. Seeds elsewhere then stay where a line of their container has a high ratio without its neighbours. Blocks without a line of high ratio and with over a third of their text in
    links go from regions, and so do lines with over half of it, except headings.
    """
    linked = [2 * links > len(t) for t, _, links, *_ in lines]
    content, own = _content(lines, sigma)
    seed = [bool(c) and not k for c, k in zip(content, linked, strict=True)]
    firm = [good and bool(high) for good, high in zip(seed, own, strict=True)]  # not only by their neighbours
    chars, links, weight, firms = ([0] * len(kind) for _ in range(4))
    within: dict[int | None, int] = {}
    for (t, _, in_links, main, box, _), good, high in zip(lines, seed, firm, strict=True):
        firms[box] += high
        chars[box] += len(t)
        links[box] += in_links
        if good:
            weight[box] += len(t)
            within[main] = within.get(main, 0) + len(t)
    for i in range(len(kind) - 1, 0, -1):
        for x in (chars, links, weight, firms):
            x[up[i]] += x[i]
    total = weight[0]
    if not total:
        return [False] * len(lines)
    gone, holder = [False] * len(kind), [0] * len(kind)
    for i in range(1, len(kind)):
        gone[i] = gone[up[i]] or (kind[i] in BLOCKS and not firms[i] and 3 * links[i] > chars[i])
        holder[i] = i if kind[i] in HOLDS else holder[up[i]]
    stays = [not gone[box] and (not k or kind[box] in HEADINGS) for (*_, box, _), k in zip(lines, linked, strict=True)]
    outside = within.pop(None, 0)
    if within and total - outside >= outside:
        return [main in within and ok for (_, _, _, main, *_), ok in zip(lines, stays, strict=True)]
    scope = holder[max(i for i in range(len(kind)) if 4 * weight[i] >= 3 * total)]
    inside = [False] * len(kind)
    for i in range(len(kind)):
        inside[i] = i == scope or inside[up[i]]
    at = [n for n, (x, good) in enumerate(zip(lines, seed, strict=True)) if good and inside[x[4]]]
    beside = {holder[lines[n][4]] for n in at} - {0}
    strong = {holder[x[4]] for x, high in zip(lines, firm, strict=True) if high}
    return [(good and ok and (inside[x[4]] or holder[x[4]] in strong)) or (inside[x[4]] and ok and (at[0] < n < at[-1] or holder[x[4]] in beside)) for n, (x, good, ok) in enumerate(zip(lines, seed, stays, strict=True))]


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the column html replaced by text; the other columns stay.

    Null and empty pages, and those without content, give an empty text. Pages are worked on alone and whole; repeated rows and null ids give
    a row each, an empty table none. A column named text is replaced.
    """
    own = free(pages, "__html")
    ready = pages.withColumn(own, F.coalesce(html, F.lit(""))).drop(html, "text")
    return with_python(ready, own, lambda texts: {"text": [main_text(t) for t in texts]}, "text string", rows=64)


def op2_html(spark, sf_dir):
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
