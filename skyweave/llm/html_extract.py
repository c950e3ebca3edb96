"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering.

A page's HTML is fed in pieces to the standard library's streaming parser, whose events become lines (block elements).
Each line outside boilerplate elements has a text-to-tag ratio, with link text counted as none; the ratios are smoothed
by a Gaussian and split into two clusters by an iterated mean threshold; the lines above it are content, and the smallest
article, main or other element that holds nearly all of them is the article. All of the article's lines are returned,
however short, with the h1 if it stands outside and the content lines outside, less those of menus, headers, footers,
sidebars, notices, adverts, forms and reader comments (by element, role, or name). An id or class names an element by its
last word, less those of mere layout ("comment-list" does, "comment-on-law" doesn't); ids of headings are anchors and
name nothing. A named element or form isn't boilerplate if it holds most of the text, or the only main, article or h1: it
wraps the page. The headings of a header inside an article or main stay. Words that articles use of their own parts too
(DOUBTFUL: legal, related, widget) and other boilerplate words that don't come last, or name a section of an article by
its id, settle nothing: lines there stay if the clusters take them for content, or if their element is mostly content,
or mostly prose of a ratio near the clusters' threshold, and go otherwise.

Defined results: null or empty HTML, or a page of boilerplate alone, gives an empty text; malformed or truncated HTML is
read to its end; plain text without tags is one line for each of its blocks; elements of equal text share go by the
later, inner one; repeated rows give equal results; an empty table gives an empty one; input columns named like an output
column are replaced. Work is per page, without a shuffle, and linear in a page's length, however it is nested: open
elements are found by the places of their tags, never by walking the stack.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skyweave.llm.common import append_columns, table

#: Element names and the words of boilerplate ids and classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style title head noscript template iframe object svg canvas audio video map".split())
BOILERPLATE = frozenset("nav menu header footer aside button select option textarea dialog label input".split())
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social comment comments disqus respond reply replies pagination pager toolbar skip".split())
DOUBTFUL = frozenset("legal copyright disclaimer related recommended recommendations trending popular rail side foot widget widgets".split())
#: Words of layout, which say nothing of what an element is.
LAYOUT = frozenset("area bar block body bottom box btn button buttons cell col column container content div element fixed form global group holder icon icons inner item items js left line link links list main mobile module outer page panel part post posts primary right row secondary section site slot sticky text title top ui unit wide wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_PARAGRAPH = BLOCK - {"html", "body"}
HOLDERS = frozenset("article main section div td body html blockquote".split())
READERS = frozenset("comment comments disqus respond reply replies".split())
SIGMA, PIECE = 1.0, 1 << 16
#: Shares of the text above which a named element wraps the page: any, and one beside a main or article or named for reader comments, which may outweigh the article.
WRAPS, BESIDE = 0.5, 0.95
_WORD, _SPACE = re.compile(r"[a-z]+"), re.compile(r"\s+")
#: What an element's names say of it.
PLAIN, DOUBT, NAMED = range(3)


class _Lines(HTMLParser):
    """Lines of (text, link characters, tags, whether boilerplate, holder element, innermost named element or form, whether a heading, innermost doubtful element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int, int, int]] = []  # tag, hidden, boilerplate (2: an article's header), holder, named, doubtful
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # places of a tag's open elements in the stack
        self.open_holders: list[int] = []
        self.parents, self.tags_of = [-1], [""]
        self.outer, self.readers, self.named_of = [-1], [False], [0]  # of named elements (0: none), and the named one of a holder
        self.doubts = 0
        self.lines: list[tuple[str, int, int, bool, int, int, bool, int]] = []
        self.words: list[str] = []
        self.links = self.tags = 0
        self.buffer, self.lasts = "", {}

    def _state(self) -> tuple[bool, int, int, int, int]:
        return self.stack[-1][1:] if self.stack else (False, 0, 0, 0, 0)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.words)).strip()
        if text:
            _, poor, holder, named, doubt = self._state()
            self.lines.append((text, self.links, self.tags, poor > 0, holder, named, bool(self.at["h1"]), doubt))
            self.tags = 0
        self.words, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            if tag in ("br", "wbr"):
                self.words.append(" " if tag == "br" else "")
            return
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, HOLDERS | {"li", "td", "th", "dd", "dt"})
        if tag in CLOSES_ITSELF:
            self._close(CLOSES_ITSELF[tag], {"ul", "ol", "dl", "table", "select", "menu"} | HOLDERS - {"td"})
        hidden, poor, holder, named, doubt = self._state()
        hidden = hidden or tag in HIDDEN and not (tag == "head" and self.lines)
        inside = self.at["article"] or self.at["main"]
        if tag == "header" and inside and not poor:
            poor = 2
        elif tag in BOILERPLATE:
            poor = 1
        elif tag in HEADINGS and poor == 2:
            poor = 0
        says = PLAIN if tag in ("html", "body", "main", "article") else NAMED if tag in FORMS else self._says(tag, attrs, bool(inside))
        if says == NAMED:
            self.outer.append(named)
            self.readers.append(self._has(attrs, READERS))
            named = len(self.outer) - 1
        elif says == DOUBT:
            self.doubts += 1
            doubt = self.doubts
        if tag in HOLDERS:
            self.parents.append(holder)
            self.tags_of.append(tag)
            self.named_of.append(named)
            holder = len(self.parents) - 1
            self.open_holders.append(len(self.stack))
        if tag == "body":
            hidden = False
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, hidden, poor, holder, named, doubt))

    @staticmethod
    def _has(attrs, words: frozenset[str]) -> bool:
        return any(name in ("class", "id") and value and not words.isdisjoint(_WORD.findall(value.lower())) for name, value in attrs)

    @staticmethod
    def _says(tag: str, attrs, inside: bool) -> int:
        """What roles, ids and classes say of an element; `inside` an article or main."""
        said = PLAIN
        for name, value in attrs:
            if name == "hidden":
                return NAMED
            if not value:
                continue
            low = value.lower()
            if name == "role" and low in ROLES or name == "aria-hidden" and low == "true" or name == "style" and "display:none" in low.replace(" ", ""):
                return NAMED
            if name not in ("class", "id") or name == "id" and tag in HEADINGS:
                continue
            for token in low.split():
                words = _WORD.findall(token)
                if WORDS.isdisjoint(words) and DOUBTFUL.isdisjoint(words):
                    continue
                last = next((w for w in reversed(words) if w not in LAYOUT and len(w) > 1), "")
                anchor = name == "id" and tag == "section" and inside and last not in READERS
                if last in WORDS and not anchor:
                    return NAMED
                said = DOUBT
        return said

    def _last(self, tags) -> int:
        """The place of the innermost open element of `tags`, or -1."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def _close(self, tags: set[str], within: set[str] | frozenset[str]) -> None:
        """End the innermost open element of `tags`, unless one of `within` stands between."""
        k = self._last(tags)
        if k >= 0 and k >= self._last(within):
            self._cut(k)

    def _cut(self, k: int) -> None:
        for tag, *_ in reversed(self.stack[k:]):
            self.at[tag].pop()
        del self.stack[k:]
        while self.open_holders and self.open_holders[-1] >= k:
            self.open_holders.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        places = self.at[tag]
        if places and (tag in BLOCK or not self.open_holders or places[-1] >= self.open_holders[-1]):  # else a stray end tag
            self._cut(places[-1])

    def _ends(self, i: int, *marks: str) -> bool:
        """Whether one of `marks` stands after place i of the unread text, so that none is looked for in vain twice."""
        if self.buffer is not self.rawdata:
            self.buffer, self.lasts = self.rawdata, {}
        for m in marks:
            if m not in self.lasts:
                self.lasts[m] = self.rawdata.rfind(m)
        return any(self.lasts[m] > i for m in marks)

    def parse_starttag(self, i):
        return super().parse_starttag(i) if self._ends(i, ">") else -1

    def parse_endtag(self, i):
        return super().parse_endtag(i) if self._ends(i, ">") else -1

    def parse_pi(self, i):
        return super().parse_pi(i) if self._ends(i, ">") else -1

    def parse_comment(self, i, report=1):
        return super().parse_comment(i, report) if self._ends(i, "-->", "--!>") else -1

    def parse_html_declaration(self, i):
        """As the library, but '<![' opens a bogus comment up to the next '>', as in the HTML standard, whatever keyword follows; in svg and math, CDATA is text."""
        if not self._ends(i, ">"):
            return -1
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        if self.rawdata.startswith("<![CDATA[", i) and (self.at["svg"] or self.at["math"]):
            if not self._ends(i, "]]>"):
                return -1
            end = self.rawdata.find("]]>", i)
            self.handle_data(self.rawdata[i + 9 : end])
            return end + 3
        return self.parse_bogus_comment(i, 0)

    def handle_data(self, data):
        if not self._state()[0]:
            self.words.append(data)
            if self.at["a"]:
                self.links += len(data)


def read_lines(html: str) -> _Lines:
    parser, at = _Lines(), 0
    while at < len(html):
        size = max(PIECE, len(parser.rawdata))  # what is left unread is read again: twice as much each time
        parser.feed(html[at : at + size])
        at += size
    parser.close()
    parser.flush()
    return parser


def content(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines are content: smoothed ratios at or above the threshold between two clusters; and that threshold."""
    if not len(ratios):
        return np.zeros(0, dtype=bool), 0.0
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    smooth = np.convolve(np.pad(ratios, 3, mode="edge"), kernel / kernel.sum(), mode="valid")
    threshold = smooth.mean()
    for _ in range(20):
        low, high = smooth[smooth < threshold], smooth[smooth >= threshold]
        if not len(low) or not len(high) or abs((new := (low.mean() + high.mean()) / 2) - threshold) < 1e-9:
            break
        threshold = new
    return smooth >= threshold, float(threshold)


def _sums(own: list[float], parents: list[int]) -> list[float]:
    """`own` and that of all descendants; parents come first."""
    total = list(own)
    for k in range(len(own) - 1, 0, -1):
        total[parents[k]] += total[k]
    return total


def wrappers(page: _Lines) -> list[bool]:
    """Which named elements and forms, with all around them, aren't boilerplate (the first stands for none)."""
    own, inside = [0.0] * len(page.outer), [0.0] * len(page.parents)
    for text, links, _, poor, holder, named, _, _ in page.lines:
        if not poor:
            own[named] += max(0, len(text) - links)
            inside[holder] += max(0, len(text) - links)
    held = _sums(own, page.outer)
    wraps = [k == 0 or held[k] > BESIDE * held[0] for k in range(len(held))]

    def free() -> list[bool]:
        out = [True] * len(wraps)
        for k in range(1, len(wraps)):
            out[k] = wraps[k] and out[page.outer[k]]
        return out

    inside = _sums(inside, page.parents)
    for kind in ("main", "article", "h1"):
        now = free()
        if kind == "h1" and not any(now[page.named_of[h]] for h, tag in enumerate(page.tags_of) if tag in ("main", "article") and inside[h]):
            wraps = [w or not r and x > WRAPS * held[0] for w, r, x in zip(wraps, page.readers, held, strict=True)]
        if kind == "h1":
            marks = [(held[named], named) for _, _, _, poor, _, named, heading, _ in page.lines if heading and not poor]
        else:
            marks = [(inside[h], page.named_of[h]) for h, tag in enumerate(page.tags_of) if tag == kind and inside[h]]
        now = free()
        if any(now[named] for _, named in marks):
            continue
        below = [False] * len(wraps)  # below a part for readers that doesn't wrap the page
        for k in range(1, len(wraps)):
            below[k] = below[page.outer[k]] or page.readers[k] and not wraps[k]
        for _, k in sorted(marks, key=lambda m: -m[0]):
            if kind == "main" or not below[k]:
                while k:
                    wraps[k] = True
                    k = page.outer[k]
                break
    return free()


def main_text(html: str | None) -> str:
    """The article's blocks, joined by two newlines."""
    if not html:
        return ""
    page = read_lines(html)
    free = wrappers(page)
    rich = [x for x in page.lines if not x[3] and free[x[5]]]
    if not rich:
        return ""
    mass = np.array([max(0, len(x[0]) - x[1]) for x in rich], dtype=float)
    chosen, threshold = content(mass / np.array([max(1, x[2]) for x in rich]))
    if not mass[chosen].sum():
        chosen = np.ones(len(rich), dtype=bool)
    whole, good, prose, tags = ([0.0] * (page.doubts + 1) for _ in range(4))
    for x, own, weight in zip(rich, mass.tolist(), np.where(chosen, mass, 0).tolist(), strict=True):
        whole[x[7]] += len(x[0])
        prose[x[7]] += own
        tags[x[7]] += max(1, x[2])
        good[x[7]] += weight
    sure = [k == 0 or 2 * good[k] >= whole[k] or 2 * prose[k] >= whole[k] and 2 * prose[k] >= threshold * tags[k] for k in range(page.doubts + 1)]
    kept = [bool(c) or sure[x[7]] for x, c in zip(rich, chosen, strict=True)]
    rich, mass, chosen = [x for x, k in zip(rich, kept, strict=True) if k], mass[kept], chosen[kept]
    inside = [0.0] * len(page.parents)
    for x, weight in zip(rich, np.where(chosen, mass, 0), strict=True):
        inside[x[4]] += float(weight)
    inside = _sums(inside, page.parents)
    most = [h for h in range(len(inside)) if inside[h] >= 0.9 * inside[0]]
    best = max([h for h in most if page.tags_of[h] == "article"] or [h for h in most if page.tags_of[h] == "main"] or most)
    within = [True] * len(inside) if best == 0 else [False] * len(inside)
    for h in range(best, len(inside)):
        within[h] = h == best or page.parents[h] >= 0 and within[page.parents[h]]
    titled = any(x[6] and within[x[4]] for x in rich)
    return "\n\n".join(x[0] for x, is_content in zip(rich, chosen, strict=True) if is_content or within[x[4]] or x[6] and not titled)


FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `text` and its length in code points, n_chars."""

    def run(col: pa.Array) -> list[pa.Array]:
        texts = [main_text(h.as_py()) for h in col]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return append_columns(pages, [html], FIELDS, lambda: run)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
