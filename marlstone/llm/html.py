"""Main text of web pages: parser events, text-to-tag ratio, smoothing, threshold clustering.

The standard library's streaming HTML parser turns a page into blocks (the "lines"): runs of
text between tags of block elements, with white space made one space and references decoded. A
block's text-to-tag ratio is its characters over the tags in it. Ratios along the page are
smoothed with a Gaussian kernel; blocks above the threshold (a share of the standard deviation)
form clusters, and clusters select the content:

- all blocks from the first to the last cluster, so a run of short blocks in the middle parts nothing;
- all blocks of an element whose own text lies in clusters for at least ``SHARE`` (for article and
  main elements: the text of their whole subtree), so short blocks at its edges stay;
- if article and main elements hold at least half of the clusters' text, nothing outside of them.

Blocks that are no content whatever their ratio take no part in smoothing: those in elements of
navigation, sidebars, footers, dialogs, scripts, styles and hidden ones, and those in elements that
class, id or role mark as boilerplate (menus, headers, notices, adverts, comments), or in forms. Such
a mark doesn't count on an element that wraps the content: one around an article or main element, or,
on pages without these, around ``WRAPS`` of the text. Inside an article a name counts only if all its
words are boilerplate or neutral ones: ``related-posts`` does, ``related-work`` doesn't.

Defined cases: null and empty pages, and pages without text, give an empty text; unclosed and
crossed tags are closed where HTML implies it, at any depth; a page that isn't HTML is one block; of
clusters all count, so ties don't matter; rows that repeat a page are separate pages; a page of any
length is one string, and the work grows in proportion to it; an empty table gives an empty
result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from marlstone.llm.session import map_batches

PAGES = "page_id bigint, url string, text string, n_chars bigint"
SIGMA = 2.0
THRESHOLD = 0.5
#: Part of an element's text that clusters must hold to select all of it.
SHARE = 0.25
#: Part of a page's text inside a marked element from which the element is a wrapper.
WRAPS = 0.8

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_HIDDEN = frozenset("script style noscript template svg math head title iframe object canvas audio video select option textarea button datalist".split())
_CHROME = frozenset("nav aside footer dialog menu fieldset".split())
_MAIN = frozenset("article main".split())
_SECTIONS = frozenset("article main section div td th form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status".split())
#: Words in class or id that mark what isn't content.
_BOILER = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments respond disqus cookie cookies consent gdpr footer foot header masthead menu navbar nav navigation newsletter notice notices popup modal promo promoted promotion related recommended share sharing social sidebar side skip sponsor sponsored subscribe subscription toolbar widget widgets login signup paywall pagination pager".split()
)
#: Of these, words that mark nothing inside an article or main element.
_IN_MAIN = frozenset("header head side".split())
#: Words that change nothing about a boilerplate name.
_NEUTRAL = frozenset("area articles bar block bottom box button buttons container content group icons inner items left links list message page panel posts reader right section site slot stories text thread top unit user wrap wrapper".split())
#: Elements that an opening tag closes when they are open (HTML's implied end tags).
_CLOSES = {t: frozenset(("p", "head")) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()}
_CLOSES |= {"body": frozenset(("head",)), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
_SCOPE = frozenset("article aside body div footer form header html li main nav ol section table td th ul".split())
_WORDS = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")

NONE, MARKED, HARD = 0, 1, 2


def _marks(name: str, main: bool) -> bool:
    """Whether a class or an id names boilerplate."""
    words = set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
    found = words & _BOILER
    if not main:
        return bool(found)
    return bool(found - _IN_MAIN) and words <= _BOILER | _NEUTRAL


def _chrome(tag: str, attrs, main: bool) -> int:
    """NONE; MARKED: no content unless it wraps all; HARD: no content."""
    if tag in _CHROME:
        return HARD
    grade = MARKED if tag == "form" or tag == "header" and not main else NONE
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v and v.lower() == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
            return HARD
        if not v or tag in ("html", "body", "article", "main"):
            continue
        if k == "role" and v.lower() in _ROLES or k == "id" and _marks(v, main) or k == "class" and any(_marks(c, main) for c in v.split()):
            grade = MARKED
    return grade


class _Tree:
    """Elements of one kind, each after its parent; 0 is the page."""

    def __init__(self):
        self.parent, self.main = [0], [False]

    def add(self, parent: int, main: bool) -> int:
        self.parent.append(parent)
        self.main.append(main)
        return len(self.parent) - 1

    def whole(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = own.copy()
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def inherited(self, flag: np.ndarray) -> np.ndarray:
        """Whether an element or one around it has the flag."""
        out = flag.copy()
        for i in range(1, len(out)):
            out[i] |= out[self.parent[i]]
        return out


class _Blocks(HTMLParser):
    """Collects (text, tags, marked element, section, inside main) for each block that isn't hard chrome."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.marked, self.sections = _Tree(), _Tree()
        self.open: list[tuple[str, bool, int, int, bool]] = []  # tag, hard, marked element, section, main
        self.at: dict[str, list[int]] = defaultdict(list)  # depths at which a tag is open
        self.scopes: list[int] = []
        self.solid: list[int] = []  # depths of elements that aren't inline
        self.text: list[str] = []
        self.tags = 0
        self.hidden = 0

    def _flush(self):
        text = _WHITE.sub(" ", "".join(self.text)).strip()
        if text:
            _, hard, *place = self.open[-1] if self.open else ("", False, 0, 0, False)
            if not hard:
                self.blocks.append((text, self.tags, *place))
            self.tags = 0
        self.text.clear()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in _INLINE:
            self._flush()
            if closes := _CLOSES.get(tag):
                self._close(closes)
        elif tag == "img":
            return
        if tag in _VOID:
            return
        _, hard, mark, section, main = self.open[-1] if self.open else ("", False, 0, 0, False)
        if not hard:
            grade = _chrome(tag, attrs, main)
            hard = grade == HARD
            if grade == MARKED:
                mark = self.marked.add(mark, False)
            if tag in _MAIN and not hard:
                main = self.marked.main[mark] = True
            if tag in _SECTIONS:
                section = self.sections.add(section, tag in _MAIN)
        depth = len(self.open)
        self.open.append((tag, hard, mark, section, main))
        self.at[tag].append(depth)
        if tag in _SCOPE:
            self.scopes.append(depth)
        if tag not in _INLINE:
            self.solid.append(depth)
        self.hidden += tag in _HIDDEN

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID or tag not in _INLINE:
            self._flush()
        self.tags += 1

    def _close(self, tags: frozenset[str]):
        """Closes the nearest of ``tags`` unless an element in between bounds its scope."""
        depth = max((self.at[t][-1] for t in tags if self.at[t]), default=-1)
        if depth >= 0 and depth >= (self.scopes[-1] if self.scopes else 0):
            self._cut(depth)

    def _cut(self, depth: int):
        while len(self.open) > depth:
            tag = self.open.pop()[0]
            self.at[tag].pop()
            self.hidden -= tag in _HIDDEN
            for stack in (self.scopes, self.solid):
                if stack and stack[-1] == len(self.open):
                    stack.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in _INLINE:
            self._flush()
        if self.at[tag] and (tag not in _INLINE or not self.solid or self.solid[-1] < self.at[tag][-1]):
            self._cut(self.at[tag][-1])

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def finish(self):
        self.close()
        self._flush()
        return self.blocks


def _smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    near = np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]
    return np.convolve(x, kernel)[r : r + len(x)] / near


def _content(blocks, marked: _Tree) -> list:
    """The blocks outside marked elements that don't wrap the content."""
    size = np.bincount([b[2] for b in blocks], [len(b[0]) for b in blocks], len(marked.parent))
    whole, holds = marked.whole(size), marked.whole(np.array(marked.main, float)) > 0
    wraps = holds if holds.any() else whole >= WRAPS * whole[0]
    gone = ~wraps
    gone[0] = False
    gone = marked.inherited(gone)
    return [b for b in blocks if not gone[b[2]]]


def main_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    blocks = _content(parser.finish(), parser.marked)
    if not blocks:
        return ""
    text, tags, _, section, main = zip(*blocks, strict=True)
    size, section, main = np.array([len(t) for t in text], float), np.array(section), np.array(main)
    smooth = _smoothed(size / np.maximum(tags, 1), sigma)
    above = smooth >= min(threshold * smooth.std(), smooth.max())
    tree, n = parser.sections, len(parser.sections.parent)
    own, hit = np.bincount(section, size, n), np.bincount(section, size * above, n)
    whole_own, whole_hit, is_main = tree.whole(own), tree.whole(hit), np.array(tree.main)
    own, hit = np.where(is_main, whole_own, own), np.where(is_main, whole_hit, hit)
    chosen = (hit > 0) & (hit >= SHARE * own)
    chosen[0] = False
    take = tree.inherited(chosen)[section]
    first, last = np.flatnonzero(above)[[0, -1]]
    take[first : last + 1] = True
    if 2 * (size * above)[main].sum() >= (size * above).sum():
        take &= main
    return " ".join(t for t, ok in zip(text, take, strict=True) if ok)


def extract(pages: DataFrame, sigma: float = SIGMA, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def each(batch):
        for part in range(0, batch.num_rows, 64):
            rows = batch.slice(part, 64)
            text = [main_text(h, sigma, threshold) for h in rows.column("html").to_pylist()]
            yield [rows.column("page_id"), rows.column("url"), text, [len(t) for t in text]]

    return map_batches(pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html"), each, PAGES)
