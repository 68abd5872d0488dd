"""Operator 1: main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element. Menus, headers, notices,
adverts, forms and the like become empty lines. Lengths are summed over sliding
windows of lines; text runs from where the sums surge to where they dive to 0.
Where the surging text lies decides which part of the page is the main one: an
article or main element weighs more, but one that holds less than half of that
text is a teaser or a comment and goes. A page is one row, so memory holds one
batch of pages and nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines a window has.
WINDOW = 3
#: Characters a window needs for a surge; those in a main element or an article count WEIGHTS times.
SURGE = 86
WEIGHTS = {"": 1, "main": 2, "article": 4}

# Elements by what they do to the text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = {"nav", "aside", "footer", "form", "noscript", "template", "svg", "math", "select", "button", "dialog", "object", "canvas", "audio", "video", "menu", "head", "fieldset", "datalist"}
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
SPACES = {"br", "td", "th", "wbr", "img", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HOLDERS = {"article", "main", "section", "div", "td", "center"}
LISTS = {"ul", "ol", "dl", "table", "menu"}
NEVER_BY_NAME = {"html", "body", "main"}
#: Start tags that end an open element whose end tag may be left out.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "a": {"a"}}
# Words of an element's class or id that mark it as no part of the article, if all other words of that name are FILLERS.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adsbox sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login register sidebar widget widgets menu submenu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar"
    " share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply discussion copyright legal skip hidden outbrain taboola teaser teasers search".split()
)
FILLERS = set(
    "a an the my top bottom left right upper lower main primary secondary inner outer box block blocks body container content wrap wrapper slot unit area zone bar list item items row col column section part"
    " header head title text label link links icon icons button buttons btn form input field group panel card cards image img site page post posts article articles story stories user blog web global mobile desktop"
    " google responsive sticky fixed small large big js id class module count thread tree".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_MAIN = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes or tag in NEVER_BY_NAME:
        return False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and any(map(_names_unwanted, value.split())):
            return True
    return False


def _names_unwanted(name: str) -> bool:
    parts = {w.lower() for w in _WORD.findall(name)}
    return not parts.isdisjoint(NAMES) and parts <= NAMES | FILLERS


class _Lines:
    """Lines of a page: text, characters within links, the region (article or main element, 0: none) and the holder (the nearest of HOLDERS)."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.linked: list[int] = []
        self.region: list[int] = []
        self.holder: list[int] = []
        self.parts: list[str] = []
        self.links = 0
        self.kinds, self.parents = [""], [0]  # of the regions
        self.open: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, holder, region
        self.n_holders = 0

    def add(self, raw: str, in_link: bool) -> None:
        self.parts.append(raw)
        if in_link:
            self.links += len(raw)

    def _line(self, text: str, linked: int) -> None:
        self.text.append(text)
        self.linked.append(linked)
        self.holder.append(self.open[-1][1])
        self.region.append(self.open[-1][2])

    def end(self) -> None:
        if self.parts:
            line = " ".join(html.unescape("".join(self.parts)).split())
            if line:
                self._line(line, self.links)
            self.parts, self.links = [], 0

    def gap(self) -> None:
        """Something unwanted was here, or a region begins or ends: enough empty lines for a dive."""
        for _ in range(WINDOW):
            self._line("", 0)

    def enter(self, tag: str, kind: str) -> None:
        region = self.open[-1][2]
        if kind:
            self.gap()
            self.parents.append(region)
            self.kinds.append(kind)
            region = len(self.kinds) - 1
        self.n_holders += 1
        self.open.append((tag, self.n_holders, region))

    def leave(self, tag: str) -> None:
        """Closes the innermost such element; a stray end tag closes no article or main element around it."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if self.open[i][2] != self.open[i - 1][2]:
                    self.gap()
                del self.open[i:]
                return
            if self.open[i][0] in ("article", "main") and tag not in ("article", "main"):
                return


def lines(page: str) -> _Lines:
    out, at, n = _Lines(), 0, len(page)
    depth = nested = link = 0
    skip = ""
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not skip:
            out.add(text, link > 0)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        close, tag, attributes = bool(m[1] or m[4]), tag.lower(), m[3] or m[6] or ""
        if tag in RAW and not close:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if skip:
            if tag in LISTS and skip in ENDED_BY and skip != "p":
                nested += -1 if close else 1
            ended = skip in ENDED_BY and nested <= 0 and (nested < 0 or (tag in ENDED_BY[skip] and not (close and tag == skip)))
            if tag == skip and (nested == 0 or skip not in ENDED_BY):
                depth += -1 if close else 1
            if (tag in ("article", "main") or tag == "body") and not close and skip not in ("form", "aside", "section", "article"):
                ended = True  # it was never closed
            if depth > 0 and not ended:
                continue
            skip, link = "", 0
            if close and not ended:
                continue
        if not close and tag not in VOID and not attributes.endswith("/") and _unwanted(tag, attributes, out.open[-1][2] > 0):
            out.end()
            out.gap()
            skip, depth, nested = tag, 1, 0
            continue
        if tag in BLOCKS:
            out.end()
            link = 0
        elif tag in SPACES:
            out.add(" ", False)
        elif tag == "a":
            link = 0 if close else 1
        if tag in HOLDERS:
            if close:
                out.leave(tag)
            else:
                out.enter(tag, tag if tag in ("article", "main") else "main" if _MAIN.search(attributes) else "")
    out.end()
    return out


def _main_lines(found: _Lines) -> list[int]:
    """Lines of the main text: of the region that most of the surging text lies in, the runs that surge and what belongs to them."""
    region, holder = np.array(found.region), np.array(found.holder)
    lengths = np.fromiter(map(len, found.text), np.int64, len(found.text))
    in_article = np.array([k == "article" for k in found.kinds])[region]
    lengths[~in_article & (2 * np.array(found.linked) > lengths)] = 0
    weighted = lengths * np.array([WEIGHTS[k] for k in found.kinds])[region]
    sums = np.convolve(weighted, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of each line and those after it
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]])))
    runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    if not runs:
        return []
    surging = np.zeros(len(lengths), bool)
    most = max(sums[a:b].max() for a, b in runs)
    for a, b in runs:
        if sums[a:b].max() >= min(SURGE + 1, most):
            surging[a:b] = True
    surging &= lengths > 0

    n = len(found.kinds)
    own = np.bincount(region[surging], weights=weighted[surging], minlength=n)
    mass = own.copy()
    for i in range(n - 1, 0, -1):  # regions are numbered from the outside in
        mass[found.parents[i]] += mass[i]
    chosen = 0
    while found.kinds[chosen] != "article":
        inside = [i for i in range(1, n) if found.parents[i] == chosen]
        best = max(inside, key=lambda i: mass[i], default=0)
        if not best or 2 * mass[best] < mass[chosen]:
            break
        chosen = best
    # Where a region's own text outweighs the articles in it, these are teasers or comments.
    part_of = [i == chosen for i in range(n)]
    for i in range(1, n):
        if part_of[found.parents[i]] and not part_of[i]:
            part_of[i] = found.kinds[i] == "main" or 2 * own[chosen] < mass[chosen]
    mine = np.array(part_of)[region] & (lengths > 0)
    near = np.isin(holder, holder[surging & mine])
    return np.flatnonzero(mine & (surging | near | in_article)).tolist()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = lines(page)
    return "\n\n".join(found.text[i] for i in _main_lines(found)) if found.text else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row a row of pages.

    pages: page_id long, url, html; other columns are ignored. A null or empty
    html, or one without article text, gives an empty text. Null ids and urls
    stay null, equal rows are extracted each, an empty table gives no rows.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(task, "page_id long, url string, text string, n_chars long")
