"""HTML extraction by tag-path ratios.

Every block of text has a root-to-leaf path of tags with their classes and ids. Per path
the text length, the punctuation and the length of link texts are summed and divided by
the path's blocks. The two ratios are smoothed over the page's paths in order (Gaussian
weights, less between paths of different parents) and fused into one value; paths whose
value reaches a share of the spread of all values are content, and so are the texts on
them. Besides the ratios a path's value has two priors:

- furniture: a step of a menu, form, footer, advert, comment, ... by its tag, role or the
  head word of a class or id ("main-menu", "comment-list", not "menu-of-the-day") divides
  the value; a name that only mentions furniture divides it where half of the path's text
  is links. A step that holds the content root is no furniture whatever its name, and
  neither is a heading;
- the content root: the ``article`` or ``main`` with most text. Paths inside it have at
  least a share of its best path's value, so short paragraphs, headings and lists stay,
  but not rows of blocks that are links throughout; the value of paths outside is divided.

Without such a root, texts between the first and the last content path that stand beside
content and are not mostly links are filled in, and headings just before it.

A page is parsed once, in one pass over its tags and in time that grows with its length
alone, in the task that reads it; there is no shuffle.

Results on odd input: null or empty html, and pages of furniture alone, give the empty
text; very long or deep pages are read whole; broken markup is read leniently (unclosed
tags end with their parent, an unclosed quote at the next ``>``, an unclosed title at the
next tag, an unclosed script or style with the page, a ``<`` without a tag is text); repeated rows are extracted once each, as are rows without an id; ties between
roots go to the first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import slices, table

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"""([^\s/=>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
# fixed values: element names, and the names that mark page furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
FOREIGN = frozenset(("svg", "math"))  # only there does a slash close a raw element
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside form head button select menu dialog fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# names of furniture as the head word of a class or id, words of layout that may follow the
# head, and names that must be the whole
HEAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsored promo promotion cookie cookies gdpr popup modal navbar nav navigation menu breadcrumb breadcrumbs "
    "sidebar widget widgets footer masthead comment comments commentary disqus newsletter subscribe subscription pagination pager".split()
)
LAYOUT = frozenset(
    "area bar block body bottom box button buttons col column consent container content form group header holder icon icons info inner item items law layer left link links list main message "
    "module notice banner outer overlay panel policy primary region right row secondary section signup slot small text thread title toggle top unit warning wrap wrapper zone".split()
)
WHOLE_NAMES = frozenset(
    "adbox sponsor banner consent consent-banner notice notices site-notice alert alerts overlay header site-header page-header top-header "
    "respond share share-this share-buttons share-links share-bar share-icons sharing social social-links social-share social-icons "
    "related related-content related-posts related-articles related-links related-stories recommended replies reply-list "
    "search search-form search-box signup login login-form toolbar copyright legal disclaimer skip-link".split()
)
CLASS_NAMES = frozenset("discussion responses reviews".split())  # as ids they name chapters
NEGATIONS = frozenset("no not has have with without is hide show js".split())
NAMED, WEAK = 2, 3  # furniture by a name, and by a mention
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCK - {"br", "button"}
_MARKS = re.compile(r"[.,;:!?…。，！？]")
SPREAD = 0.5  # of the values' standard deviation: the least value of a content path
OF_FURNITURE, OUTSIDE, INSIDE = 0.02, 0.2, 0.5  # priors
ALL_LINKS = 0.9  # share of links from which a path of several blocks is not lifted
APART = 0.05  # weight in smoothing between paths of different parents


@dataclass
class Page:
    """Elements in order (a parent before its children) and texts by element."""

    name: list[str] = field(default_factory=lambda: [""])
    step: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    marked: list[int] = field(default_factory=lambda: [0])  # furniture: 1 by its tag or role, NAMED or WEAK
    home: list[bool] = field(default_factory=lambda: [False])
    texts: list[tuple[int, str] | None] = field(default_factory=list)  # None at every block edge

    def open(self, name: str, attrs: str, parent: int) -> int:
        found: dict[str, str] = {}
        for m in _ATTR.finditer(attrs):
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        classes = found.get("class", "").split()
        names = [*classes, *found.get("id", "").split()]
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        marked = 0
        if name in FURNITURE - {"form"} or found.get("role") in ROLES or hidden:
            marked = 1
        elif name == "form":
            marked = NAMED
        elif name not in HEADINGS and names:
            marked = min((k for k in map(furniture, names) if k), default=0)
            if not CLASS_NAMES.isdisjoint(classes):
                marked = NAMED
        if name in ("html", "body"):
            marked = 0
        self.name.append(name)
        self.step.append(".".join([name, *sorted(names)]))
        self.parent.append(parent)
        self.marked.append(marked)
        self.home.append(name in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articlebody")
        return len(self.name) - 1


def furniture(name: str) -> int:
    """NAMED if the head of a class or id names page furniture, WEAK if a word before the
    last does, else 0."""
    parts = [p for p in re.split(r"[-_]+", name) if p]
    if name in WHOLE_NAMES or "-".join(parts) in WHOLE_NAMES:
        return NAMED
    if not NEGATIONS.isdisjoint(parts[:-1]):
        return 0
    head = len(parts)
    while head > 1 and parts[head - 1] not in HEAD_NAMES and (parts[head - 1] in LAYOUT or not parts[head - 1].isalpha()):
        head -= 1
    if head and parts[head - 1] in HEAD_NAMES:
        return NAMED
    return 0 if HEAD_NAMES.isdisjoint(parts) else WEAK


def _closed(attrs: str) -> bool:
    """Whether a tag ends in a slash of its own, not in that of an unquoted value."""
    last = (attrs.split() or [""])[-1]
    return last.endswith("/") and ("=" not in last or last[-2:-1] in ("'", '"'))


def _raw_end(page: str, name: str, at: int, lost: set[str]) -> int:
    """Where the text of a raw element ends, its end tag included."""
    if name not in lost:
        if m := _raw_close(name).search(page, at):
            end = page.find(">", m.end() - 1)
            return end + 1 if end >= 0 else len(page)
        lost.add(name)
    if name in ("script", "style"):
        return len(page)
    if name == "title":
        end = page.find("<", at)
        return end if end >= 0 else len(page)
    return at


@cache
def _raw_close(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}[\s/>]", re.I)


def _tag_end(page: str, at: int, lost: set[str]) -> int:
    """Place of the ``>`` that ends the tag opened before ``at``, -1 if there is none; a
    quote counts after ``=`` and where it is closed. ``lost``: signs that do not occur
    any more."""
    while m := _STOP.search(page, at):
        sign = m[0]
        if sign == ">":
            return m.start()
        at = m.end()
        if sign in lost or not page[max(0, at - 8) : at - 1].rstrip().endswith("="):
            continue
        close = page.find(sign, at)
        if close < 0:
            lost.add(sign)
        else:
            at = close + 1
    lost.add(">")
    return -1


def parse(page: str) -> Page:
    out, stack, blocks, count = Page(), [0], [], {}
    at, text_from, lost, size = 0, 0, set(), len(page)

    def drop(n: int) -> None:
        while len(stack) > n:
            count[out.name[stack.pop()]] -= 1
        while blocks and blocks[-1] >= n:
            blocks.pop()

    def text(end: int) -> None:
        if end > text_from:
            out.texts.append((stack[-1], html.unescape(page[text_from:end])))

    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at)
            text(start)
            at = text_from = end + 3 if end >= 0 else size
            continue
        closing = page.startswith("/", at)
        m = _NAME.match(page, at + closing)
        if not m and page[at : at + 1] not in ("!", "?"):
            continue
        end = _tag_end(page, m.end() if m else at, lost) if ">" not in lost else -1
        if end < 0:
            continue
        text(start)
        at = text_from = end + 1
        if not m:
            continue
        name = m[0].lower()
        if name in BLOCK:
            out.texts.append(None)
        if closing:
            if count.get(name):
                k = len(stack) - 1
                while out.name[stack[k]] != name:
                    k -= 1
                drop(k)
            continue
        attrs = page[m.end() : end]
        if name in RAW:
            if not (name in FOREIGN and _closed(attrs)):
                at = text_from = _raw_end(page, name, at, lost)
            continue
        if name in VOID:
            continue
        closes = CLOSES.get(name, ())
        while blocks and ((top := out.name[stack[blocks[-1]]]) in closes or top == "p" and name in _ENDS_P):
            drop(blocks[-1])
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append(out.open(name, attrs, stack[-1]))
        count[name] = count.get(name, 0) + 1
    text(size)
    return out


def _root(page: Page, length: np.ndarray) -> int:
    """The content root: the article or main with most text outside furniture, from there
    on the inner one that holds nearly all of it; 0 if there is none."""
    n = len(page.name)
    marked, near, below = np.zeros(n, bool), np.zeros(n, np.int64), length.copy()
    for e in range(1, n):
        up = page.parent[e]
        marked[e] = marked[up] or page.marked[e] in (1, NAMED)
        near[e] = up if page.home[up] else near[up]
    homes = [e for e in range(1, n) if page.home[e] and not marked[e]]
    if homes:
        below[marked] = 0
    else:  # all in furniture: in a form around the whole page, say
        homes = [e for e in range(1, n) if page.home[e] and page.marked[e] not in (1, NAMED)]
    for e in range(n - 1, 0, -1):
        below[page.parent[e]] += below[e]
    best = 0
    for e in homes:  # outer ones come first
        if not best or below[e] > below[best] or near[e] == best and below[e] >= 0.7 * below[best]:
            best = e
    return best


def _smooth(x: np.ndarray, parent: np.ndarray, reach: int = 2) -> np.ndarray:
    """Gaussian weights over neighbours, less between paths of different parents."""
    total, weight = x.copy(), np.ones(len(x))
    for d in range(1, min(reach, len(x) - 1) + 1):
        w = np.exp(-d * d / 2) * np.where(parent[d:] == parent[:-d], 1.0, APART)
        total[d:] += w * x[:-d]
        total[:-d] += w * x[d:]
        weight[d:] += w
        weight[:-d] += w
    return total / weight


@dataclass
class Paths:
    """``own``: the path of each element's block; the rest by path."""

    own: np.ndarray
    block: np.ndarray
    value: np.ndarray
    linked: np.ndarray  # share of link texts
    furniture: np.ndarray
    used: np.ndarray  # paths with text
    root: int


def path_values(page: Page) -> Paths:
    n = len(page.name)
    length, marks, links = np.zeros(n), np.zeros(n), np.zeros(n)
    link = np.zeros(n, bool)
    for e in range(1, n):
        link[e] = link[page.parent[e]] or page.name[e] == "a"
    for t in page.texts:
        if t and (words := t[1].strip()):
            length[t[0]] += len(words)
            marks[t[0]] += len(_MARKS.findall(words))
            links[t[0]] += len(words) * link[t[0]]
    root = _root(page, length)
    # what holds the root is no furniture; nor, without one, is what holds the title or most of the text
    clear, below = set(), length.copy()
    e = root
    while e:
        clear.add(e)
        e = page.parent[e]
    if not root:
        for k in range(n - 1, 0, -1):
            below[page.parent[k]] += below[k]
        clear = {k for k in range(1, n) if page.name[k] == "form" and below[k] >= 0.6 * below[0]}
        e = next((k for k in range(1, n) if page.name[k] == "h1"), 0)
        while e:
            if page.marked[e] == NAMED:
                clear.add(e)
            e = page.parent[e]
    # an inline element's text is its block's; a block's path is its parent's and its step
    block, path = np.zeros(n, np.int64), np.zeros(n, np.int64)
    numbers: dict[tuple[int, str], int] = {}
    bad, weak, inside, above, heading = [False], [False], [root == 0], [0], [False]
    for e in range(1, n):
        up = page.parent[e]
        mark = page.marked[e] in (1, NAMED) and e not in clear
        if page.name[e] not in BLOCK and not mark:
            block[e], path[e] = block[up], path[up]
            continue
        key = (int(path[up]), page.step[e] + "*" * (e == root) + "!" * mark)
        if key not in numbers:
            numbers[key] = len(bad)
            bad.append(mark or bad[path[up]])
            weak.append(page.marked[e] == WEAK and e not in clear or weak[path[up]])
            heading.append(page.name[e] in HEADINGS or heading[path[up]])
            inside.append(inside[path[up]] or e == root)
            above.append(int(path[up]))
        block[e], path[e] = e, numbers[key]
    own = path[block]
    text, mark, a = (np.bincount(own, weights=x, minlength=len(bad)) for x in (length, marks, links))
    filled = np.unique(block[length > 0])
    count = np.bincount(path[filled], minlength=len(bad))
    used, bad, inside = np.flatnonzero(count), np.array(bad), np.array(inside)
    linked, value = a / np.maximum(text, 1), np.zeros(len(bad))
    bad = bad | np.array(weak) & (linked >= 0.5)
    links_only = (linked >= ALL_LINKS) & (count > 1) & ~np.array(heading)
    if len(used):
        up = np.array(above)[used]
        ratio = _smooth((text * (1 - linked))[used] / count[used], up)
        fused = np.sqrt(ratio * (1 + _smooth(mark[used] / count[used], up))) * np.where(bad[used], OF_FURNITURE, 1)
        if root:
            mine = inside[used] & ~bad[used] & ~links_only[used]
            fused = np.where(mine, np.maximum(fused, INSIDE * fused[mine].max(initial=0)), fused * np.where((inside & ~links_only)[used], 1, OUTSIDE))
        value[used] = fused
    return Paths(own, block, value, linked, bad, used, root)


def _filled(page: Page, paths: Paths, at: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Texts between content that stand beside it, and headings just before it."""
    content_ = {page.parent[b] for b in paths.block[at[kept]].tolist()}
    own, first, last = paths.own[at], int(kept.argmax()), len(kept) - int(kept[::-1].argmax())
    out = kept.copy()
    free = ~paths.furniture[own] & (paths.linked[own] < 0.5)
    for k in np.flatnonzero(free[first:last] & ~kept[first:last]) + first:
        e = int(paths.block[at[k]])
        for _ in range(3):
            out[k] |= page.parent[e] in content_
            e = page.parent[e]
    for k in range(first - 1, max(-1, first - 4), -1):
        if not free[k] or page.name[paths.block[at[k]]] not in HEADINGS:
            break
        out[k] = True
    return out


def content(page: str, spread: float = SPREAD) -> str:
    tree = parse(page)
    paths = path_values(tree)
    if paths.furniture[paths.used].all():
        return ""
    keep = paths.value >= spread * paths.value[paths.used].std()
    at = np.array([t[0] for t in tree.texts if t and t[1].strip()], np.int64)
    kept = keep[paths.own[at]]
    if not paths.root and kept.any():
        kept = _filled(tree, paths, at, kept)
    out, k = [], 0
    for t in tree.texts:
        if t is None:
            out.append("\n")
        elif not t[1].strip():
            out.append(" ")
        else:
            out.append(t[1] if kept[k] else "\n")
            k += 1
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, "html"):
            texts = [content(p or "") for p in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
