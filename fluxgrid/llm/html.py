"""The main text of a web page, by tag-path ratios.

A page is read in one pass into blocks, the text between two block-level tags, each with its path of tags and classes
from the root. Over all blocks of a path, the length of text, the number of punctuation marks and the text outside
links, for each block, are the path's ratios. In page order the ratios are smoothed over neighbouring blocks and fused
into one score; a path whose blocks' mean score is over a share of the scores' deviation is a content path. What a page
says of its elements weighs in: blocks in an article's or main element count more, those under a class or id that names
adverts, comments and the like count less. Both only change the score; long texts outvote a class name. Elements that
are no part of an article by HTML's own definition, as navigation, forms and scripts, aren't read at all.

The content paths then locate the article: the smallest structural element with most of their text. An article's short
blocks, as subheadings and list items, have low ratios of their own; all blocks of that element are kept, but for those
under a naming class within it whose path is no content path.

Reading takes time linear in the page, however deep or broken its tags are: open elements are found by their tag, paths
are numbers, and a tag that never closes is looked for once.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the scores' standard deviation that a content path has to reach.
THRESHOLD = 0.5
#: Factors of a block's score in an article's element, and under a class or id that names what is no article.
MARK, HINT = 2.0, 0.05
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?。、，]")
# HTML's void, raw-text and inline elements, those that a start tag closes, and those that bound such closing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button canvas cite code data del dfn em embed font i iframe img input ins kbd label map mark meter object picture progress q rp rt "
    "ruby s samp script select small span strike strong style sub sup svg template textarea time tt u var wbr".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("thead", "tbody"), "tfoot": ("tbody",), "body": ("head",),
}
SCOPE = frozenset("table ul ol dl select article section div body html td th".split())
CELLS = frozenset("table td th caption html".split())
STRUCTURE = frozenset("html body main article section div center td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements and roles that are no part of an article by their definition; a header is, within an article.
EXCLUDED_TAGS = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object embed svg canvas dialog menu audio video map title noembed noframes".split())
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar status".split())
#: Words that name what is no article, and words that may stand beside them in such a name. Any other word, as in related-work, makes it another name.
NAMING = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices "
    "alert popup modal newsletter subscribe subscription signup login sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead "
    "comment comments disqus reply replies share sharing social related recommended recommendations widget widgets toolbar pagination pager".split()
)
BESIDE = frozenset(
    "area articles bar block bottom box btn button buttons container content external feed form group header icons inner item items left links list main more news outer page panel post posts right "
    "row section site slot story stories thread title top unit wrap wrapper".split()
)
#: Words of readers' comments and paid matter, which name no article in any company but these.
STRONG = frozenset("comment comments commenter disqus advert adverts advertisement advertisements advertorial sponsored".split())
WITHOUT = frozenset("no non not without has have with enabled disabled open opened closed allow allowed hide show free count counts".split())
READERS, SAYINGS = frozenset("user users reader readers visitor visitors guest customer".split()), frozenset("comment comments discussion feedback notes opinions posts replies reviews".split())
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")


def names_no_article(names: str) -> bool:
    """Whether one of a class attribute's names, or an id, stands for something beside the article."""
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & STRONG and not words & WITHOUT or words & NAMING and words <= NAMING | BESIDE or words & READERS and words & SAYINGS and words <= READERS | SAYINGS | BESIDE:
            return True
    return False


@dataclass(slots=True)
class Block:
    path: int
    text: str
    #: Characters of the text that are in links.
    linked: int
    marked: bool
    #: The element that the block lies in, as its place in the page's lists.
    element: int


@dataclass
class Page:
    """Blocks and elements in their order. Of each element: its parent, its tag, and the innermost element around it, or itself, with a naming class (0: none). The first is the page itself."""

    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    hint: list[int] = field(default_factory=lambda: [0])


@dataclass(slots=True)
class _Open:
    tag: str
    path: int
    element: int
    excluded: bool
    marked: bool


class _Reader:
    """The open elements and the text of the block that is being read."""

    def __init__(self) -> None:
        self.page, self.stack = Page(), [_Open("", 0, 0, False, False)]
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # by tag, the places of its open elements in the stack
        self.scopes, self.cells, self.blocks = [0], [0], [0]  # places of open elements of these kinds
        self.paths: dict[tuple[int, str, str], int] = {}
        self.parts: list[str] = []
        self.linked = 0

    def add(self, text: str) -> None:
        if not self.stack[-1].excluded:
            self.parts.append(text)
            if self.places["a"]:
                self.linked += len(text)

    def end_block(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                top = self.stack[-1]
                self.page.blocks.append(Block(top.path, text, min(self.linked, len(text)), top.marked, top.element))
            self.parts.clear()
        self.linked = 0

    def pop_to(self, place: int) -> None:
        """Closes the open elements from a place of the stack on."""
        if self.blocks[-1] >= place:
            self.end_block()
        for k in range(len(self.stack) - 1, place - 1, -1):
            self.places[self.stack[k].tag].pop()
            for kind in (self.scopes, self.cells, self.blocks):
                if kind[-1] == k:
                    kind.pop()
        del self.stack[place:]

    def opened(self, tag: str, named: dict[str, str]) -> None:
        inline = tag in INLINE
        if not inline:
            self.end_block()
            if (p := self.places["p"]) and p[-1] > self.scopes[-1] and tag not in ("td", "th", "tr"):
                self.pop_to(p[-1])
            bound = self.scopes[-2] if tag in ("td", "th", "tr") and self.stack[self.scopes[-1]].tag in ("td", "th") else self.scopes[-1]
            for other in CLOSES.get(tag, ()):
                if (o := self.places[other]) and o[-1] > min(bound, self.scopes[-1]):
                    self.pop_to(o[-1])
        if tag in VOID:
            if tag == "br":
                self.add(" ")
            return
        top, page = self.stack[-1], self.page
        excluded = top.excluded or tag in EXCLUDED_TAGS or tag == "header" and not self.places["article"]
        marked, path, element = top.marked or tag in ("article", "main"), top.path, top.element
        if named and not excluded:
            role, style = named.get("role", "").lower(), _SPACE.sub("", named.get("style", "")).lower()
            excluded = role in EXCLUDED_ROLES or "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
            marked = marked or role in ("main", "article") or named.get("itemprop", "").lower() == "articlebody"
        if not inline:
            names = named.get("class", "")
            path = self.paths.setdefault((path, tag, names), len(self.paths) + 1)
            page.parent.append(element)
            page.tag.append(tag)
            own = len(page.tag) - 1
            told = tag not in ("html", "body", "article", "main") and bool(named) and names_no_article(f"{names} {named.get('id', '')}")
            page.hint.append(own if told else page.hint[element])
            element = own
        place = len(self.stack)
        self.stack.append(_Open(tag, path, element, excluded, marked))
        self.places[tag].append(place)
        for kind, among in ((self.scopes, tag in SCOPE), (self.cells, tag in CELLS), (self.blocks, not inline)):
            if among:
                kind.append(place)

    def closed(self, tag: str) -> None:
        """An end tag; one without an open element of its own, or from within a table's cell for one around it, closes nothing."""
        place = self.places[tag][-1] if self.places[tag] else -1
        if tag in INLINE:
            if place > self.blocks[-1]:
                self.pop_to(place)
        elif place >= self.cells[-1] or tag in CELLS and place > 0:
            self.pop_to(place)
        else:
            self.end_block()


def read(page: str) -> Page:
    """The blocks and elements of a page; a tag that is never closed, or closed twice, does no harm."""
    reader, at, size, never = _Reader(), 0, len(page), set()
    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        if start > at:
            reader.add(references.unescape(page[at:start]))
        m = _NAME.match(page, start)
        if not m:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
            elif page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                reader.add(page[start + 9 : size if end < 0 else end])
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), start):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:
                reader.add("<")
                at = start + 1
            continue
        at, named, tag = m.end(), {}, m[2].lower()
        if page.startswith(">", at):
            at += 1
        else:
            while True:
                a = _ATTRIBUTE.match(page, at)
                if a.end() == at or a.end() == size and not a[1]:
                    at = size  # the page ends within the tag
                    break
                at = a.end()
                if a[1]:
                    break
                value = a[3] or a[4] or a[5] or ""
                named.setdefault(a[2].lower(), references.unescape(value))
            if at == size and page[-1] != ">":
                break
        if m[1]:
            if tag not in VOID:
                reader.closed(tag)
            elif tag == "br":
                reader.add(" ")
            continue
        reader.opened(tag, named)
        if tag in RAW and tag not in never:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if end:
                at = end.start()
            else:
                never.add(tag)
    if at < size:
        reader.add(references.unescape(page[at:]))
    reader.end_block()
    return reader.page


def _smooth(x: np.ndarray) -> np.ndarray:
    """Weights 1, 2, 1 over neighbours; the ends are their own neighbours."""
    padded = np.concatenate((x[:1], x, x[-1:]))
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def _forget_headed(page: Page) -> None:
    """An element that holds a first heading is no ad or comment, whatever it is called."""
    headed = [t == "h1" for t in page.tag]
    for k in range(len(headed) - 1, 0, -1):
        headed[page.parent[k]] |= headed[k]
    page.hint = [0 if headed[h] else h for h in page.hint]


def candidates(page: Page) -> list[Block]:
    """The blocks among which the article is looked for: those in no element named otherwise, if any of them is more than links."""
    own = [b for b in page.blocks if not page.hint[b.element]]
    return own if any(2 * b.linked < len(b.text) for b in own) else page.blocks


def content_paths(page: Page, found: list[Block], threshold: float = THRESHOLD) -> tuple[set[int], set[int]]:
    """The paths of the blocks that the ratios take for content, the best one if none reaches the threshold; and those
    among them that reach it by their own ratios, without what smoothing lends them from their neighbours."""
    if not found:
        return set(), set()
    paths, which = np.unique(np.array([b.path for b in found]), return_inverse=True)
    number = np.bincount(which)
    length = [len(b.text) for b in found]
    free, signs = [n - b.linked for n, b in zip(length, found, strict=True)], [len(_PUNCTUATION.findall(b.text)) for b in found]
    weight = np.array([(MARK if b.marked else 1.0) * (HINT if page.hint[b.element] else 1.0) for b in found])

    def scores(smooth: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The score of each block, from the means of its path."""
        ratio = lambda values: smooth((np.bincount(which, weights=np.array(values, float)) / number)[which])
        return ratio(length) * (1 + ratio(signs)) * ratio(free) / ratio(length) * weight

    score = scores(_smooth)
    mean, own = (np.bincount(which, weights=x) / number for x in (score, scores(lambda x: x)))
    least = threshold * score.std()
    content = mean >= min(least, mean.max())
    text = np.bincount(which, weights=np.array(length, float))
    bare = np.zeros(len(paths), bool)
    bare[which] = [page.tag[b.element] in STRUCTURE for b in found]
    strong = content & (own >= min(least, own[content].max()))
    strong &= ~bare | (text == text[strong].max())  # text right in a container may be a notice; not where the article is written so
    return set(paths[content].tolist()), set(paths[strong].tolist())


def article(page: Page, found: list[Block], paths: set[int], strong: set[int]) -> int:
    """The smallest structural element with all blocks of the strong paths, and with the headings next to it."""
    parent, tag = page.parent, page.tag
    weight = [0] * len(parent)
    for b in found:
        weight[b.element] += b.path in strong
    for k in range(len(weight) - 1, 0, -1):
        weight[parent[k]] += weight[k]
    at = max(k for k, w in enumerate(weight) if w == weight[0])
    while at and tag[at] not in STRUCTURE:
        at = parent[at]
    chain = [at]
    while chain[-1]:
        chain.append(parent[chain[-1]])
    level = {k: i for i, k in enumerate(chain)}  # of each element: the first of the chain that it is in
    for k in range(1, len(parent)):
        level.setdefault(k, level[parent[k]])
    more = defaultdict(list)
    for b in found:
        more[level[b.element]].append(b)
    for i, up in enumerate(chain[1:], 1):
        if tag[up] not in STRUCTURE - {"html", "body"} or not all(b.path in paths or tag[b.element] in HEADINGS for b in more[i]):
            break
        at = up
    return at


def _within(page: Page, element: int) -> list[bool]:
    """Whether each element is the given one or lies in it; parents come before their children."""
    out = [False] * len(page.parent)
    for k, parent in enumerate(page.parent):
        out[k] = k == element or k > 0 and out[parent]
    return out


def _parts(page: Page, found: list[Block], at: int) -> list[list[Block]]:
    """The blocks by the child of an element that they lie in, or that they are."""
    top = list(range(len(page.parent)))
    for k in range(1, len(top)):
        if page.parent[k] != at:
            top[k] = top[page.parent[k]]
    out: list[list[Block]] = []
    last = -1
    for b in found:
        if top[b.element] != last or b.element == at:
            out.append([])
        out[-1].append(b)
        last = top[b.element]
    return out


def content(page: Page, threshold: float = THRESHOLD) -> list[Block]:
    """The blocks of the page's article: all of its element, but for parts named otherwise.

    Where the body is its smallest element, the article goes from the first part of the body that has content to the last
    one, with headings before it; parts between them that have none and are links for the most are left out.
    """
    _forget_headed(page)
    found = candidates(page)
    paths, strong = content_paths(page, found, threshold)
    if not found:
        return []
    at = article(page, found, paths, strong)
    inside = _within(page, at)
    if page.tag[at] in ("", "html", "body"):
        parts = _parts(page, [b for b in found if inside[b.element]], at)
        has = [any(b.path in strong for b in part) for part in parts]
        first, last = has.index(True), len(has) - has[::-1].index(True)
        while first and all(page.tag[b.element] in HEADINGS for b in parts[first - 1]):
            first -= 1
        prose = lambda part: 2 * sum(b.linked for b in part) < sum(len(b.text) for b in part)
        found = [b for part, own in zip(parts[first:last], has[first:last], strict=True) if own or prose(part) for b in part]
    told = lambda b: page.hint[b.element] not in (0, at) and inside[page.hint[b.element]]
    return [b for b in found if inside[b.element] and (b.path in paths or not told(b))]


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by an empty line; empty for null and for pages without any."""
    return "\n\n".join(b.text for b in content(read(page or "")))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        sizes = [len(x) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages(page_id, url, html).

    A null or empty page has an empty text. Very long and malformed pages take time in proportion to their length.
    Repeated rows come out repeated, null ids as null, and an empty table gives no row; other columns are left out.
    """
    source = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
