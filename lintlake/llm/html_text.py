"""Main text of HTML pages by composite text density.

A page becomes a tree of nodes in arrays. Parts that name themselves as something
other than the article (navigation, adverts, forms, comments and the like) are
left out, but no headings, and no boxes that hold the article. Each node's density is its characters per tag, lowered by the share of
characters that stand in links; a node's density sum adds up its children's. The
node with the largest sum holds the article; the smallest density on its path to
the body is the threshold for further parts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose opening ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body html option td th tr tbody thead tfoot caption legend summary".split())
#: Elements that end an open one of the same group.
GROUPS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A search for an open element to end stops here.
FENCES = frozenset("table ul ol dl div article section body html td th li dd select".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that never hold article text.
NOT_TEXT = frozenset("script style noscript template iframe textarea title button select option input svg canvas object embed audio video map datalist".split())
#: Elements that seldom hold the article, and those that do so only around a main element or most of the text.
WRAPPERS, BESIDE = frozenset("head form fieldset dialog menu header".split()), frozenset("nav footer aside".split())
#: Elements whose class, id or role says nothing: text and its parts, not boxes.
TEXT_PARTS = HEADINGS | frozenset("html body article main hgroup p li dt dd pre blockquote figcaption caption th a b i em strong span small sub sup code mark u s q cite abbr time font kbd samp var ins del br".split())
#: Classes, ids and roles that say the same: every word of the name, or all but words of place.
_BOX = "(?:(?:site|page|main|top|bottom|left|right|primary|secondary|area|wrap|wrapper|container|box|block|section|list|links?|items?|inner|outer|global|post|entry|blog|widget|buttons?|bar|col|column|[0-9]+)[_-]+)*"
_END = "(?:[_-]+(?:site|page|main|top|bottom|left|right|primary|secondary|area|wrap|wrapper|container|box|block|section|list|links?|items?|inner|outer|global|post|entry|blog|widget|buttons?|bar|col|column|[0-9]+))*"
_SURE = (
    r"ads?|advert[^\W_]*|adsense|adbox|sponsor(?:s|ed)?|promos?|cookies?[^\W_]*|consent|gdpr|popup|overlay|newsletter|subscribe|subscription|signup|"
    r"nav|navbar|navigation|navs|menus?|breadcrumbs?|sidebar[^\W_]*|related|recommend[^\W_]*|share|sharing|comments?|commentlist|disqus|respond|pagination|pager|login|complementary|contentinfo"
)
_LIKELY = r"nav[^\W_]*|promo[^\W_]*|sponsor[^\W_]*|banner[^\W_]*|notices?|alerts?|modal|side|widgets?|social|responses?|replies|reply|discussion|feedback|foot[^\W_]*|header|masthead|topbar|toolbar|tags?|byline|copyright|legal|disclaimer|skip[^\W_]*|search[^\W_]*|form"
SURE_NAME = re.compile(rf"{_BOX}(?:{_SURE})(?:[_-]+(?:{_SURE}|{_LIKELY}))*{_END}", re.I)
#: Of these, boxes in the article that are as dense as its text stay: what they hold is the article's.
_SOFT = r"promos?|overlay|related|recommend[^\W_]*|share|sharing"
HARD_NAME = re.compile(SURE_NAME.pattern.replace(_SURE, "|".join(w for w in _SURE.split("|") if w not in _SOFT.split("|"))), re.I)
LIKELY_NAME = re.compile(rf"{_BOX}(?:{_SURE}|{_LIKELY})(?:[_-]+(?:{_SURE}|{_LIKELY}))*{_END}", re.I)
HIDDEN_NAME = re.compile(r"(?:hidden|sr-only|visually-hidden|screen-reader-text|skip-?link|skip-to-(?:main|content|nav\w*))", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none)", re.I)


class Page:
    """A page's nodes in document order: tag, parent, and the text runs with the node that holds each."""

    def __init__(self, html: str):
        self.tags, self.parents, self.drop, self.named = ["#root"], [-1], [False], [False]
        self.soft: list[int] = []  # nodes in an article whose name rules them out only if they are thinner than it
        self.likely, self.article = [False], [0]  # article: the nearest article or main at or around the node, 0 if none
        self.runs: list[tuple[int, str]] = []  # (node, text); an empty text marks a line break
        self.open: list[int] = [0]  # the open nodes, outermost first
        self.places: dict[str, list[int]] = {}  # per tag the places of its open nodes
        at, node, n = 0, 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            start, end = (m.start(), m.end()) if m else (n, n)
            if start > at:
                self.runs.append((node, unescape(html[at:start])))
            at = end
            if not m or not m[2]:
                if m and m[0].startswith("<![CDATA["):
                    self.runs.append((node, m[0][9:].removesuffix("]]>")))
                continue
            tag = m[2].lower()
            if m[1]:
                node = self._close(tag)
                continue
            node = self._open(node, tag, m[3] or "")
            if tag in VOID:
                if tag == "br":
                    self.runs.append((node, " "))
                node = self._leave(len(self.open) - 1)
            elif tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at, node = close.end() if close else n, self._leave(len(self.open) - 1)
        self._settle()

    def _open(self, node: int, tag: str, attributes: str) -> int:
        if tag in GROUPS:
            node = self._end(GROUPS[tag], FENCES - GROUPS[tag])
        if tag in ENDS_P:
            node = self._end({"p"}, FENCES)
        self.tags.append(tag)
        self.parents.append(node)
        me = len(self.tags) - 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(me)
        inside = self.article[node]
        self.article.append(me if tag in ("article", "main") else inside)
        self.drop.append(tag in NOT_TEXT or bool(attributes and _HIDDEN.search(attributes)))
        # a header inside the article is its own
        likely, named, hard = tag in BESIDE or tag in WRAPPERS and not (tag == "header" and inside), False, False
        if attributes and tag not in HEADINGS:
            for kind, *values in _NAMES.findall(attributes):
                for name in "".join(values).split():
                    if len(name) > 64 or kind.lower() == "id" and (inside or tag == "section"):
                        continue
                    self.drop[me] = self.drop[me] or kind.lower() != "id" and tag not in ("html", "body") and bool(HIDDEN_NAME.fullmatch(name))
                    if tag not in TEXT_PARTS:
                        named = named or bool(SURE_NAME.fullmatch(name))
                        hard = hard or bool(HARD_NAME.fullmatch(name))
                        likely = likely or not inside and tag != "section" and bool(LIKELY_NAME.fullmatch(name))
        if named and inside and not hard:
            self.soft.append(me)
        self.named.append(named)
        self.likely.append(likely)
        return me

    def _settle(self) -> None:
        """Drop what its name or tag rules out, unless the article is in it, and all below dropped nodes."""
        n = len(self.tags)
        holds, main, title = ([False] * n for _ in range(3))
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            holds[p] = holds[p] or holds[i] or self.tags[i] in ("article", "main")
            main[p] = main[p] or main[i] or self.tags[i] == "main"
        first = next((i for i in range(n) if self.tags[i] == "h1"), 0)
        while first > 0:
            first = self.parents[first]
            title[first] = True
        for i in self._dense():
            self.named[i] = False
        for i in range(1, n):
            self.named[i] = self.named[i] and not holds[i] and not title[i]
            self.drop[i] = self.drop[i] or self.named[i] or self.drop[self.parents[i]]
        # the text in each node, outside links and what is dropped already
        chars, linked = [0] * n, [False] * n
        if any(self.likely):
            for i in range(1, n):
                linked[i] = self.tags[i] == "a" or linked[self.parents[i]]
            for i, text in self.runs:
                if not self.drop[i] and not linked[i]:
                    chars[i] += len("".join(text.split()))
            for i in range(n - 1, 0, -1):
                chars[self.parents[i]] += chars[i]
        for i in range(1, n):
            if self.likely[i]:
                beside, inside = self.tags[i] in BESIDE, self.article[i]
                # without an article element, or within one, most of the text is the article
                most = (inside > 0 or not holds[0]) and 2 * chars[i] > chars[inside]
                titled = title[i] and (self.tags[i] != "header" or not holds[0])
                body = self.tags[i] == "head" and any(self.tags[j] == "body" and self.parents[j] == i for j in range(i + 1, n))
                self.drop[i] = self.drop[i] or not (main[i] if beside else holds[i] or titled or body) and not most
            self.drop[i] = self.drop[i] or self.drop[self.parents[i]]

    def _dense(self) -> list[int]:
        """Of the soft nodes those with at least half the article's characters per tag, links aside."""
        if not self.soft:
            return []
        n = len(self.tags)
        chars, tags, linked = [0] * n, [1] * n, [False] * n
        for i in range(1, n):
            linked[i] = self.tags[i] == "a" or linked[self.parents[i]]
        for i, text in self.runs:
            if not linked[i] and self.tags[i] not in NOT_TEXT:
                chars[i] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            chars[self.parents[i]] += chars[i]
            tags[self.parents[i]] += tags[i]
        return [i for i in self.soft if 2 * chars[i] * tags[self.article[i]] >= chars[self.article[i]] * tags[i]]

    def _last(self, tags: Iterable[str]) -> int:
        """The innermost place of an open node of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _leave(self, place: int) -> int:
        """Close the open nodes from a place on; the node that is then the innermost."""
        while len(self.open) > place:
            self.places[self.tags[self.open.pop()]].pop()
        return self.open[-1]

    def _end(self, tags: set[str], fences: frozenset[str]) -> int:
        """Close up to the nearest open element of these tags, if no fence is nearer."""
        at = self._last(tags)
        return self._leave(at) if at and at >= self._last(fences) else self.open[-1]

    def _close(self, tag: str) -> int:
        """Close up to the nearest open element of a tag; inline tags don't reach out of their table cell."""
        at = self._last((tag,))
        if not at or tag not in BLOCKS and self._last(("td", "th", "table")) > at:
            return self.open[-1]
        return self._leave(at)

    def densities(self) -> tuple[list[float], list[float]]:
        """Each node's composite text density, and the sum of its children's."""
        n = len(self.tags)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            p = self.parents[i]
            in_link[i] = self.tags[i] == "a" or in_link[p]
        for i, text in self.runs:
            if not self.drop[i]:
                k = len("".join(text.split()))
                chars[i] += k
                if in_link[i]:
                    links[i] += k
        for i in range(n - 1, 0, -1):
            if not self.drop[i]:
                p = self.parents[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tags[i] == "a")
        body_links, body_chars = links[0], max(1, chars[0])
        density = [0.0] * n
        for i in range(n):
            c = chars[i]
            if not c:
                continue
            t, lc, lt = max(1, tags[i]), max(1, links[i]), max(1, link_tags[i])
            plain = max(1, c - links[i])
            base = math.log(c / plain * links[i] + body_links / body_chars * c + math.e)
            x = max(1.0, (c / lc) * (t / lt))
            density[i] = c / t * math.log(x) / math.log(base) if base > 1.0 and links[i] else c / t
        sums = [0.0] * n
        for i in range(1, n):
            if not self.drop[i]:
                sums[self.parents[i]] += density[i]
        return density, sums

    def content(self) -> set[int]:
        """The nodes at the top of the page's main text."""
        density, sums = self.densities()
        live = [i for i in range(len(self.tags)) if not self.drop[i]]
        best = max(live, key=lambda i: (sums[i], density[i], -i))
        if sums[best] <= 0:
            return {0}
        path, at = [], best
        while at > 0 and self.tags[at] not in ("body", "html"):
            path.append(at)
            at = self.parents[at]
        threshold = min([density[i] for i in [*path, at] if density[i] > 0], default=0.0)
        chosen = {self._whole(best)}
        # further parts, at any depth: as dense as the path's thinnest node
        around, under = self._around(chosen, set()), [False] * len(self.tags)
        for i in live:
            under[i] = i in chosen or i > 0 and under[self.parents[i]]
            if not under[i] and i not in around and density[i] >= threshold > 0:
                part = self._whole(i)
                part = i if part in around else part
                chosen.add(part)
                self._around({part}, around)
                under[part] = under[i] = True
        return chosen | self._titles(chosen, around, density)

    def _around(self, nodes: set[int], out: set[int]) -> set[int]:
        """Adds all nodes that hold one of these."""
        for i in nodes:
            at = self.parents[i]
            while at >= 0 and at not in out:
                out.add(at)
                at = self.parents[at]
        return out

    def _titles(self, chosen: set[int], around: set[int], density: list[float]) -> set[int]:
        """Headings of the chosen parts: too short for the threshold, but the next part that begins is theirs."""
        out: set[int] = set()
        under, open_ones, titled = [False] * len(self.tags), [], False
        for i in range(len(self.tags)):
            if self.drop[i]:
                continue
            under[i] = i in chosen or i > 0 and under[self.parents[i]]
            heading = self.tags[i] in HEADINGS
            titled = titled or under[i] and self.tags[i] == "h1"
            if i in chosen:
                out.update(h for h in open_ones if h not in chosen)
                open_ones = []
            elif heading and not under[i] and density[i] > 0:
                at = self.parents[i]
                while at not in around and self.tags[i] == "h1":
                    at = self.parents[at]
                if at in around:  # beside a part, or the page's title in a box of its own
                    open_ones = [h for h in open_ones if self.tags[h] < self.tags[i]] + [i]
        return {h for h in out if not titled or self.tags[h] != "h1"}

    def _whole(self, node: int) -> int:
        """The nearest article or main around a node, else the node itself."""
        return self.article[node] or node

    def text(self) -> str:
        """Blocks of the main text in page order, one a line."""
        chosen = self.content()
        n = len(self.tags)
        keep, block = [False] * n, [0] * n
        for i in range(n):
            p = self.parents[i]
            keep[i] = not self.drop[i] and (i in chosen or (i > 0 and keep[p]))
            block[i] = i if i == 0 or self.tags[i] in BLOCKS else block[p]
        ends = list(range(n))  # nodes are in document order: what is below a node follows it without a gap
        for i in range(n - 1, 0, -1):
            ends[self.parents[i]] = max(ends[self.parents[i]], ends[i])
        out: list[str] = []
        open_block, line = None, []
        opened = -1
        for i, text in self.runs:
            if not keep[i]:
                continue
            b = block[i]
            # a block that began between two runs of one block parts them as well
            if b != open_block or any(self.tags[j] in BLOCKS and block[j] == j and not self.drop[j] and b <= j <= ends[b] for j in range(opened + 1, i)):
                out.append("".join(line))
                line, open_block = [], b
            line.append(text)
            opened = max(opened, i)
        out.append("".join(line))
        return "\n".join(x for x in (" ".join(t.split()) for t in out) if x)


def main_text(html: str | None) -> str:
    """The main text of a page; empty for null, empty or text-free pages."""
    return Page(html).text() if html else ""


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The main text of each page: the id, ``keep`` columns, ``text``, ``n_chars`` (code points).

    One row per page, in the scan's own partitions; null and empty pages give an
    empty text, null ids and repeated rows stay, an empty table gives none. Long and
    deep pages take time and memory in proportion to their length, one at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    fields = ", ".join(f"`{c}` {dict(pages.dtypes)[c]}" for c in (id_column, *keep))
    return pages.select(id_column, *keep, html_column).mapInArrow(run, f"{fields}, text string, n_chars long")
