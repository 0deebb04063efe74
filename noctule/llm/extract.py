"""Main text of web pages by tree scoring.

A page becomes a list of elements in page order, each with the range of text
runs below it.  Every run gives its block points for length and commas, less
where it is links; they go to the enclosing container, half to the next one
and less further up.  The container with most points, discounted by its share
of link text, is the article, together with siblings that score near it or
read as prose, and the heading before it.  Menus, page headers and footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are never part of it.  Names alone
do not drop what holds the page's articles or most of its text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as K

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</(?![a-zA-Z])[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p pre blockquote li dt dd td th h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
#: An opening tag ends an open element of these kinds, up to the limits.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED = frozenset("nav footer aside form button select fieldset dialog menu svg math canvas audio video object head".split())
ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar form".split())
#: Parts of class names and ids of what is not the article.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription paywall sidebar aside nav navbar navigation menu submenu breadcrumb breadcrumbs footer masthead pagination pager comment comments commentlist disqus respond "
    "replies share sharing social related recommended widget toolbar login signup skip".split())
#: Names of reader comments: no part of an article however long they are.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words that make the words behind them, or the whole name, tell about a layout and not about the element.
MODIFIERS, STATES = frozenset("has have with without no not".split()), frozenset("open closed enabled disabled on off".split())
#: Elements that names cannot drop.
KEPT = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGE_HEADER = frozenset(("header", "topbar"))
POINTS_AT, PROSE = 25, 80


def named(attributes: str) -> tuple[list[list[str]], set[str], bool]:
    """Words of each name in class and id, without those that tell about a layout; roles; whether the element is hidden."""
    names, roles, hidden = [], set(), False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if key.lower() in ("class", "id"):
            for name in value.replace("side-bar", "sidebar").split():
                words = re.findall(r"[a-z0-9]+", name)
                if words and words[-1] not in STATES:
                    names.append(words[:next((k for k, w in enumerate(words) if w in MODIFIERS), len(words))])
        elif key.lower() == "role":
            roles.update(value.split())
        elif key.lower() == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            hidden |= key.lower() == "hidden" or value == "true"
    return names, roles, hidden


class Page:
    """Elements and text runs of a page.  Element i has runs first[i] to last[i]; 0 stands for the page.

    ``named`` has the elements whose names are those of what is not the article, and whether nothing else is in the name;
    ``without`` is what to leave out of them.
    """

    def __init__(self, source: str, without: frozenset[int] = frozenset()) -> None:
        self.without, self.named = without, {}
        self.tags, self.parents, self.first, self.last = [""], [-1], [0], [0]
        self.texts: list[str] = []
        self.links: list[int] = []
        self.blocks: list[int] = []
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self.inside: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0
        at, stop = 0, source.rfind(">") + 1
        while at < stop:
            m = TOKEN.search(source, at, stop)
            if not m:
                break
            if m.start() > at:
                self.text(source[at:m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.close(tag)
                else:
                    self.open(tag, m[3] or "")
                    if tag in RAW:
                        end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(source, at)
                        at = end.end() if end else stop
                        self.close(tag)
        if at < len(source):
            self.text(source[at:])
        self.flush()
        while self.stack:
            self.pop()

    def text(self, part: str) -> None:
        if not self.stack[-1][2]:
            part = html.unescape(part) if "&" in part else part
            self.parts.append(part)
            if self.inside.get("a"):
                self.linked += len(part.strip())

    def flush(self) -> None:
        """End a run: its block is the innermost element that is not inline."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.texts.append(text)
                self.links.append(min(self.linked, len(text)))
                self.blocks.append(next(i for tag, i, _ in reversed(self.stack) if tag not in INLINE))
            self.parts, self.linked = [], 0

    def drops(self, tag: str, attributes: str) -> bool:
        if tag in DROPPED or tag in RAW:
            return True
        content = self.inside.get("article") or self.inside.get("main")
        if tag == "header":
            return not content
        if not attributes or tag in KEPT:
            return False
        names, roles, hidden = named(attributes)
        if hidden or ROLES & roles:
            return True
        unlikely = UNLIKELY if content else UNLIKELY | PAGE_HEADER
        hits = [words for words in names if not unlikely.isdisjoint(words)]
        if hits:
            self.named[len(self.tags)] = any(unlikely.issuperset(words) or not COMMENTS.isdisjoint(words) for words in hits)
        return len(self.tags) in self.without

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            if tag in ENDS:
                kinds, limits = ENDS[tag]
                self.end(kinds, limits)
            elif self.inside.get("p"):
                self.end({"p"}, {"td", "th", "table", "button", "object"} if tag != "br" else {"br", *KEPT, "p"})
        if tag in VOID:
            return
        dropped = self.stack[-1][2] or self.drops(tag, attributes)
        self.tags.append(tag)
        self.parents.append(self.stack[-1][1])
        self.first.append(len(self.texts))
        self.last.append(0)
        self.stack.append((tag, len(self.tags) - 1, dropped))
        self.inside[tag] = self.inside.get(tag, 0) + 1

    def end(self, kinds: set[str], limits: set[str]) -> None:
        """Close the innermost open element of these kinds, unless a limit comes first."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in kinds:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in limits:
                return

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.inside.get(tag):
            while self.pop() != tag:
                pass

    def pop(self) -> str:
        tag, i, _ = self.stack[-1]
        if tag not in INLINE:
            self.flush()
        self.stack.pop()
        self.last[i] = len(self.texts)
        if i:
            self.inside[tag] -= 1
        return tag


def unlikely(page: Page) -> frozenset[int]:
    """Elements to drop by name: not those that hold every article or main there is, or most of the page's text that is no link.

    The latter does not spare elements whose names are nothing but unlikely, and their text does not count.
    """
    n = len(page.tags)
    ends, pending = list(range(n)), [0] * n
    for i in range(n - 1, 0, -1):
        ends[page.parents[i]] = max(ends[page.parents[i]], ends[i])
    for i in range(1, n):
        pending[i] = pending[page.parents[i]] + (i in page.named)
    content = [i for i in range(1, n) if page.tags[i] in ("article", "main") and page.last[i] > page.first[i]]
    free = sum(not pending[i] for i in content)
    plain, upto = [len(text) - links for text, links in zip(page.texts, page.links)], 0
    for i, strong in page.named.items():
        if strong and page.last[i] > upto:
            plain[max(upto, page.first[i]):page.last[i]] = [0] * (page.last[i] - max(upto, page.first[i]))
            upto = page.last[i]
    sums = [0, *accumulate(plain)]
    out, dropped_to = set(), 0
    for i, strong in page.named.items():
        if i <= dropped_to:
            continue
        held = content[bisect_left(content, i):bisect_right(content, ends[i])]
        if (held and not free) or (not strong and 2 * (sums[page.last[i]] - sums[page.first[i]]) > sums[-1]):
            for k in held:
                pending[k] -= 1
                free += not pending[k]
        else:
            out.add(i)
            dropped_to = ends[i]
    return frozenset(out)


def article(source: str, by_name: bool) -> str:
    page = Page(source)
    if by_name and page.named and (without := unlikely(page)):
        page = Page(source, without)
    if not page.texts:
        return ""
    scores: dict[int, float] = {}
    for text, links, block in zip(page.texts, page.links, page.blocks):
        points = (1 + text.count(",") + min(len(text) // 100, 3) if len(text) >= POINTS_AT else len(text) / POINTS_AT) * (1 - links / len(text))
        node = page.parents[block] if page.tags[block] in PARAGRAPHS and block else block
        for level in range(5):
            if node < 0:
                break
            if node not in scores:
                scores[node] = 25.0 if page.tags[node] in ("article", "main") else 0.0
            scores[node] += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            node = page.parents[node]
    sizes, linked = [0], [0]
    for text, links in zip(page.texts, page.links):
        sizes.append(sizes[-1] + len(text))
        linked.append(linked[-1] + links)

    def density(i: int) -> float:
        size = sizes[page.last[i]] - sizes[page.first[i]]
        return (linked[page.last[i]] - linked[page.first[i]]) / size if size else 0.0

    value = {i: s * (1 - density(i)) for i, s in scores.items()}
    best = max(value, key=lambda i: (value[i], -i))
    near = 0.2 * value[best]
    runs = set(range(page.first[best], page.last[best]))
    parent = page.parents[best]
    for i in range(1, len(page.tags)) if parent >= 0 else ():
        if page.parents[i] == parent and i != best:
            text = " ".join(page.texts[page.first[i]:page.last[i]])
            prose = page.tags[i] == "p" and (density(i) < 0.25 if len(text) > PROSE else text.endswith(".") and density(i) == 0)
            if prose or value.get(i, 0.0) >= near > 0:
                runs.update(range(page.first[i], page.last[i]))
    if parent >= 0:  # headings between siblings that are kept
        span = range(min(runs, default=0), max(runs, default=-1))
        runs.update(i for i in span if page.parents[page.blocks[i]] == parent and page.tags[page.blocks[i]] in HEADINGS and 2 * page.links[i] < len(page.texts[i]))
    runs.update(titles(page, runs))
    return " ".join(page.texts[i] for i in sorted(runs))


def titles(page: Page, runs: set[int]) -> list[int]:
    """Runs of the headings an article without an h1 of its own begins with: those right before it, and the last h1 before it."""
    plain = lambda i: 2 * page.links[i] < len(page.texts[i])
    tag = lambda i: page.tags[page.blocks[i]]
    if any(tag(i) == "h1" and plain(i) for i in runs):
        return []
    out, at = [], min(runs, default=0) - 1
    while at >= 0 and tag(at) in HEADINGS and plain(at) and not (out and tag(out[-1]) == "h1" and page.blocks[at] != page.blocks[out[-1]]):
        out.append(at)
        at -= 1
    if not any(tag(i) == "h1" for i in out):
        last = next((i for i in range(at, -1, -1) if tag(i) == "h1" and plain(i)), None)
        out += [i for i in range(at + 1) if last is not None and page.blocks[i] == page.blocks[last]]
    return out


def main_text(source: str | None) -> str:
    """The article; if names of classes leave nothing, they are not heeded."""
    return (article(source, True) or article(source, False)) if source else ""


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Add text and n_chars (code points) to all rows.

    NULL, empty and textless pages give '' and 0.  Repeated rows are worked on
    alike, columns of the added names are replaced.  A page is held by one
    worker; its elements and runs take memory in proportion to its length.
    """
    kept = pages.drop("text", "n_chars")
    at = kept.columns.index(html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(at).to_pylist()]
            added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "text", "n_chars"])

    return kept.mapInArrow(run, K.StructType([*kept.schema.fields, K.StructField("text", K.StringType()), K.StructField("n_chars", K.LongType())]))
