"""HTML extraction by tree scoring.

A page is parsed to a tree in one pass forward, tolerating unclosed and stray tags. Each paragraph earns points, one and
one more for each comma and each hundred characters up to three, and passes them to its ancestors: all to the parent,
half to the next, less beyond, and all of them, weighted, to every article and main element it is in (WEIGHTS). A
container's score is its points discounted by its link density. The best container is kept, and those of its siblings
that score well or read like text, and its headline; parts that are menus, headers, footers, sidebars, notices, adverts,
forms, scripts or comments by their tag, class, id or role never count. Outside an article or main element, lists, divs
and sections that are mostly links don't either. Inside one, these stay, and the words in class and id count for
containers, not for headings, paragraphs, list items, cells and quotations; what remains dropped there is what the tag,
role or hiding says, and containers named by such a word.

A tag ends at the first > outside quotes; from the first tag on whose quotes never close, at the first > of all. A
comment that isn't closed takes the rest. Time and memory grow with a page's size, whatever its tags.

Defined results: null or empty html, or a page without text outside those parts, gives an empty text. A page too short
for any score keeps its article, main or body. Ties go to the container that starts first. Repeated rows give equal
rows; other columns aren't read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.shared import slices, table

TAG = re.compile(r"[a-zA-Z][^\s/>]*")
#: Up to the end of a tag, over quoted values.
INSIDE = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*+")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select option template svg math canvas object audio video map dialog menu fieldset label legend".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open p, and those that end an open element of the second set, up to the nearest of the third.
BLOCKS = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HOLDS_P = frozenset("table td th caption button object html body".split())
BOILERPLATE = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo
promoted recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MAIN = frozenset(("article", "main"))
#: What a point of any paragraph below is worth to these.
WEIGHTS = {"article": 1.5, "main": 1.2}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption".split())
SHORT = 25
#: What ancestors from the nearest on get of a paragraph's points: one part of so many.
SHARES = (1, 2, 6, 9, 12, 15, 18, 21)
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    """inside: of an article or main element."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = (a or b or c).lower()
        if name in ("class", "id") and not (inside and tag in PARAGRAPHS) and not BOILERPLATE.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _groups() -> dict[str, tuple[list[int], list[int]]]:
    """For each tag the groups of CLOSES (p is the last) whose element it is, and those it keeps from looking further up."""
    kinds = [*{id(ends): (ends, within) for ends, within in CLOSES.values()}.values()]
    tags = {t for ends, within in kinds for t in ends | within} | HOLDS_P | {"p"}
    return {t: ([g for g, (ends, _) in enumerate(kinds) if t in ends] + [len(kinds)] * (t == "p"), [g for g, (_, within) in enumerate(kinds) if t in within] + [len(kinds)] * (t in HOLDS_P)) for t in tags}


_KINDS = [*{id(ends): ends for ends, _ in CLOSES.values()}.values()]
_GROUP_OF = {tag: next(g for g, ends in enumerate(_KINDS) if ends is CLOSES[tag][0]) for tag in CLOSES} | dict.fromkeys(BLOCKS, len(_KINDS))
_SCOPES = _groups()


class _Page:
    """Nodes in page order (a node comes after its parent) and blocks of text, each owned by a node."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.dropped, self.inside = ["#"], [0], [False], [False]
        self.owner: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        # The open elements, how many of each tag, and for each the places of the elements that a start tag could end.
        self.stack, self.open, self.scopes = [0], {"#": 1}, [(0,) * (len(_KINDS) + 1)]
        self.blocks = [0]  # the nearest element on the stack that isn't inline
        self.pieces: list[str] = []
        self.in_link = self.links = 0
        self.parse(source)
        while len(self.stack) > 1:
            self.pop()
        self.flush()

    def flush(self) -> None:
        if self.pieces:
            words = " ".join("".join(self.pieces).split())
            if words:
                self.owner.append(self.blocks[-1])
                self.text.append(words)
                self.linked.append(min(self.in_link, len(words)))
            self.pieces = []
        self.in_link = 0

    def add(self, part: str) -> None:
        if part and not self.dropped[self.stack[-1]]:
            part = html_lib.unescape(part)
            self.pieces.append(part)
            if self.links:
                self.in_link += len(part.strip())

    def pop(self) -> None:
        tag = self.tags[self.stack.pop()]
        self.scopes.pop()
        self.open[tag] -= 1
        self.links -= tag == "a"
        if tag not in INLINE:
            self.flush()
            self.blocks.pop()

    def start(self, tag: str, attributes: str) -> None:
        group = _GROUP_OF.get(tag)
        if group is not None and (at := self.scopes[-1][group]):
            while len(self.stack) > at:
                self.pop()
        if tag == "br":
            self.pieces.append(" ")
        elif tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        above = self.stack[-1]
        scope = self.scopes[-1]
        if tag in _SCOPES or tag not in INLINE and tag not in BLOCKS:
            ends, within = _SCOPES.get(tag, ((), ()))
            scope = list(scope)
            if tag not in INLINE and tag not in BLOCKS:
                scope[-1] = 0
            for g in within:
                scope[g] = 0
            for g in ends:
                scope[g] = len(self.stack)
            scope = tuple(scope)
        self.tags.append(tag)
        self.parents.append(above)
        self.dropped.append(self.dropped[above] or _boilerplate(tag, attributes, self.inside[above]))
        self.inside.append(self.inside[above] or tag in MAIN)
        self.stack.append(len(self.tags) - 1)
        self.scopes.append(scope)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        if tag not in INLINE:
            self.blocks.append(self.stack[-1])

    def end(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        elif self.open.get(tag):
            while self.tags[self.stack[-1]] != tag:
                self.pop()
            self.pop()
        elif tag not in INLINE:
            self.flush()

    def parse(self, source: str) -> None:
        at, size, loose, sections = 0, len(source), False, True
        while at < size:
            here = source.find("<", at)
            if here < 0:
                here = size
            self.add(source[at:here])
            sign = source[here + 1 : here + 2]
            if here == size:
                return
            if sign in ("!", "?"):
                if source.startswith("<!--", here):
                    short = next((n for n in (">", "->") if source.startswith(n, here + 4)), None)
                    stop = here + 4 + len(short) if short else source.find("-->", here + 4) + 3
                    at = size if stop < here + 4 else stop
                    continue
                stop = source.find("]]>", here) if sections and source.startswith("<![CDATA[", here) else -1
                if stop >= 0:
                    self.add(source[here + 9 : stop])
                    at = stop + 3
                    continue
                sections = sections and not source.startswith("<![CDATA[", here)  # none is closed from here on
                stop = source.find(">", here)
                at = size if stop < 0 else stop + 1
                continue
            name = TAG.match(source, here + 1 + (sign == "/"))
            if not name:
                self.add("<")
                at = here + 1
                continue
            stop = source.find(">", name.end()) if loose else INSIDE.match(source, name.end()).end()
            if not loose and not source.startswith(">", stop):
                loose, stop = True, source.find(">", name.end())
            if stop < 0:
                self.add(source[here:])
                return
            at, tag, attributes = stop + 1, name[0].lower(), source[name.end() : stop]
            if sign == "/":
                self.end(tag)
            elif tag in RAW:
                close = RAW_ENDS[tag].search(source, at)
                at = close.end() if close else size
            else:
                self.start(tag, attributes)


def main_text(source: str | None) -> str:
    """The article's blocks, joined by newlines."""
    if not source:
        return ""
    page = _Page(source)
    tags, parents, n = page.tags, page.parents, len(page.tags)
    points, below, chars, links = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for owner, text, linked in zip(page.owner, page.text, page.linked, strict=True):
        chars[owner] += len(text)
        links[owner] += linked
        if len(text) < SHORT:
            continue
        worth = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        node = parents[owner] if tags[owner] in PARAGRAPHS else owner
        below[node] += worth
        for share in SHARES:
            if not node:
                break
            points[node] += worth / share
            node = parents[node]
    for i in range(n - 1, 0, -1):  # children come after their parents
        chars[parents[i]] += chars[i]
        links[parents[i]] += links[i]
        below[parents[i]] += below[i]
    density = [a / b if b else 0.0 for a, b in zip(links, chars, strict=True)]
    score = [(WEIGHTS[t] * w if t in WEIGHTS else p) * (1 - d) for t, p, w, d in zip(tags, points, below, density, strict=True)]
    best = max(range(1, n), key=lambda i: (score[i], -i), default=0)
    if not best or score[best] <= 0:
        best = max((i for i in range(1, n) if tags[i] in MAIN and chars[i]), key=lambda i: chars[i], default=next((i for i in range(1, n) if tags[i] == "body"), 0))
    kept = [False] * n
    kept[best] = True
    if best and tags[best] not in ("body", "html"):
        least = max(10, score[best] / 5)
        for i in range(1, n):
            if parents[i] == parents[best] and (score[i] >= least or density[i] < 0.25 and (tags[i] == "p" and chars[i] > 80 or tags[i] == "h1")):
                kept[i] = True
    for i in range(1, n):
        kept[i] = kept[i] or kept[parents[i]] and not (tags[i] in ("ul", "ol", "div", "section") and density[i] > 0.7 and not page.inside[i])
    return "\n".join(t for o, t in zip(page.owner, page.text, strict=True) if kept[o])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
