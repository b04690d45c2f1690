"""Text of pages by their elements: a tree with nesting, void and unclosed tags, matched by tag, class and attribute.

A batch of pages goes to Python as Arrow once; a page is read in one pass into a flat list of elements
in document order, each with the place where its subtree ends, so "inside" is a comparison of places. What to take is a
``Site``: data, not code. Lengths, order of trust and status stay Columns (``functions.extract.cascade``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.sources.store import lean

# Elements without an end, elements whose text is never content, blocks of text, and where navigation stands.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
SILENT = ("script", "style", "noscript", "template")
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "pre", "div", "section", "article", "main", "body", "aside", "header", "footer", "form", "figcaption")
APART = ("nav", "header", "footer", "aside", "form", "button", "select", "figure", "iframe", "title", "head")


@dataclass(slots=True)
class Element:
    """An element, or a piece of text (tag empty). end: place after its subtree."""

    tag: str
    parent: int
    attributes: dict[str, str]
    classes: frozenset[str]
    text: str = ""
    end: int = 0


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found = [Element("", -1, {}, frozenset())]
        self.open = [0]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.found.append(Element(tag, self.open[-1], own, frozenset(own.get("class", "").split())))
        if tag in VOID:
            self.found[-1].end = len(self.found)
        else:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        """Closes the nearest open element of this name and what is open in it; an end without a start is passed over."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.found[self.open[k]].tag == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if data:
            self.found.append(Element("", self.open[-1], {}, frozenset(), data, len(self.found) + 1))

    def _close(self, k: int) -> None:
        for i in self.open[k:]:
            self.found[i].end = len(self.found)
        del self.open[k:]


def read(html: str) -> list[Element]:
    """Elements and texts in document order; the first is the page itself."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._close(0)
    return reader.found


_STEP = re.compile(r"(?P<tag>[\w-]*)(?P<rest>(?:\.[\w-]+|\[[\w-]+(?:=['\"]?[^\]'\"]*['\"]?)?\])*)")


@dataclass(frozen=True)
class Step:
    """A simple selector: a tag, classes that all must be there, attributes (None: of any value)."""

    tag: str
    classes: frozenset[str]
    attributes: tuple[tuple[str, str | None], ...]

    def fits(self, x: Element) -> bool:
        return bool(x.tag) and self.tag in ("", x.tag) and self.classes <= x.classes and all(k in x.attributes and v in (None, x.attributes[k]) for k, v in self.attributes)


def path(selector: str) -> tuple[Step, ...]:
    """``div.a[b='c'] p`` as steps, each somewhere inside the one before."""
    steps = []
    for word in re.findall(r"(?:\[[^\]]*\]|\S)+", selector):
        found = _STEP.fullmatch(word)
        if not found:
            raise ValueError(f"no selector {word!r}")
        pairs = re.findall(r"\[([\w-]+)(=['\"]?([^\]'\"]*)['\"]?)?\]", found["rest"])
        steps.append(Step(found["tag"], frozenset(re.findall(r"\.([\w-]+)", re.sub(r"\[[^\]]*\]", "", found["rest"]))), tuple((k, v if eq else None) for k, eq, v in pairs)))
    return tuple(steps)


def select(page: list[Element], root: int, *selectors: str) -> list[int]:
    """Places of the elements inside ``root`` that match any selector, in document order. Steps before the last may match outside of it."""
    paths = [path(s) for s in selectors]

    def fits(i: int, steps: tuple[Step, ...]) -> bool:
        if not steps[-1].fits(page[i]):
            return False
        up, left = page[i].parent, len(steps) - 2
        while up > 0 and left >= 0:
            left -= steps[left].fits(page[up])
            up = page[up].parent
        return left < 0

    return [i for i in range(root + 1, page[root].end) if page[i].tag and any(fits(i, p) for p in paths)]


def inline(text: str) -> str:
    """One blank between words, none before signs."""
    return re.sub(r"\s+([,.:;!?])", r"\1", re.sub(r"\s+", " ", text).strip())


def text_of(page: list[Element], root: int, without: frozenset[int] = frozenset()) -> str:
    """Pieces of text inside ``root`` but not inside elements ``without`` (places) or silent ones, joined by blanks."""
    out, i = [], root + (1 if page[root].tag or root == 0 else 0)
    while i < page[root].end:
        x = page[i]
        if i in without or x.tag in SILENT:
            i = x.end
            continue
        if not x.tag and x.text.strip():
            out.append(x.text.strip())
        i += 1
    return inline(" ".join(out))


def runs(page: list[Element], root: int, blocks: frozenset[int], without: frozenset[int]) -> list[str]:
    """Text of the blocks (places) inside ``root`` in document order, each piece once, with the innermost block that holds it."""
    out, own, last, i = [], {root: 0}, 0, root + 1
    while i < page[root].end:
        x = page[i]
        if i in without or x.tag in SILENT:
            i = x.end
            continue
        own[i] = i if i in blocks else own[x.parent]
        if not x.tag and own[i] and x.text.strip():
            if own[i] != last:
                out.append([])
            last = own[i]
            out[-1].append(x.text.strip())
        i += 1
    return [inline(" ".join(parts)) for parts in out]


@dataclass(frozen=True)
class Site:
    """Where a site's articles stand. All selectors are as for ``path``.

    roots: the first that is there is searched, else the page (with ``must``: nothing). blocks: what holds the text. kinds: for the
    values of attribute ``by`` of a block, where its text is (the first that is there, else the block); blocks of other
    values go. direct: blocks are the root's own children of these tags. lines: a block's paragraphs are lines. lead: its text comes first, or with
    ``lead_apart`` is returned apart. tags: their links are tags. without: elements that are no text. noise: blocks with one of these phrases go. least: letters that the text must have. once: blocks inside others
    stand by themselves, and what follows them in the outer one too (not with direct, kinds, lines, lead).
    """

    blocks: tuple[str, ...]
    roots: tuple[str, ...] = ()
    must: bool = False
    by: str = ""
    kinds: tuple[tuple[str, tuple[str, ...]], ...] = ()
    direct: bool = False
    lines: bool = False
    lead: str = ""
    lead_apart: bool = False
    tags: str = ""
    without: tuple[str, ...] = ("script", "style", "figure", "noscript", "iframe", "aside")
    noise: tuple[str, ...] = ()
    least: int = 200
    once: bool = False


def article(page: list[Element], site: Site) -> dict:
    """text (blocks, a blank line between), lead, tags, blocks (their number) of a page; text is null below ``least``."""
    root = next((at[0] for s in site.roots if (at := select(page, 0, s))), None)
    if root is None and site.must:
        return {"text": None, "lead": None, "tags": [], "blocks": 0}
    root = root or 0
    gone = frozenset(select(page, 0, *site.without)) if site.without else frozenset()
    lead = next((text_of(page, i, gone) for i in select(page, 0, site.lead)), "") if site.lead else ""
    found = [i for i in range(root + 1, page[root].end) if page[i].parent == root and page[i].tag in site.blocks] if site.direct else select(page, root, *site.blocks)
    lead_at = set(select(page, 0, site.lead)) if site.lead else set()

    def whole() -> Iterator[str]:
        for i in found:
            if i in lead_at or i in gone:
                continue
            at = [i]
            if site.kinds:
                inner = dict(site.kinds).get(page[i].attributes.get(site.by, "").strip())
                if inner is None:
                    continue
                at = [next((n[0] for s in inner if (n := select(page, i, s))), i)]
            elif site.lines:
                at = select(page, i, "p", "li", "blockquote") or [i]
            yield "\n".join(t for k in at if (t := text_of(page, k, gone)))

    parts = [lead] if lead and not site.lead_apart else []
    count = 0
    for text in runs(page, root, frozenset(found), gone) if site.once else whole():
        if text and not any(n.lower() in text.lower() for n in site.noise):
            parts.append(text)
            count += 1
    text = "\n\n".join(parts).strip()
    links = [t for i in select(page, 0, site.tags)[:1] for k in select(page, i, "a") if (t := text_of(page, k))] if site.tags else []
    return {"text": text if len(text) >= site.least else None, "lead": lead or None if site.lead_apart else None, "tags": links, "blocks": count}


def dense(page: list[Element], recall: bool = False) -> str | None:
    """Blocks of running text, one a line, each once.

    A block is an element of BLOCKS with the text that is in it and in no block inside it; its link share is the part of
    that text that is inside links. With precision a block has 25 letters and more, a link share of at most 0.3, and lies in the article or
    main element where there is one, and in nothing of APART; headings count between such blocks. With recall it has
    any length and a share of at most 0.5, and lies in no navigation.
    """
    roots = [] if recall else select(page, 0, "article", "main")
    inside = [(i, page[i].end) for i in roots] or [(0, page[0].end)]
    pieces: dict[int, list[tuple[str, bool]]] = {}
    state = [(0, False, False)] * len(page)  # by element: its block, whether in a link, whether set apart
    for i, x in enumerate(page):
        block, link, apart = state[x.parent] if x.parent >= 0 else (0, False, False)
        if x.tag:
            state[i] = (i if x.tag in BLOCKS else block, link or x.tag == "a", apart or x.tag in SILENT or x.tag in (("nav", "head", "title", "button", "select") if recall else APART))
        elif x.text.strip() and not apart and any(a <= i < z for a, z in inside):
            pieces.setdefault(block, []).append((x.text.strip(), link))
    lines: dict[str, bool] = {}
    for i, parts in pieces.items():  # by the first text
        text = inline(" ".join(t for t, _ in parts))
        share = sum(len(t) for t, link in parts if link) / max(1, sum(len(t) for t, _ in parts))
        heading = page[i].tag[:1] == "h" and page[i].tag[1:].isdigit()
        if text and (share <= 0.5 if recall else share <= 0.3 and (len(text) >= 25 or heading)):
            lines.setdefault(text, heading)
    while lines and not recall and lines[last := next(reversed(lines))]:  # a heading at the end has no text
        del lines[last]
    return "\n".join(lines) or None


def structured(page: list[Element], thumbnail: str = "") -> list[dict]:
    """Headings, paragraphs and images that stand at the top of a fragment, in order; sliders' images come before their paragraph's text. Headers, widgets, feeds and placeholders go."""
    out, seen = [], {thumbnail.strip(), ""}

    def image(i: int) -> None:
        source = next((page[k].attributes.get("src", "").strip() for k in select(page, i, "img")), "")
        if source not in seen:
            seen.add(source)
            caption = next((text_of(page, k) for k in select(page, i, "figcaption")), "")
            out.append({"kind": "image", "level": None, "text": caption or None, "src": source})

    for i, x in enumerate(page):
        if x.parent != 0 or not x.tag:
            continue
        if x.tag in ("h2", "h3", "h4") and (text := text_of(page, i)):
            out.append({"kind": "heading", "level": int(x.tag[1]), "text": text, "src": None})
        elif x.tag == "p":
            sliders = select(page, i, "div[data-block='slider']")
            for k in sliders:
                for f in select(page, k, "figure"):
                    image(f)
            if text := text_of(page, i, frozenset([*sliders, *select(page, i, "figure")])):
                out.append({"kind": "paragraph", "level": None, "text": text, "src": None})
        elif x.tag == "figure" and not x.attributes.get("data-turbo-ad-id"):
            image(i)
    return out


# Phrases of a page's controls, and how four sites mark their articles.
CONTROLS = ("Доступ к чату заблокирован", "Чтобы участвовать в дискуссии", "Обсуждение закрыто", "Заголовок открываемого материала", "Войдите, чтобы оставить комментарий")
SITES = {
    "rt": Site((".article__summary", ".article__text"), lines=True, tags=".article__tags-trends", without=("script", "style", "figure", "noscript", "iframe")),
    "ria": Site((".article__block",), roots=(".article__body",), by="data-type", kinds=(("text", (".article__text",)), ("quote", (".article__quote-text", ".article__quote"))), noise=CONTROLS, least=100),
    "bfm": Site(("p", "blockquote"), roots=("section.inner-news.article-news .current-article.js-mediator-article", ".current-article.js-mediator-article"), must=True, direct=True, lead="p.about-article", lead_apart=True, without=(".see_also", "script", "style", "figure", "noscript", "iframe")),
    "vedomosti": Site((".article-boxes-list__item .box-paragraph__subtitle", ".article-boxes-list__item .box-paragraph__text"), roots=(".article-boxes-list",), lead=".article-headline__subtitle"),
}
#: As ``ria``, for short articles: any text from trusted blocks.
SHORT = {"ria": Site(**{k: getattr(SITES["ria"], k) for k in Site.__dataclass_fields__} | {"least": 40})}

#: Pages of a batch whose elements, texts and findings are Python objects at a time.
PART = 64


def _parted(work, *columns: pa.Array) -> pa.Array:
    """``work`` on the columns of a batch, PART rows at a time: the rest of the batch stays packed."""
    return pa.concat_arrays([work(*(c.slice(k, PART) for c in columns)) for k in range(0, max(1, len(columns[0])), PART)])


FOUND = "struct<site: string, lead: string, tags: array<string>, blocks: int, precise: string, broad: string>"
STRUCTURED = "array<struct<kind: string, level: int, text: string, src: string>>"
_EMPTY = {"site": None, "lead": None, "tags": [], "blocks": 0, "precise": None, "broad": None}


@dataclass(frozen=True)
class Extractor:
    """What to do with pages. drop: selectors of elements that are taken out before anything else. escaped: the page stands escaped within another."""

    sites: dict[str, Site] = field(default_factory=lambda: SITES)
    drop: tuple[str, ...] = ()
    escaped: bool = False

    def read(self, html: str | None) -> list[Element]:
        page = read(unescape(html or "") if self.escaped else html or "")
        gone = select(page, 0, *self.drop) if self.drop else []
        if not gone:
            return page
        kept = [True] * len(page)
        for i in gone:
            kept[i : page[i].end] = [False] * (page[i].end - i)
        place = [0, *accumulate(kept)]  # how many are kept before each
        for x in page:
            x.parent, x.end = place[x.parent] if x.parent > 0 else x.parent, place[x.end]
        return [x for x, k in zip(page, kept, strict=True) if k]

    def __call__(self, html: pa.Array, site: pa.Array) -> pa.Array:
        rows = []
        for page, name in zip(html.to_pylist(), site.to_pylist(), strict=True):
            if page is None:
                rows.append(_EMPTY)
                continue
            at = self.read(page)
            own = article(at, self.sites[name]) if name in self.sites else {"text": None, "lead": None, "tags": [], "blocks": 0}
            rows.append({"site": own["text"], "lead": own["lead"], "tags": own["tags"], "blocks": own["blocks"], "precise": dense(at), "broad": dense(at, recall=True)})
        kind = pa.struct([("site", pa.string()), ("lead", pa.string()), ("tags", pa.list_(pa.string())), ("blocks", pa.int32()), ("precise", pa.string()), ("broad", pa.string())])
        return pa.array(rows, kind)

    def column(self, html: Column, site: Column) -> Column:
        """A struct of the site's own text, lead, tags and number of blocks, and the dense text with precision and recall."""

        def found(html: pa.Array, site: pa.Array) -> pa.Array:
            return _parted(self, html, site)

        lean()
        return F.arrow_udf(found, FOUND)(html, site)


def structured_blocks(html: Column, thumbnail: Column) -> Column:
    """``structured`` of each (escaped) fragment."""

    def part(html: pa.Array, thumbnail: pa.Array) -> pa.Array:
        rows = [structured(read(unescape(h or "")), t or "") for h, t in zip(html.to_pylist(), thumbnail.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("src", pa.string())])))

    def found(html: pa.Array, thumbnail: pa.Array) -> pa.Array:
        return _parted(part, html, thumbnail)

    lean()
    return F.arrow_udf(found, STRUCTURED)(html, thumbnail)


def element_counts(html: Column) -> Column:
    """How many elements of each tag a page has, and how many open ones nothing closes, as a list of structs."""

    def found(html: pa.Array) -> pa.Array:
        rows = []
        for h in html.to_pylist():
            count: dict[str, int] = {}
            for x in read(h or ""):
                if x.tag:
                    count[x.tag] = count.get(x.tag, 0) + 1
            rows.append([{"tag": k, "n": n} for k, n in sorted(count.items())])
        return pa.array(rows, pa.list_(pa.struct([("tag", pa.string()), ("n", pa.int64())])))

    lean()
    return F.arrow_udf(found, "array<struct<tag: string, n: long>>")(html)
