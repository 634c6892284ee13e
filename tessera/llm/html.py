"""Main text of web pages: flat text blocks, classified by a small decision tree."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import small_batches

#: A tag that nothing ends goes on to the page's end. Repeats that nothing can follow do not give back, so tokens take time linear in the page.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*+)(?:>|\Z)""", re.DOTALL)
_NAMES = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_END = re.compile(r"""[.!?…:;»"”)\]][\s"'”)»]*$""")
#: Elements whose text is never shown as prose.
_RAW = frozenset("script style noscript template iframe svg title textarea canvas annotation annotation-xml".split())
#: Of these, the ones whose content is text, not markup.
_PLAIN = frozenset("script style iframe title textarea".split())
#: Elements that end a text block.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Containers that are kept on the stack of open elements.
_BOXES = frozenset("article aside blockquote button details dialog div dl fieldset figure footer form header label li main menu nav ol p search section select span table td ul h1 h2 h3 h4 h5 h6".split())
_FRAME = frozenset("nav aside footer menu button select label fieldset dialog search".split())
#: Words in class, id, role or aria-label that name something beside the article.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices popup modal "
    "nav navigation navbar menu breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar toolbar comment comments respond discussion disqus "
    "share sharing newsletter subscribe subscription signup login pagination complementary contentinfo copyright".split()
)
#: Words that may name a part of the article as well.
_MAYBE = frozenset("alert overlay aside rail foot header reply replies reactions social related recommended recommendations more trending popular search form pager tags skip disclaimer legal".split())
#: Parts of a name that mark a wrapper, whatever else the name says.
_WRAPS = frozenset("no has with without wrapper wrap container layout page".split())
#: Elements that hold a stretch of prose, not parts of a page; of their names only whole words count.
_PROSE = frozenset("p blockquote span li label td button h1 h2 h3 h4 h5 h6".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of the features, in the order of a block's row.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "sentence", "heading", "item", "article", "frame", "name", "page_header")


def _says_beside(tag: str, names: str) -> int:
    """How surely an element's names place it beside the article: 2 for a word that says so, 1 for one that may, 0."""
    if tag in _PROSE:
        return 2 * any(name.lower() in _BESIDE for name in names.split())
    parts = [{part.lower() for part in _PART.findall(name)} for name in names.split()]
    parts = [x for x in parts if not x & _WRAPS]
    return 2 if any(x & _BESIDE for x in parts) else int(any(x & _MAYBE for x in parts))


@dataclass
class Block:
    """One text block and what is known of its place."""

    text: str
    words: int
    links: float
    place: tuple[bool, bool, bool, bool, int, bool]


@dataclass
class _Open:
    tag: str
    name: int = 0
    forms: int = 0  # forms around an article: they hold the page, not the article's own form


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    in_link: bool = False
    tags: dict[str, int] = field(default_factory=dict)
    count: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("frame", "form", "beside", "maybe", "header", "article", "heading", "item"), 0))

    def _change(self, box: _Open, by: int) -> None:
        c, tag = self.count, box.tag
        self.tags[tag] = self.tags.get(tag, 0) + by
        c["form"] += by * (tag == "form")
        c["frame"] += by * (tag in _FRAME)
        c["beside"] += by * (box.name == 2)
        c["maybe"] += by * (box.name == 1)
        c["header"] += by * (tag == "header")
        c["article"] += by * (tag in ("article", "main"))
        c["heading"] += by * (tag in _HEADS)
        c["item"] += by * (tag == "li")
        if tag in ("article", "main"):
            if by > 0:
                box.forms = c["form"]
            c["form"] -= by * box.forms

    def end_block(self) -> None:
        text = " ".join(html.unescape("".join(self.texts)).split())
        if text:
            words = text.count(" ") + 1
            linked = len(html.unescape(" ".join(self.linked)).split())
            c = self.count
            header = c["header"] > 0 and not (c["article"] > 0 and c["heading"] > 0)
            name = 2 if c["beside"] > 0 else int(c["maybe"] > 0)
            place = (c["heading"] > 0, c["item"] > 0, c["article"] > 0, c["frame"] + c["form"] > 0, name, header)
            self.blocks.append(Block(text, words, min(1.0, linked / words), place))
        self.texts, self.linked, self.in_link = [], [], False

    def text(self, piece: str) -> None:
        if piece:
            self.texts.append(piece)
            if self.in_link:
                self.linked.append(piece)

    def tag(self, closing: bool, name: str, rest: str) -> None:
        if name in _BLOCKS:
            self.end_block()
        elif name == "br":
            self.text(" ")
        elif name == "a":
            self.in_link = not closing
        if name not in _BOXES:
            return
        if closing:
            if not self.tags.get(name):
                return
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at].tag == name:
                    for box in self.stack[at:]:
                        self._change(box, -1)
                    del self.stack[at:]
                    break
                if name == "p" or self.stack[at].tag in ("article", "main") and name in ("span", "li", "label"):
                    break
            return
        if rest.endswith("/"):
            return
        if name in _BLOCKS and self.stack and self.stack[-1].tag in ("p", *_HEADS) and self.stack[-1].tag != "span":
            self._change(self.stack.pop(), -1)  # a paragraph or heading ends where the next block begins
        named = 0
        if "=" in rest:
            named = _says_beside(name, " ".join(value.strip("\"'") for value in _NAMES.findall(rest)))
        box = _Open(name, named if name != "main" else 0)
        self.stack.append(box)
        self._change(box, 1)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; markup, scripts, styles and comments are gone, references decoded."""
    reader, at, raw = _Reader(), 0, ""
    inside: dict[str, int] = {}  # elements open in the raw one
    unclosed: set[str] = set()  # names that no later tag closes
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if raw:
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1] == "/" and name == raw:
                raw, at = "", m.end()
                continue
            if not m[1]:
                inside[name] = inside.get(name, 0) + (not m[3].endswith("/"))
                continue
            if inside.get(name):
                inside[name] -= 1
                continue
            if not (reader.tags.get(name) or name in ("head", "body", "html")):
                continue
            raw, at = "", m.start()  # the end of its parent
        reader.text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in _RAW:
            if not m[1] and not m[3].endswith("/"):
                raw, inside = name, {}
                if name in _PLAIN and name not in unclosed:
                    end = re.compile(rf"</{name}\b", re.IGNORECASE).search(page, at)
                    if end is not None:
                        at = end.start()
                    elif name in ("script", "style"):
                        at = len(page)
                        break
                    else:
                        unclosed.add(name)
            continue
        reader.tag(bool(m[1]), name, m[3])
    if not raw:
        reader.text(page[at:])
    reader.end_block()
    return reader.blocks


def feature_rows(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; neighbours outside the page count as empty."""
    none = Block("", 0, 0.0, (False, False, False, False, 0, False))
    rows = []
    for before, own, after in zip([none, *blocks], blocks, [*blocks[1:], none]):
        rows.append((own.words, own.links, before.words, before.links, after.words, after.links, bool(_END.search(own.text[-6:])), *own.place))
    return np.array(rows, float).reshape(-1, len(FEATURES))


_WORDS = "harbour board met old hall long talk price coal state quay agreed wait river town bridge council report winter field wheat ship wreck cape road bread salt stone light north".split()


class _Drawer:
    """Draws the labelled table's pages; the same seed gives the same pages."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def phrase(self, least: int, most: int) -> str:
        return " ".join(self.rng.choices(_WORDS, k=self.rng.randint(least, most))).capitalize()

    def sentences(self, least: int, most: int) -> str:
        """Whole sentences, some of whose words are links."""
        words, out = self.rng.randint(least, most), []
        while words > 0:
            n = min(words, self.rng.randint(2, 22))
            out.append(self.phrase(n, n) + self.rng.choice("...!?"))
            words -= n
        if self.rng.random() < 0.3:
            k = self.rng.randrange(len(out))
            first, *rest = out[k].split(" ")
            out[k] = " ".join([f"<a href=/x>{first} {' '.join(rest[:1])}</a>", *rest[1:]])
        return " ".join(out)

    def links(self) -> str:
        """A list of links in one of the forms that menus have."""
        names = [f"<a href=/x>{self.phrase(1, self.rng.choice((1, 2, 7)))}{self.rng.choice(('', '', '.', '!'))}</a>" for _ in range(self.rng.randint(1, 6))]
        form = self.rng.choice(("<ul>{}</ul>", "<div>{}</div>", "<p>{}</p>", "<nav>{}</nav>", '<div class="menu">{}</div>'))
        return form.format("".join(f"<li>{x}</li>" for x in names) if form[1] == "u" else self.rng.choice((" ", " | ", "<br>")).join(names))

    def aside(self) -> str:
        """Something beside the article: by its links, by its few words, by its element or by its name."""
        kind = self.rng.randrange(9)
        if kind < 3:
            return self.links()
        if kind == 3:
            return f"<div>{self.phrase(1, 4)}</div>"
        if kind == 4:
            return f'<div class="{self.rng.choice(("related", "more", "popular tags", "social"))}"><p>{self.phrase(1, 3)}</p>{self.links()}</div>'
        text = "".join(f"<p>{self.rng.choice((self.phrase, self.sentences))(1, 60)}</p>" for _ in range(self.rng.randint(1, 3)))
        text = self.rng.choice((text, f"<h3>{self.phrase(1, 3)}</h3>{text}", text[3:-4].replace("<p>", "<br>").replace("</p>", "")))
        if kind < 7:
            tag = self.rng.choice(("aside", "footer", "nav", "form", "header"))
            return f"<{tag}>{text}</{tag}>"
        tag = self.rng.choice(("div", "section"))
        return f'<{tag} {self.rng.choice(("class", "id"))}="{self.rng.choice(("ad", "advert box", "cookie-notice", "comments", "sidebar", "site-footer", "promo", "notice", "newsletter", "share-bar"))}">{text}</{tag}>'

    def prose(self, tagged: bool) -> str:
        """A piece of an article; where a tag marks the article it may as well be short or all link."""
        kind = self.rng.randrange(10)
        if kind == 0:
            return f"<h2>{self.phrase(1, 8)}</h2><p>{self.sentences(8, 60)}</p>"
        if kind == 1:
            return f"<ul>{''.join(f'<li>{self.phrase(3, 12)}</li>' for _ in range(self.rng.randint(2, 4)))}</ul><p>{self.sentences(12, 40)}</p>"
        if kind == 2:
            return f"<blockquote>{self.sentences(3, 30)}</blockquote>"
        if kind == 3:
            return f'<{(tag := self.rng.choice(("p", "div", "section")))} class="{self.rng.choice(("more", "legal", "related story", "form", "alert", "search"))}">{self.sentences(8, 60)}</{tag}>'
        if kind == 4 and tagged:
            return self.rng.choice((f"<p>{self.phrase(1, 4)}</p>", f"<p>{self.sentences(1, 3)}</p>", f"<p><a href=/y>{self.phrase(1, 9)}</a></p>", f"<table><tr><td>{self.phrase(1, 2)}</td><td>40</td></tr></table>", f"<pre>{self.phrase(1, 6)}</pre>"))
        return f"<{(tag := self.rng.choice(('p', 'p', 'p', 'div')))}>{self.sentences(1 if kind < 6 else 5, self.rng.choice((8, 30, 90)))}</{tag}>"

    def page(self) -> tuple[tuple[bool, str], ...]:
        """Fragments of a page, and whether each is of the article."""
        opened, closed = self.rng.choice((("", ""), ("<div>", "</div>"), ("<div>", "</div>"), ("<section>", "</section>"), ('<div class="more">', "</div>"), ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>")))
        tagged = opened in ("<article>", "<main>")
        page = [(False, self.aside()) for _ in range(self.rng.randint(0, 4))]
        page.append((True, f"{opened}<h1>{self.phrase(2, 10)}</h1>"))
        for _ in range(self.rng.randint(2, 9)):
            page.append((True, self.prose(tagged)))
            if tagged and self.rng.random() < 0.12:
                page.append((False, f'<div class="ad">{self.sentences(2, 20)}</div>' if self.rng.random() < 0.5 else f'<section id="comments"><p>{self.sentences(2, 40)}</p></section>'))
        page.append((True, closed))
        return *page, *((False, self.aside()) for _ in range(self.rng.randint(0, 4)))


def labelled(pages: int = 400, seed: int = 3) -> list[tuple[tuple[bool, str], ...]]:
    """The labelled table, drawn by a rule: each page as fragments with whether they belong to the article.

    Most of its pages mark the article by no element, and names mislead: words that may
    name something beside the article stand on articles and on lists of links alike.
    Elements such as nav or footer and names such as ad or comments hold
    text of any length, which nothing but them tells from an article.
    """
    drawer = _Drawer(seed)
    return [drawer.page() for _ in range(pages)]


@dataclass(frozen=True)
class Tree:
    """A binary decision tree; a leaf has no feature and a share of article blocks."""

    share: float
    at: int = -1
    most: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, row: np.ndarray) -> bool:
        node = self
        while node.at >= 0:
            node = node.low if row[node.at] <= node.most else node.high
        return node.share >= 0.5


def grow(rows: np.ndarray, labels: np.ndarray, depth: int, least: int = 4) -> Tree:
    """CART: the split with the least Gini impurity, the first of equals, down to pure leaves, ``depth`` or leaves of ``least`` rows."""
    share, n = float(labels.mean()), len(labels)
    best = (2 * share * (1 - share) - 1e-9, -1, 0.0)
    if depth and 0 < share < 1:
        for k in range(rows.shape[1]):
            order = np.argsort(rows[:, k], kind="stable")
            values, upto = rows[order, k], np.cumsum(labels[order])
            at = np.flatnonzero(values[1:] > values[:-1])
            at = at[(at + 1 >= least) & (n - at - 1 >= least)]
            low, high = upto[at] / (at + 1), (upto[-1] - upto[at]) / (n - at - 1)
            gini = 2 * ((at + 1) * low * (1 - low) + (n - at - 1) * high * (1 - high)) / n
            if len(at) and gini.min() < best[0] - 1e-12:
                i = int(gini.argmin())
                best = (float(gini[i]), k, float(values[at[i]] + values[at[i] + 1]) / 2)
    if best[1] < 0:
        return Tree(share)
    low = rows[:, best[1]] <= best[2]
    return Tree(share, best[1], best[2], grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least))


def table_rows(pages: Iterable[tuple[tuple[bool, str], ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a labelled table's blocks, seen where they stand in their page."""
    rows, labels = [], []
    for page in pages:
        ends = [len(blocks_of("".join(x for _, x in page[: k + 1]))) for k in range(len(page))]
        rows.append(feature_rows(blocks_of("".join(x for _, x in page))))
        labels += [label for (label, _), a, b in zip(page, [0, *ends], ends) for _ in range(b - a)]
    return np.vstack(rows), np.array(labels, float)


@lru_cache(maxsize=1)
def train(depth: int = 10) -> Tree:
    """Tree of the labelled table."""
    return grow(*table_rows(labelled()), depth)


def main_text(page: str | None, tree: Tree) -> tuple[str, int, int]:
    """Article of a page, its blocks joined by line feeds; blocks kept and seen."""
    blocks = blocks_of(page or "")
    kept = [b.text for b, row in zip(blocks, feature_rows(blocks)) if tree.predict(row)]
    return "\n".join(kept), len(kept), len(blocks)


def extract_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every page.

    The whole html is read, one page at a time, with no shuffle. Null or empty html and
    pages without an article give "" and 0. Repeated rows give repeated rows;
    columns other than page_id, url and html are not looked at.
    """
    small_batches(pages.sparkSession)
    tree = tree or train()

    @F.pandas_udf("text string, n_kept bigint, n_blocks bigint")
    def article(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages_ in batches:
            yield pd.DataFrame([main_text(page, tree) for page in pages_], columns=["text", "n_kept", "n_blocks"])

    out = pages.select("page_id", "url", article(F.col("html")).alias("found"))
    return out.select("page_id", "url", "found.text", F.length("found.text").cast("bigint").alias("n_chars"), "found.n_blocks", "found.n_kept")
