"""Texts of HTML pages: a small tree from the standard parser, and rules that pick the body."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a video player's help says, in lower case; a paragraph that holds one is no text.
PLAYER_HELP = ("accessible keys for video", "toggles play/pause", "seeks the video", "[space bar]", "[right/left arrows]", "[up/down arrows]", "increase/decrease volume", "watch live")
#: Words in a container's id or class that mark a player.
PLAYER_MARKS = ("video", "media", "player")
#: Fixed value: the paragraph that ends an article begins so.
ARTICLE_END = "return to text"
#: Where a page's body may lie.
BODY_PLACES = ("article", "main", "#content", ".content", ".page-content", ".bodycopy", ".cms-content", "div*content")
RENDERED_PLACES = ("article", "main", "#content", ".content", ".page-content", "#main-content", ".article-body", ".field--name-body", ".bodycopy")


class Node:
    """An element: its tag, id, classes, and children (elements and texts)."""

    __slots__ = ("tag", "id", "marks", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.id, self.marks, self.children = tag, attrs.get("id") or "", (attrs.get("class") or "").split(), []

    def walk(self) -> Iterator["Node"]:
        """This element and all below it, in order of the page."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def texts(self) -> Iterator[str]:
        todo = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            else:
                todo += reversed(n.children)

    def prune(self, unwanted: Callable[["Node"], bool]) -> None:
        for n in self.walk():
            n.children = [c for c in n.children if isinstance(c, str) or not unwanted(c)]

    def flat(self) -> str:
        """Trimmed texts, joined by blanks."""
        return " ".join(filter(None, (t.strip() for t in self.texts())))

    def fits(self, place: str) -> bool:
        """``tag``, ``#id``, ``.class`` or ``tag*part of a class``."""
        if place[0] in "#.":
            return place[1:] == self.id if place[0] == "#" else place[1:] in self.marks
        tag, _, part = place.partition("*")
        return self.tag == tag and part in " ".join(self.marks)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open[-1].tag == "p":
            self.open.pop()
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.open[0]


def _first(page: Node, *places: str) -> Node:
    return next((n for place in places for n in page.walk() if n.fits(place)), page)


def _is_player(n: Node) -> bool:
    marks = " ".join((n.id, *n.marks)).lower()
    return n.tag in ("script", "style") or "sr-only" in n.marks or (n.tag in ("div", "section") and any(m in marks for m in PLAYER_MARKS))


def _is_help(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in PLAYER_HELP) or re.search(r"share\b.*\bfacebook", low) is not None


def article_text(html: str | None) -> str:
    """Paragraphs of the article, by blank lines: within div#article, else #content, else the page; without
    players and their help; up to the paragraph that begins with "return to text"."""
    page = tree(html)
    page.prune(_is_player)
    out = []
    scope = next((n for n in page.walk() if n.tag == "div" and n.id == "article"), None) or _first(page, "#content")
    for p in scope.walk():
        if p.tag == "p" and (text := p.flat()) and not _is_help(text):
            if text.lower().startswith(ARTICLE_END):
                break
            out.append(text)
    return "\n\n".join(out)


def body_text(html: str | None, least: int = 400) -> str:
    """The longest text of the usual body containers, without navigation; under ``least`` characters,
    all paragraphs.  White space is collapsed."""
    page = tree(html)
    page.prune(lambda n: n.tag in ("script", "style", "nav", "footer", "header"))
    best = max((n.flat() for n in page.walk() if any(n.fits(x) for x in BODY_PLACES)), key=len, default="")
    if len(best) < least:
        best = " ".join("".join(n.texts()) for n in page.walk() if n.tag == "p")
    return " ".join(best.split())


def rendered_text(html: str | None, least: int = 500) -> str:
    """As a browser shows it: the paragraphs of the container with the longest text, or of the page where
    that has under ``least`` characters, by blank lines."""
    page = tree(html)
    page.prune(lambda n: n.tag in ("script", "style"))

    def shown(scope: Node) -> str:
        own = [" ".join("".join(n.texts()).split()) for n in scope.walk() if n.tag == "p"]
        return "\n\n".join(filter(None, own)) or scope.flat()

    best = max((shown(n) for n in page.walk() if any(n.fits(x) for x in RENDERED_PLACES)), key=len, default="")
    return re.sub(r"\n{3,}", "\n\n", best if len(best) >= least else shown(page)).strip()


def texts(pages: DataFrame, rule: Callable[[str | None], str] = article_text) -> DataFrame:
    """page_id, url, text by one of the rules above, a hundred pages at a time; unparseable or null pages are empty."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                b = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([rule(h) for h in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")


def longer_of(page_text: str | None, attachment: str | None) -> str:
    """The text of a page, or of the document it links to where that is longer."""
    return max(page_text or "", attachment or "", key=len)
