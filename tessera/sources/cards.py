"""Cards and sections of pages of groups: which list stands below which company, and what it says.

A page is gone through once, as the parser tells it of its tags, with a stack of the open elements. A company's block
stays pending after its end until a list comes beside it, at the same depth and before the next company: the first
such list is its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.documents import _exploded

# fixed values: classes and words of the pages, and how phones and addresses are written
COMPANY, NAME, LIST, NONE = "remodel", "title", "postDiv", "暂无岗位"
ADDRESS = ("公司地址：", "工作地点：")
PHONE = re.compile(r"(?<!\d)(?:0\d{2,3}[-—]?\d{7,8}|1\d{10})(?!\d)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
CARD_ID = re.compile(r"newDet_(\d+)_8")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class _Open:
    tag: str
    classes: set[str]
    id: str
    kind: str | None = None
    text: list[str] = field(default_factory=list)
    name: str | None = None
    href: str | None = None


class _Walk(HTMLParser):
    """Companies with the text of their lists (None: no list of their own), and cards with their links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.pending: tuple[int, int] | None = None  # depth, and place in companies
        self.companies: list[list] = []  # name, id, text, text of the list
        self.cards: list[tuple[str, str | None]] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        e = _Open(tag, set((given.get("class") or "").split()), given.get("id") or "")
        beside = self.pending and self.pending[0] == len(self.open)
        if COMPANY in e.classes:
            e.kind, self.pending = "company", None if beside else self.pending
        elif LIST in e.classes and beside:
            e.kind = "list"
        elif "li" in e.classes and any(x.id == "pd1Data" for x in self.open):
            e.kind = "card"
        elif NAME in e.classes and self._in("company") and self._in("company").name is None:
            e.kind = "name"
        elif tag == "span" and self._in("card") and any("ar" in x.classes for x in self.open) and self._in("card").name is None:
            e.kind = "name"
        if tag == "a" and self._in("card") and "newDet_" in (given.get("href") or "") and self._in("card").href is None:
            self._in("card").href = given["href"]
        if tag not in VOID:
            self.open.append(e)

    def _in(self, kind: str) -> _Open | None:
        return next((e for e in reversed(self.open) if e.kind == kind), None)

    def handle_endtag(self, tag):
        if not any(e.tag == tag for e in self.open):
            return
        while True:
            e = self.open.pop()
            self._close(e)
            if e.tag == tag:
                return

    def _close(self, e: _Open) -> None:
        text = " ".join("".join(e.text).split())
        if e.kind == "name":
            owner = self._in("company") or self._in("card")
            if owner:
                owner.name = text
        elif e.kind == "company":
            self.companies.append([e.name or "", e.id, text, None])
            self.pending = (len(self.open), len(self.companies) - 1)
        elif e.kind == "list":
            self.companies[self.pending[1]][3] = text
            self.pending = None
        elif e.kind == "card":
            self.cards.append((e.name or "", e.href))

    def handle_data(self, data):
        for e in self.open:
            if e.kind:
                e.text.append(data)

    @classmethod
    def of(cls, html: str | None) -> _Walk:
        walk = cls()
        walk.feed(html or "")
        walk.close()
        while walk.open:
            walk._close(walk.open.pop())
        return walk


def _labelled(text: str) -> str | None:
    """What follows a label, up to white space."""
    for label in ADDRESS:
        if label in text and (found := text.split(label, 1)[1].split()):
            return found[0]
    return None


def _first(pattern: re.Pattern, text: str) -> str | None:
    found = pattern.search(text)
    return found[0] if found else None


def _sections(html: str | None) -> list[tuple]:
    out = []
    for name, anchor, text, posts in _Walk.of(html).companies:
        if name and posts is not None:
            out.append((len(out), name, anchor or None, "EMPTY_CONFIRMED" if posts == NONE else "CONTENT_FOUND", _labelled(text), _first(PHONE, text), _first(EMAIL, text)))
    return out


def _cards(html: str | None) -> list[tuple]:
    return [(name, href, (CARD_ID.search(href) or [None, None])[1]) for name, href in _Walk.of(html).cards if name and href]


_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]


def company_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Companies with a name and a list: place, name, anchor, state (EMPTY_CONFIRMED where the list only says that there is none), address, phone, email."""
    return _exploded(pages, key, html, T.StructType([T.StructField("place", T.IntegerType()), *_text("name", "anchor", "state", "address", "phone", "email")]), _sections)


def notice_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Cards of notices with a title and a link: title, href, item."""
    return _exploded(pages, key, html, T.StructType(_text("title", "href", "item")), _cards)


def page_states(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each page: how many sections and cards it has, and whether it is empty by its own words (EMPTY_CONFIRMED), has content, or shows neither (EMPTY_INFERRED)."""
    found = company_sections(pages, key, html).groupBy(key).agg(F.count(F.lit(1)).alias("sections"), F.count_if(F.col("state") == "EMPTY_CONFIRMED").alias("empty_sections"))
    counted = notice_cards(pages, key, html).groupBy(key).agg(F.count(F.lit(1)).alias("cards"))
    out = pages.select(key).join(found, key, "left").join(counted, key, "left").fillna(0, ["sections", "empty_sections", "cards"])
    state = F.when((F.col("sections") > 0) & (F.col("sections") == F.col("empty_sections")), "EMPTY_CONFIRMED").when(F.col("sections") > 0, "CONTENT_FOUND").otherwise("EMPTY_INFERRED")
    return out.withColumns({"state": state, "cards_state": F.when(F.col("cards") > 0, "CONTENT_FOUND").otherwise("EMPTY_INFERRED")})
