"""Fields of raw pages.  There is no HTML parser among the built-in functions; pages go through the standard library's in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_speaker

#: Elements that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


@dataclass
class Element:
    """An element with its text, in order of its start tag; ``parents`` are the elements it stands in, outer first."""

    tag: str
    attrs: dict[str, str]
    parents: tuple[int, ...]
    parts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def has(self, tag: str | None = None, css: str | None = None, ident: str | None = None) -> bool:
        """Whether it is a ``tag``, has all classes of ``css`` (or exactly that attribute) and the id ``ident``."""
        own = self.attrs.get("class", "")
        return (tag is None or self.tag == tag) and (ident is None or self.attrs.get("id") == ident) and (css is None or own == css or set(css.split()) <= set(own.split()))


class Page(HTMLParser):
    """The elements of a page.  An end tag closes the nearest open element of its name and what is open inside it; one that closes nothing is passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.elements.append(Element(tag, {k: v or "" for k, v in attrs}, tuple(self.open)))
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.elements[self.open[k]].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        for i in self.open:
            self.elements[i].parts.append(data)

    def all(self, tag: str | None = None, css: str | None = None, ident: str | None = None, inside: Element | None = None) -> list[Element]:
        """The elements asked for, in order; ``inside`` another one if that is given."""
        host = None if inside is None else next(i for i, e in enumerate(self.elements) if e is inside)
        return [e for e in self.elements if e.has(tag, css, ident) and (host is None or host in e.parents)]


def parse(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    return page


def select_texts(pages: DataFrame, key: str, html: str, tag: str | None = None, css: str | None = None, ident: str | None = None) -> DataFrame:
    """``key`` and ``texts``: the texts of all elements of a tag, class and id, in order, white space around them cut off; a null page has an empty list."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "texts": [[e.text.strip() for e in parse(h).all(tag, css, ident)] for h in pdf[html]]})

    return pages.select(key, html).mapInPandas(run, f"`{key}` {dict(pages.dtypes)[key]}, texts array<string>")


def page_fields(pages: DataFrame, key: str, html: str, category: str = "g-agenda__categoria", speech: str | None = None) -> DataFrame:
    """Fields of every page; a null page has nulls and empty lists.

    ``title``, ``heading`` (h1), ``bold`` texts, ``spans`` (of class ``speech`` if that is given), last segments of links ``codes``, ``body`` text, and ``cells``: for each table cell
    the text of its first span of class ``category`` and the last segment of its first link."""
    kind = dict(pages.dtypes)[key]
    last = lambda e: e.attrs["href"].rstrip("/").rsplit("/", 1)[-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, h in zip(pdf[key], pdf[html]):
                p = parse(h)
                of = lambda tag: [e.text.strip() for e in p.all(tag)]  # noqa: B023, E731
                first = lambda tag: next(iter(of(tag)), None)
                cells = []
                for cell in p.all("td"):
                    name = next((e.text.strip() for e in p.all("span", category, inside=cell)), None)
                    cells.append({"category": name, "code": next((last(e) for e in p.all("a", inside=cell) if e.attrs.get("href")), None)})
                rows.append((k, first("title"), first("h1"), of("b"), [e.text.strip() for e in p.all("span", speech)], [last(e) for e in p.all("a") if e.attrs.get("href")], first("body"), cells))
            yield pd.DataFrame(rows, columns=[key, "title", "heading", "bold", "spans", "codes", "body", "cells"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, title string, heading string, bold array<string>, spans array<string>, codes array<string>, body string, cells array<struct<category: string, code: string>>")


def agenda(fields: DataFrame, key: str) -> DataFrame:
    """Agenda cells: first word of the category and code of the link of the same cell; cells without a category, ``Outros`` and ``SECRETARIA`` go."""
    cells = fields.select(key, F.explode("cells").alias("c")).where(F.length("c.category") > 0)
    return cells.select(key, F.split("c.category", r"\s+")[0].alias("tipo"), F.col("c.code").alias("codigo")).where(~F.col("tipo").isin("Outros", "SECRETARIA"))


def assemble(fields: DataFrame, key: str) -> DataFrame:
    """Transcript text of a page: a line break for each bold speaker of the block, then all span texts."""
    speakers = F.size(F.filter("bold", is_speaker))
    return fields.select(key, F.concat(F.repeat(F.lit("\n"), speakers), F.array_join("spans", "")).alias("text"))


def has_notes(fields: DataFrame) -> DataFrame:
    """Pages whose body holds more than 300 characters."""
    return fields.where(F.length("body") > 300)


def failed(pages: DataFrame, *keep: str) -> DataFrame:
    """Codes whose status is exactly 500."""
    return pages.where("status = 500").select(*keep, "fonte", "tipo", "codigo")
