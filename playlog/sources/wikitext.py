"""Tables of wikitext as rows: a table function that reads a month's list of albums.

The text is cut into tokens once: what starts a row, a heading cell, a data cell.  Cells are laid on a grid, where one that spans rows stands in
each of them.  Markup is taken off by a reader that keeps what is open (links, templates, references, tags) on a stack.
"""

from __future__ import annotations

import datetime
import html
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Month names, and templates that stand for an argument of theirs: which one, from the first (0) or last (-1).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHOWN = {"nowrap": 0, "small": 0, "nobold": 0, "ill": 0, "interlanguage link": 0, "lang": -1}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<ref\b[^>]*/>|<ref\b[^>]*>|</ref\s*>|<br\s*/?>|<[^>]+>|\{\{|\}\}|\[\[|\]\]|\[(?=https?://)|\]|\|", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'|\[{<]+)\s*""")


class Cell:
    """A cell as written: its attributes and its text."""

    def __init__(self, text: str):
        self.attributes: dict[str, str] = {}
        at = len(text) - len(text.lstrip())
        found = []
        while m := _ATTRIBUTE.match(text, at):
            found.append((m[1].lower(), m[2].strip("\"'")))
            at = m.end()
        if found and text[at : at + 1] == "|" and text[at : at + 2] != "||":
            self.attributes, text = dict(found), text[at + 1 :]
        self.text = text

    @property
    def rows(self) -> int:
        span = self.attributes.get("rowspan", "1")
        return max(1, int(span)) if span.isdecimal() else 1


class Reader:
    """The plain text of a cell; links and the address of a citation on the way."""

    def __init__(self, text: str):
        self.links: list[str] = []
        self.url: str | None = None
        self.stack: list[tuple[str, list[str]]] = [("", [""])]
        at = 0
        for m in _TOKEN.finditer(text):
            self._add(text[at : m.start()])
            self._token(m[0])
            at = m.end()
        self._add(text[at:])
        while len(self.stack) > 1:  # what was never closed is text, but for references
            kind, parts = self.stack.pop()
            self._add("" if kind == "<ref>" else kind + "|".join(parts))
        self.text = self._trimmed("".join(self.stack[0][1]))

    @staticmethod
    def _trimmed(text: str) -> str:
        return " ".join(html.unescape(text.replace("'''", "").replace("''", "")).split()).strip(" ,")

    def _add(self, text: str) -> None:
        self.stack[-1][1][-1] += text

    def _inside(self, *kinds: str) -> bool:
        return self.stack[-1][0] in kinds

    def _token(self, t: str) -> None:
        low = t.lower()
        if t.startswith("<!--"):
            return
        if low.startswith("<ref"):
            if not t.endswith("/>"):
                self.stack.append(("<ref>", [""]))
        elif low.startswith("</ref"):
            while any(k == "<ref>" for k, _ in self.stack) and self.stack.pop()[0] != "<ref>":
                pass
        elif low.startswith("<br"):
            self._add(", ")
        elif t in ("{{", "[[", "["):
            self.stack.append((t, [""]))
        elif t == "|":
            if self._inside("{{", "[["):
                self.stack[-1][1].append("")
            else:
                self._add(t)
        elif t == "}}" and self._inside("{{"):
            self._add(self._template(self.stack.pop()[1]))
        elif t == "]]" and self._inside("[["):
            shown = self.stack.pop()[1][-1]
            if not any(k in ("<ref>", "{{") for k, _ in self.stack):
                self.links.append(self._trimmed(shown))
            self._add(shown)
        elif t == "]" and self._inside("["):
            self._add(self.stack.pop()[1][0].partition(" ")[2])
        elif not t.startswith("<"):
            self._add(t)

    def _template(self, parts: list[str]) -> str:
        name, named = parts[0].strip().lower(), dict(p.split("=", 1) for p in parts[1:] if "=" in p)
        url = next((v.strip() for k, v in named.items() if k.strip() == "url"), "")
        if self.url is None and url.startswith(("http://", "https://")):
            self.url = url.split()[0]
        plain = [p.strip() for p in parts[1:] if "=" not in p]
        if name == "sortname" and len(plain) >= 2:
            return f"{plain[0]} {plain[1]}"
        return plain[SHOWN[name]] if name in SHOWN and plain else ""


def _open(text: str) -> bool:
    """Whether a template or a reference is open at the end of a text."""
    refs = len(re.findall(r"<ref\b[^>]*(?<!/)>", text, re.I)) - len(re.findall(r"</ref", text, re.I))
    return text.count("{{") > text.count("}}") or refs > 0


def table_rows(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """(heading cells, data cells) of each row as written. A line that starts nothing goes on with the cell before it, and so does any while that cell has something open."""
    heads, data, last = [], [], None
    for line in text.split("\n"):
        if last and _open(last[-1]):
            last[-1] += "\n" + line
        elif line.startswith("|-"):
            yield heads, data
            heads, data, last = [], [], None
        elif line.startswith(("{|", "|}", "|+")):
            last = None
        elif line.startswith(("!", "|")):
            last = heads if line[0] == "!" else data
            last += line[1:].split("!!" if line[0] == "!" else "||")
        elif last:
            last[-1] += "\n" + line
    yield heads, data


def grid(text: str) -> Iterator[tuple[list[Cell], list[Cell]]]:
    """(heading cells, cells by column) of each row that has cells; a cell that spans rows stands in all of them."""
    held: dict[int, tuple[Cell, int]] = {}
    for heads, data in table_rows(text):
        written = [Cell(c) for c in data]
        if not written:
            if heads:
                yield [Cell(h) for h in heads], []
            continue
        row, left = [], iter(written)
        while True:
            cell, more = held.pop(len(row), (None, 0))
            if cell is None:
                cell = next(left, None)
                if cell is None:
                    break
                more = cell.rows
            if more > 1:
                held[len(row)] = (cell, more - 1)
            row.append(cell)
        held = {at: (c, n - 1) if at >= len(row) else (c, n) for at, (c, n) in held.items() if n > 1 or at < len(row)}
        yield [Cell(h) for h in heads], row


def day_of(text: str) -> int | None:
    """The day in a heading such as "October 23"."""
    words = Reader(text.replace("&nbsp;", " ")).text.replace(",", " ").split()
    for month, day in zip(words, words[1:]):
        digits = re.match(r"\d{1,2}(?!\d)", day)
        if month.lower() in MONTHS and digits:
            return int(digits[0])
    return None


@udtf(returnType="release_date date, artist string, title string, artist_parts array<string>, genre string, label string, source_url string")
class wikitext_rows:  # noqa: N801
    """The albums of a month's table: the day is in a heading that its rows share; then artist, album, genre, label and references.

    A row without an artist or a title, and one of a day that the month does not have, is left out; a null text has no rows.
    artist_parts are the linked artists where there are several.
    """

    def eval(self, text: str, year: int, month: int):  # noqa: A003
        day = None
        for heads, cells in grid(text or ""):
            for h in heads:
                day = day_of(h.text) or day
            if day is None or len(cells) < 2:
                continue
            read = [Reader(c.text) for c in cells]
            try:
                released = datetime.date(year, month, day)
            except (ValueError, TypeError):
                continue
            if read[0].text and read[1].text:
                rest = [r.text or None for r in read[2:4]] + [None, None]
                parts = read[0].links if len(read[0].links) > 1 else None
                yield released, read[0].text, read[1].text, parts, rest[0], rest[1], next((r.url for r in read[2:] if r.url), None)


def month_releases(pages: DataFrame, text: Column, year: Column, month: Column) -> DataFrame:
    """pages with the columns of wikitext_rows, a row an album: every page is read where it lies."""
    named = pages.withColumns({"__text": text, "__year": year.cast("int"), "__month": month.cast("int")})
    found = named.lateralJoin(wikitext_rows(F.col("__text").outer(), F.col("__year").outer(), F.col("__month").outer()))
    return found.drop("__text", "__year", "__month")
