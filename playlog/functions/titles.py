"""Titles without what a shop or a service adds to them: edition notes, version notes, guests, release types.

A title is read as words and brackets.  Each rule looks at the set of words of a bracket, or of what follows a dash that stands alone.
The functions run on distinct titles, in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from playlog.functions.text import held

# Words that make an edition note, words that may stand beside them, words that make one together with "edition".
CORE = {"remaster", "remastered", "remasters", "remastering", "reissue", "reissued", "rerelease", "rereleased", "deluxe", "anniversary", "expanded", "mono", "stereo", "bonus"}
FILLER = {
    "digital", "version", "mix", "edition", "the", "original", "new", "super", "special", "limited", "track", "tracks", "and", "from", "album", "collectors", "collector's",
    "release", "re"}
LABEL = {
    "legacy", "special", "collector's", "collectors", "platinum", "gold", "limited", "tour", "international", "ultimate", "definitive", "standard", "classic", "bonus"}
# Words that mark a version, words in brackets that name a guest, and words that name one after the title.
VERSIONS = {
    "remaster", "remastered", "remasters", "live", "version", "edit", "edited", "edition", "mix", "mixed", "mono", "stereo", "demo", "acoustic", "bonus", "deluxe", "single",
    "explicit", "instrumental", "anniversary", "reissue", "reissued", "extended"}
GUESTS = {"feat", "ft", "featuring", "with"}
GUEST_FOLLOWS = {"feat", "feat.", "ft.", "featuring"}
# Words of album notes that an encyclopedia of releases leaves out, and those that may stand beside them.
ALBUM_CORE = {"deluxe", "remaster", "remastered", "edition", "expanded", "anniversary", "reissue", "re-issue", "mono", "stereo"}
ALBUM_FILLER = {
    "version", "bonus", "track", "tracks", "special", "collector's", "collectors", "limited", "standard", "super", "legacy", "platinum", "tour", "mix", "digital", "explicit",
    "clean", "digipak", "international", "and", "the", "&"}
# Other forms of apostrophes, dashes and brackets.
PLAIN = {"’": "'", "ʼ": "'", "–": "-", "—": "-", "‒": "-", "―": "-", "【": "[", "】": "]", "〔": "(", "〕": ")"}
TYPES = {"ep": "EP", "single": "Single"}

DASHES = ("-", "–", "—")
_ACCENTS = re.compile("[̀-ͯ]")


def _words(text: str) -> set[str]:
    """Words of letters and digits; an apostrophe within belongs to its word."""
    spaced = "".join(c if c.isalnum() or c == "'" else " " for c in text.casefold().replace("’", "'"))
    return {w for w in (x.strip("'") for x in spaced.split()) if w}


def _year(word: str, digits: int | None = 3) -> bool:
    """A year, or an ordinal of at most so many digits."""
    number = word[:-2] if word[-2:] in ("st", "nd", "rd", "th") else ""
    return (len(word) == 4 and word.isdecimal()) or (number.isdecimal() and (digits is None or len(number) <= digits))


def is_note(text: str) -> bool:
    """Whether a text says no more than which edition it is."""
    words = _words(text)
    names_it = words & CORE or ("edition" in words and words & LABEL)
    return bool(names_it) and all(w in CORE | FILLER | LABEL or _year(w) for w in words)


def is_album_note(text: str) -> bool:
    words = {w for w in (x.strip(".,:;") for x in text.lower().split()) if w}
    names_it = words & ALBUM_CORE or ("bonus" in words and words & {"track", "tracks"})
    return bool(names_it) and all(w in ALBUM_CORE | ALBUM_FILLER or _year(w, None) for w in words)


def without_brackets(title: str, drop: Callable[[str], bool]) -> str:
    """The title without innermost brackets whose content drop() takes, and without the blanks before them.

    What is open lies on a stack, so a bracket of which such an inner one was all but the note is judged after the inner one is gone.
    """
    open_parts: list[str] = [""]
    for c in title:
        if c in "([":
            open_parts.append(c)
        elif c in ")]" and len(open_parts) > 1:
            inside = open_parts.pop()
            plain = not set(inside[1:]) & set("()[]")
            if plain and drop(inside[1:]):
                open_parts[-1] = open_parts[-1].rstrip()
            else:
                open_parts[-1] += inside + c
        else:
            open_parts[-1] += c
    return "".join(open_parts)


def tails(title: str) -> Iterator[tuple[str, str]]:
    """(head, tail) at each dash that stands alone, from the last to the first."""
    words = title.split(" ")
    for i in range(len(words) - 2, 0, -1):
        if words[i] in DASHES:
            yield " ".join(words[:i]), " ".join(words[i + 1 :])


def _balanced(text: str) -> bool:
    return text.count("(") == text.count(")") and text.count("[") == text.count("]")


def edition_stripped(title: str) -> str:
    whole = " ".join(title.split())
    left = " ".join(without_brackets(whole, is_note).split())
    while (last := next(tails(left), None)) and is_note(last[1]) and _balanced(last[0]):
        left = last[0].rstrip("-–— ") if last[0].endswith(tuple(f" {d}" for d in DASHES)) else last[0]
    return left or whole


def _without_spans(text: str, words: set[str]) -> str:
    """The text without what lies from an opening bracket to the next closing one and has one of the words."""
    out, start = [], None
    for i, c in enumerate(text):
        if c in "([" and start is None:
            start = i
        elif c in ")]" and start is not None:
            inside = text[start : i + 1]
            out.append(" " if words & set(re.split(r"\W+", inside)) else inside)
            start = None
        elif start is None:
            out.append(c)
    return "".join(out) + (text[start:] if start is not None else "")


def loosened(title: str) -> str:
    plain = unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFKD", title).casefold()))
    words = _without_spans(plain, VERSIONS | GUESTS).split()
    dash = next((i for i, w in enumerate(words) if i and w in DASHES), None)
    if dash is not None and VERSIONS & set(re.split(r"\W+", " ".join(words[dash:]))):
        words = words[:dash]
    guest = next((i for i, w in enumerate(words) if 0 < i < len(words) - 1 and w in GUEST_FOLLOWS), len(words))
    return "".join(c for w in words[:guest] for c in w.replace("&", "and") if c.isalnum())


def prepared(title: str) -> str:
    """Compatibility form, plain punctuation, single blanks."""
    return " ".join("".join(PLAIN.get(c, c) for c in unicodedata.normalize("NFKC", title)).split())


def _simpler(title: str) -> tuple[str, str | None]:
    """One round of an album's title: brackets, then the last tail; and the type that the tail names."""
    text = without_brackets(title, lambda inside: not inside.strip() or is_album_note(inside))
    for bracket in "([":
        text = text.replace(f"{bracket} ", bracket)
    for bracket in ")]":
        text = text.replace(f" {bracket}", bracket)
    text = " ".join(text.split())
    kind, (head, tail) = None, next(tails(text), (text, "-"))
    if "-" not in tail and tail.lower() in TYPES:
        text, kind = head, TYPES[tail.lower()]
    elif "-" not in tail and is_album_note(tail):
        text = head
    return (text if text == title else text.strip(" -")), kind


def cleaned(title: str) -> tuple[str, str | None]:
    """An album's title without notes, and EP or Single where it ended so. Nothing is taken that would leave nothing."""
    text, kind = prepared(title), None
    while True:
        now, found = _simpler(text)
        if not now or now == text:
            return text, kind
        text, kind = now, found or kind


@held
@F.pandas_udf(StringType())
def strip_edition(titles: pd.Series) -> pd.Series:
    """Titles without edition notes in brackets or after a dash; a title that is a note alone stays."""
    return titles.map(edition_stripped, na_action="ignore")


@held
@F.pandas_udf(StringType())
def loose_title(titles: pd.Series) -> pd.Series:
    """Letters and digits of titles without accents, version notes and guests."""
    return titles.map(loosened, na_action="ignore")


@held
@F.pandas_udf(StructType().add("title", StringType()).add("kind", StringType()))
def clean_title(titles: pd.Series) -> pd.DataFrame:
    """(title, kind) of albums' titles: without notes, and EP or Single where the title ended so."""
    return pd.DataFrame([(None, None) if t is None else cleaned(t) for t in titles], columns=["title", "kind"])


@held
@F.pandas_udf(StringType())
def edition_free_title(titles: pd.Series) -> pd.Series:
    """Titles without notes; a title without one stays as it is written."""
    return titles.map(lambda t: t if (c := cleaned(t)[0]) == prepared(t) else c, na_action="ignore")
