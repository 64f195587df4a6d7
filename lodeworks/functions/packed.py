"""A parsing expression grammar for several names packed in one text.

    field    <- list / items
    list      <- a JSON array of texts
    items     <- sep* (item (sep+ item)*)? sep*
    item      <- quoted / listed / bracketed / bare
    quoted    <- opening quote, text without its closing quote, closing quote, then a separator or the end
    listed    <- the longest name of the vocabulary that starts here and ends before a separator or the end
    bracketed <- ( [ {, items up to the bracket that closes it (brackets nest), then a separator or the end
    bare      <- everything up to the next separator or the end
    sep       <- one of ; , | / & + tab line-break, or a word for "and" between blanks

Alternatives are tried in this order. A quote or bracket that does not close, or closes before anything but a
separator, is backtracked over: its mark is dropped, the item is parsed again without it and flagged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import NamedTuple

#: Opening and closing quotation marks. Fixed values.
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "„": "“", "‘": "’"}
#: Opening and closing brackets. Fixed values.
BRACKETS = {"[": "]", "(": ")", "{": "}"}
#: "and" in the languages of the corpus (en, de, fr, ru). Fixed values.
AND_WORDS = ("and", "und", "et", "и")
#: What stands between names; tested with Java's and Python's regular expressions alike.
SEPARATOR_HINT = rf"(?iu)[;,|/&+\t\n\r]|\s(?:{'|'.join(AND_WORDS)})\s"
_SEP = re.compile(rf"\s*(?:[;,|/&+\t\n\r]|(?<=\s)(?:{'|'.join(AND_WORDS)})(?=\s))\s*", re.IGNORECASE)
_MARKS = "".join({*QUOTES, *QUOTES.values()})
_CLOSING = "".join(BRACKETS.values())


class Piece(NamedTuple):
    """One value of a packed text: as it stands, whether the vocabulary has it, and whether a quote or bracket was broken."""

    item: str
    listed: bool
    broken: bool


def fold(text: str) -> str:
    """Lower case that keeps every position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Grammar:
    """The grammar over one vocabulary of names, matched whole and in any letter case."""

    def __init__(self, names: Iterable[str]):
        self.names = {fold(n.strip()) for n in names if n and n.strip()}
        starts: dict[str, set[int]] = {}
        for n in self.names:
            starts.setdefault(n[:3], set()).add(len(n))
        self.lengths = {k: sorted(v, reverse=True) for k, v in starts.items()}

    def parse(self, text: str | None) -> list[Piece]:
        """All non-empty values of a text in order; null, empty and blank texts give none."""
        if not text or not text.strip():
            return []
        if fold(text.strip()) in self.names:
            return [Piece(text.strip(), True, False)]
        whole = text.strip()
        if whole[0] == "[" and whole[-1] == "]":
            try:
                cells = json.loads(whole)
            except ValueError:
                cells = None
            if isinstance(cells, list):
                return [p for c in cells if c is not None for p in self._value(str(c))]
        return self._items(text)

    def _value(self, cell: str) -> list[Piece]:
        """A delimited value: whole where it is listed, else split where that gives two or more listed names."""
        cell = cell.strip()
        if not cell:
            return []
        if fold(cell) in self.names:
            return [Piece(cell, True, False)]
        inner = self._items(cell)
        return inner if sum(p.listed for p in inner) > 1 else [Piece(cell, False, False)]

    def _items(self, text: str) -> list[Piece]:
        low, n, at, out, broken = fold(text), len(text), 0, [], False
        closes, within = self._closed(text), []  # within: where the brackets that are open end, innermost last
        while at < n:
            limit = within[-1] if within else n
            if at == limit:
                within.pop()
                at, broken = at + 1, False
            elif text[at].isspace():
                at += 1
            elif sep := self._separator(text, at):
                at = sep
            elif end := self._quoted(text, at, limit):
                out += self._value(text[at + 1 : end])
                at, broken = end + 1, False
            elif end := self._listed(low, text, at, limit):
                out.append(Piece(text[at:end], True, broken))
                at, broken = self._skip_marks(text, end, limit), False
            elif at in closes:
                within.append(closes[at])
                at, broken = at + 1, False
            elif text[at] in QUOTES or text[at] in BRACKETS:
                at, broken = at + 1, True  # a mark that cannot be parsed as one
            else:
                end = self._bare(text, at, limit)
                if item := self._without_marks(text[at:end]):
                    out.append(Piece(item, fold(item) in self.names, broken))
                at, broken = end, False
        return out

    def _closed(self, text: str) -> dict[int, int]:
        """The closing place of each bracket that is closed in its order, before a separator, a bracket's end or the end."""
        out, held, open_ = {}, [], dict.fromkeys(BRACKETS.values(), 0)
        ends: set[int] = {len(text.rstrip())}
        for at, c in enumerate(text):
            if c in BRACKETS:
                held.append((at, BRACKETS[c]))
                open_[BRACKETS[c]] += 1
            elif open_.get(c):
                while held[-1][1] != c:
                    open_[held.pop()[1]] -= 1
                start, _ = held.pop()
                open_[c] -= 1
                out[start] = at
        for start, at in sorted(out.items()):  # an outer one is judged before those within it
            after = at + 1
            while after < len(text) and text[after].isspace():
                after += 1
            if after in ends or after >= len(text) or _SEP.match(text, at + 1):
                ends.add(at)
            else:
                del out[start]
        return out

    @staticmethod
    def _without_marks(text: str) -> str:
        """``text`` without blanks and quotes around it, and without closing brackets that nothing opened."""
        text = text.strip().strip(_MARKS).strip()
        over = {b: text.count(b) - text.count(a) for a, b in BRACKETS.items()}
        while text and over.get(text[-1], 0) > 0:
            over[text[-1]] -= 1
            text = text[:-1].rstrip(_MARKS + " ")
        return text

    @staticmethod
    def _separator(text: str, at: int) -> int | None:
        found = _SEP.match(text, at)
        return found.end() if found else None

    @staticmethod
    def _ends(text: str, at: int, limit: int) -> bool:
        while at < limit and text[at].isspace() and not _SEP.match(text, at):
            at += 1
        return at >= limit or bool(_SEP.match(text, at))

    def _quoted(self, text: str, at: int, limit: int) -> int | None:
        close = QUOTES.get(text[at])
        end = text.find(close, at + 1, limit) if close else -1
        while end >= 0:
            if self._ends(text, end + 1, limit):
                return end
            end = text.find(close, end + 1, limit)
        return None

    def _listed(self, low: str, text: str, at: int, limit: int) -> int | None:
        for size in self.lengths.get(low[at : at + 3], ()):
            if at + size <= limit and low[at : at + size] in self.names and (self._ends(text, at + size, limit) or text[at + size] in _MARKS + _CLOSING):
                return at + size
        return None

    @staticmethod
    def _skip_marks(text: str, at: int, limit: int) -> int:
        while at < limit and text[at] in _MARKS + _CLOSING:
            at += 1
        return at

    @staticmethod
    def _bare(text: str, at: int, limit: int) -> int:
        found = _SEP.search(text, at + 1, limit)
        return found.start() if found else limit
