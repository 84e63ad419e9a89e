"""The full-text query language: phrases, prefixes, AND, OR, NOT, NEAR, column filters, first-token marks.

A query becomes a list of phrases and a tree over them. Phrases that only stand side by side are
joined by AND, tighter than any written operator; then NOT, AND and OR bind in this order.
"""

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cache

MAX_CHARS = 1024
LEXEME = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x80-\U0010FFFF\x1a]+)|([():{}^*+,-]))')
TOKEN_MARKS = {*range(0x300, 0x305), *range(0x306, 0x30D), 0x30F, 0x311, 0x31B, *range(0x323, 0x329), 0x32D, 0x32E, 0x330, 0x331}
FOLD = str.maketrans("ςſµϐϑϕϖϰϱϵ", "σsμβθφπκρε")


class QueryError(ValueError):
    """The query is malformed."""


@dataclass
class Phrase:
    tokens: list[str]
    prefix: bool = False
    first: bool = False
    columns: tuple | None = None


@dataclass
class Query:
    phrases: list[Phrase] = field(default_factory=list)
    tree: tuple = ()


@cache
def folded_char(ch: str) -> str | None:
    """A character of a token, folded; None between tokens. Final sigma folds like any other, so
    characters can be folded one by one."""
    low = ch.lower().translate(FOLD)
    return low if all(unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" or ord(c) in TOKEN_MARKS for c in low) else None


def token_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and folded form of each token, by its place in the text as it is."""
    out, start, run = [], 0, []
    for at, ch in enumerate(text):
        low = folded_char(ch)
        if low is not None:
            start = start if run else at
            run.append(low)
        elif run:
            out.append((start, at, "".join(run)))
            run = []
    return out + ([(start, len(text), "".join(run))] if run else [])


def tokenize(text: str) -> list[str]:
    return [t for _, _, t in token_spans(text)]


class _Parser:
    def __init__(self, text: str, columns: tuple):
        self.columns, self.query, self.at, self.items = columns, Query(), 0, []
        pos, text = 0, text.rstrip()
        while pos < len(text):
            m = LEXEME.match(text, pos)
            if not m or m.end() == pos:
                raise QueryError(f"unexpected character at {pos}")
            kind = "string" if m[1] is not None else "word" if m[2] is not None else m[3]
            self.items.append((kind, m[1][1:-1].replace('""', '"') if m[1] is not None else m[2] or m[3]))
            pos = m.end()

    def peek(self, ahead: int = 0) -> tuple:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str) -> str:
        if self.peek()[0] != kind:
            raise QueryError(f"expected {kind}, found {self.peek()[1] or 'the end'}")
        self.at += 1
        return self.items[self.at - 1][1]

    def operator(self, word: str) -> bool:
        if self.peek() == ("word", word):
            self.at += 1
            return True
        return False

    def parse(self) -> Query:
        self.query.tree = self.either(None)
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]}")
        return self.query

    def either(self, cols) -> tuple:
        left = self.both(cols)
        while self.operator("OR"):
            left = ("or", left, self.both(cols))
        return left

    def both(self, cols) -> tuple:
        left = self.without(cols)
        while self.operator("AND"):
            left = ("and", left, self.without(cols))
        return left

    def without(self, cols) -> tuple:
        left = self.side_by_side(cols)
        while self.operator("NOT"):
            left = ("not", left, self.side_by_side(cols))
        return left

    def side_by_side(self, cols) -> tuple:
        left = self.primary(cols)
        while (left[0] != "group") and self.peek()[0] in ("string", "word", "^", "{", "-") and self.peek() not in (("word", "AND"), ("word", "OR"), ("word", "NOT")):
            left = ("and", left, self.primary(cols))
        return left

    def column_filter(self):
        """Columns that a filter names, or None if no filter starts here."""
        start, negated = self.at, self.peek()[0] == "-"
        self.at += negated
        names = []
        if self.peek()[0] == "{":
            self.at += 1
            while self.peek()[0] in ("word", "string"):
                names.append(self.peek()[1])
                self.at += 1
            self.take("}")
        elif self.peek()[0] in ("word", "string"):
            names.append(self.peek()[1])
            self.at += 1
        if not names or self.peek()[0] != ":":
            self.at = start
            if negated:
                raise QueryError("a column filter needs a colon")
            return None
        self.at += 1
        for n in names:
            if n.lower() not in self.columns:
                raise QueryError(f"no such column: {n}")
        named = {n.lower() for n in names}
        return tuple(c for c in self.columns if (c in named) != negated)

    def primary(self, cols) -> tuple:
        own = self.column_filter()
        if own is not None:
            cols = own if cols is None else tuple(c for c in cols if c in own)
        if self.peek()[0] == "(":
            self.at += 1
            inner = self.either(cols)
            self.take(")")
            return ("group", inner)
        if self.peek() == ("word", "NEAR") and self.peek(1)[0] == "(":
            self.at += 2
            members, distance = [], 10
            while self.peek()[0] in ("string", "word", "^"):
                members.append(self.phrase(cols))
            if self.peek()[0] == ",":
                self.at += 1
                number = self.take("word")
                if not number.isdigit():
                    raise QueryError("NEAR takes a number")
                distance = int(number)
            self.take(")")
            if not members:
                raise QueryError("NEAR needs a phrase")
            return ("near", members, distance)
        return ("phrase", self.phrase(cols))

    def phrase(self, cols) -> int:
        first = self.peek()[0] == "^"
        self.at += first
        found, prefix = [], False
        while True:
            kind, text = self.peek()
            if kind not in ("string", "word") or (kind == "word" and text in ("AND", "OR", "NOT")):
                raise QueryError(f"expected a term, found {text or 'the end'}")
            self.at += 1
            found += tokenize(text)
            if self.peek()[0] == "*":
                self.at += 1
                prefix = True
            if self.peek()[0] != "+":
                break
            self.at += 1
        self.query.phrases.append(Phrase(found, prefix, first, cols))
        return len(self.query.phrases) - 1


def parse(text: str, columns: tuple = ("title", "representation_label", "body")) -> Query:
    """Parse a query, or raise QueryError. Blank, over-long and control-bearing ones are refused."""
    text = unicodedata.normalize("NFC", text)
    if not text.strip() or len(text) > MAX_CHARS or any(ord(c) < 32 for c in text):
        raise QueryError("a query is 1 to 1,024 characters without control characters")
    return _Parser(text, columns).parse()
