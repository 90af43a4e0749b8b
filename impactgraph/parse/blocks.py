"""Text of brace languages with comments and strings blanked, its tokens, and its tree of brace blocks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
# What is blanked in each language; a Rust quote is a string only around one character, else a lifetime.
HIDDEN = {
    "script": "|".join((_COMMENT, _DOUBLE, _SINGLE, r"`(?:\\.|[^`\\])*`")),
    "go": "|".join((_COMMENT, _DOUBLE, _SINGLE, r"`[^`]*`")),
    "java": "|".join((_COMMENT, r'"""(?:\\.|.)*?"""', _DOUBLE, _SINGLE)),
    "rust": "|".join((_COMMENT, r'r(#*)".*?"\1', r'"(?:\\.|[^"\\])*"', r"'(?:\\[^\n]{1,10}?|[^'\\\n])'")),
}
_HIDDEN = {name: re.compile(pattern, re.DOTALL) for name, pattern in HIDDEN.items()}
_TOKEN = re.compile(r"[^\W\d][\w$]*|[$#@][\w$]*|\d[\w.]*|=>|->|::|\S")
_CLOSES = {"(": ")", "[": "]", "{": "}", "<": ">"}


@dataclass(frozen=True)
class Token:
    text: str
    at: int

    @property
    def is_name(self) -> bool:
        return self.text[0].isalpha() or self.text[0] in "_$#"


@dataclass
class Block:
    start: int
    parent: int
    end: int


@dataclass
class Source:
    """A file's text, the same text with hidden parts as blanks, and its blocks; block -1 is the file."""

    text: str
    language: str
    shown: str = ""
    blocks: list[Block] = field(default_factory=list)
    tokens: list[Token] = field(default_factory=list)
    #: Start and content of each string of one line.
    literals: list[tuple[int, str]] = field(default_factory=list)
    _places: list[int] = field(default_factory=list)
    _inside: list[int] = field(default_factory=list)
    _lines: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        def blank(m: re.Match) -> str:
            if m[0][0] in "'\"`" and "\n" not in m[0] and len(m[0]) > 1:
                self.literals.append((m.start(), m[0][1:-1]))
            return re.sub(r"[^\n]", " ", m[0])

        self.shown = _HIDDEN[self.language].sub(blank, self.text)
        self.tokens = [Token(m[0], m.start()) for m in _TOKEN.finditer(self.shown)]
        now = -1
        for m in re.finditer(r"[{}]", self.shown):
            if m[0] == "{":
                self.blocks.append(Block(m.start(), now, len(self.text)))
                now = len(self.blocks) - 1
            elif now >= 0:
                self.blocks[now].end = m.start()
                now = self.blocks[now].parent
            self._places.append(m.end())
            self._inside.append(now)
        self._lines = [m.end() for m in re.finditer("\n", self.text)]

    def token(self, i: int) -> str:
        """The i-th token's text; empty before the first and after the last."""
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def index_at(self, at: int) -> int:
        """The first token that starts at or after a place."""
        return bisect_left(self.tokens, at, key=lambda t: t.at)

    def opens_statement(self, i: int) -> bool:
        """Token i is the first of its line, or follows a brace or a semicolon."""
        if i == 0 or self.tokens[i - 1].text in "{};":
            return True
        return "\n" in self.shown[self.tokens[i - 1].at : self.tokens[i].at]

    def past(self, i: int) -> int:
        """The place after the bracket that closes token i; i itself where it opens none."""
        close = _CLOSES.get(self.token(i))
        if close is None:
            return i
        deep = 0
        for j in range(i, len(self.tokens)):
            text = self.tokens[j].text
            if text == self.tokens[i].text:
                deep += 1
            elif text == close:
                deep -= 1
                if not deep:
                    return j + 1
            elif close == ">" and text in ";{}":
                break
        return len(self.tokens) if close != ">" else i + 1

    def literal_after(self, at: int) -> str | None:
        """The first string that starts at or after a place."""
        found = bisect_left(self.literals, (at,))
        return self.literals[found][1] if found < len(self.literals) else None

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at) + 1

    def block_at(self, at: int) -> int:
        """The innermost block that holds a place."""
        found = bisect_right(self._places, at) - 1
        return self._inside[found] if found >= 0 else -1

    def body(self, at: int) -> int | None:
        """The block that a declaration opens: the first brace after it, unless its statement ends before."""
        home, deep = self.block_at(at), 0
        for m in re.compile(r"[(\[)\];{}]").finditer(self.shown, at):
            if m[0] in "([":
                deep += 1
            elif m[0] in ")]":
                deep -= 1
            elif m[0] == "{" and deep <= 0:
                found = self.block_at(m.end())
                return found if self.blocks[found].parent == home else None
            elif m[0] in ";}" and deep <= 0:
                return None
        return None

    def ends(self, at: int) -> int:
        """Last line of a declaration: that of its body's brace, else its own."""
        found = self.body(at)
        return self.line(at if found is None else min(self.blocks[found].end, max(0, len(self.text) - 1)))
