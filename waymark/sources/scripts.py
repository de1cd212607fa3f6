"""Definitions in JavaScript and TypeScript, found by one pass over a text's tokens and their brackets.

No grammar is parsed: a text that is broken in one place still gives the definitions of the rest.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

#: Most characters of a name, string or number that count in a shingle.
TOKEN_MOST = 32
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<name>[#@]?[A-Za-z_$\u0080-￿][\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
    |(?P<mark>=>|[=!<>]=+|&&=?|\|\|=?|\?\?=?|\?\.|\*\*|\+\+|--|[-+*/%&|^]=|\.\.\.|.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}
#: Words after which an expression begins.
_WANTS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "await", "yield", "extends"}
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "function", "return"}


class Token(NamedTuple):
    kind: str
    text: str
    at: int
    #: Whether a line ends before it.
    fresh: bool


def tokens(text: str) -> list[Token]:
    """The tokens of a text without blanks and comments. A slash begins a regular expression where no operand precedes it."""
    out: list[Token] = []
    at, fresh = 0, False
    while at < len(text):
        m = None
        if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and not (out and (_operand(out[-1]) or out[-1].text == "<")):
            m = _REGEX.match(text, at)
        kind = "string" if m else ""
        m = m or _TOKEN.match(text, at)
        kind, at = kind or m.lastgroup, m.end()
        if kind == "skip":
            fresh |= "\n" in m.group()
            continue
        out.append(Token(kind, m.group(), m.start(), fresh))
        fresh = False
    return out


def _operand(t: Token) -> bool:
    """Whether an expression may end with it."""
    return t.text in _CLOSE if t.kind == "mark" else t.text not in _WANTS


class _Text:
    def __init__(self, text: str):
        self.t = tokens(text)
        self.close: dict[int, int] = {}
        self.within: list[int] = []
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "mark" and t.text in _CLOSE and stack:
                self.close[stack.pop()] = i
            self.within.append(stack[-1] if stack else -1)
            if t.kind == "mark" and t.text in _OPEN:
                stack.append(i)
        for i in stack:
            self.close[i] = len(self.t) - 1
        # Bodies of classes, and object literals: braces in which name(...) { is a method.
        self.holders = {i for i in self.close if self.t[i].text == "{" and i and self.text(i - 1) in {"=", "(", ",", "[", ":", "?", "return", "default", "&&", "||", "??"}}
        self.holders |= {b for b in (self.brace(i) for i, t in enumerate(self.t) if t == Token("name", "class", t.at, t.fresh)) if b is not None}

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def brace(self, i: int) -> int | None:
        """The first brace after i in the same brackets as i."""
        j = i + 1
        while j < len(self.t) and self.text(j) not in _CLOSE and self.text(j) != ";":
            if self.text(j) == "{":
                return j
            j = self.close.get(j, j) + 1
        return None

    def body(self, j: int) -> int | None:
        """The brace of the body after the type parameters or parameters at j, if there is one."""
        if self.text(j) == "<":
            deep = 0
            while j < len(self.t) and self.text(j) not in {";", "{", "}"}:
                deep += {"<": 1, ">": -1}.get(self.text(j), 0)
                j += 1
                if not deep:
                    break
        if self.text(j) != "(":
            return None
        j = self.close[j] + 1
        if self.text(j) == ":":
            j += 1
            if self.text(j) == "{":
                j = self.close[j] + 1
            while j < len(self.t) and self.text(j) not in {"{", ";", "=>", *_CLOSE}:
                j = self.close.get(j, j) + 1
        return j if self.text(j) == "{" else None

    def ends(self, j: int) -> bool:
        """Whether a statement without a semicolon ends before token j."""
        t, before = self.t[j], self.t[j - 1]
        if not t.fresh or t.kind == "mark" or t.text[0] == "`" or t.text in {"in", "of", "instanceof", "as", "satisfies"}:
            return False
        return _operand(before) or before.text in {">", "++", "--"}

    def declared(self, i: int) -> bool:
        """Whether a function or class at i is a statement, not part of an expression."""
        if self.text(i - 1) == "async":
            i -= 1
        return i <= 0 or self.text(i - 1) in {";", "}", "{", ")", "export", "default", "declare", "else", "do"} or self.ends(i)

    def variables(self, i: int) -> Iterator[tuple[str, int, int]]:
        """(name, first, last) of what const, let or var at i declares; patterns have no name, loops over members nothing."""
        j, found = i + 1, []
        while j < len(self.t) and (self.named(j) or self.text(j) in {"{", "["}):
            first, name, deep, given = j, self.text(j) if self.named(j) else None, 0, False
            j = self.close.get(j, j) + 1
            while j < len(self.t) and self.text(j) not in _CLOSE and self.text(j) != ";" and not self.ends(j):
                word = self.text(j)
                if word == "," and not deep:
                    break
                if not given:
                    if word in {"of", "in"} and self.named(j):
                        return
                    given = word == "="
                    deep = 0 if given else max(0, deep + {"<": 1, ">": -1}.get(word, 0))
                j = self.close.get(j, j) + 1
            if name:
                found.append((name, first, j - 1))
            if self.text(j) != ",":
                break
            j += 1
        yield from found

    def spans(self) -> Iterator[tuple[str, int, int]]:
        """(name, first, last) of every definition, as tokens."""
        for i, t in enumerate(self.t):
            before = self.text(i - 1)
            if t.kind not in ("name", "string") or before in {".", "?."}:
                continue
            if t.text == "function":
                j = i + 1 + (self.text(i + 1) == "*")
                end = self.body(j + 1) if self.named(j) and self.declared(i) else None
                if end is not None:
                    yield self.text(j), i - (before == "async"), self.close[end]
            elif t.text == "class":
                end = self.brace(i)
                if end is not None and self.named(i + 1) and self.text(i + 1) != "extends" and self.declared(i):
                    yield self.text(i + 1), i, self.close[end]
            elif t.text in ("const", "let", "var") and self.text(i + 1) != "enum":
                yield from self.variables(i)
            elif self.within[i] in self.holders and before not in {"new", "function"} and t.text not in _CONTROL and self.text(i + 1) in {"(", "<"}:
                end = self.body(i + 1)
                if end is not None:
                    yield t.text, i, self.close[end]


def definitions(text: str) -> Iterator[tuple[str, int, int, list[str]]]:
    """(dotted name, first line, last line, shingles) of functions, classes, methods and variables.

    Shingles are the distinct triples of consecutive tokens: words and marks as they are, names, strings and numbers with
    their kind and their first TOKEN_MOST characters.
    """
    seen = _Text(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at) + 1
    outer: list[tuple[int, str]] = []
    for name, first, last in sorted(set(seen.spans()), key=lambda s: (s[1], -s[2])):
        while outer and outer[-1][0] < first:
            outer.pop()
        dotted = f"{outer[-1][1]}.{name}" if outer else name
        outer.append((last, dotted))
        own = [t.text if t.kind == "mark" else f"{t.kind}={t.text[:TOKEN_MOST]}" for t in seen.t[first : last + 1]]
        end = seen.t[last]
        yield dotted, line(seen.t[first].at), line(end.at + len(end.text) - 1), sorted({"|".join(own[i : i + 3]) for i in range(len(own) - 2)} or set(own))
