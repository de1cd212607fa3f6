"""Definitions of Python sources, also of those that do not parse as a whole.

A file with one error has definitions all the same. Lines are read with a stack of open definitions: one is closed by the
next line of code that is not indented deeper. Each definition is then parsed on its own, so only those that hold an error
themselves are described by their tokens instead of their tree.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

#: Longest part of a name or literal that goes into a description.
TOKEN_MOST = 32
HEAD = re.compile(r"(?:async[ \t]+)?(?:def|class)[ \t]+([^\W\d]\w*)")
#: What a line is made of, as far as it matters where code is: strings, comments, brackets, names, numbers, other signs.
PART = re.compile(r"""(?P<triple>'{3}|\"{3})|(?P<string>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")|(?P<comment>\#.*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>\w+)|(?P<sign>[^\s\w])""")

Definition = tuple[str, int, int, list[str]]


def described(kinds: list[str]) -> list[str]:
    """The distinct triples of a sequence; of fewer than three the elements themselves."""
    return sorted({"|".join(kinds[i : i + 3]) for i in range(len(kinds) - 2)} or set(kinds))


def parts(node: ast.AST) -> Iterator[str]:
    """What a tree consists of, from its root on: kinds of nodes, and the names and values in them."""
    yield type(node).__name__
    for field, value in ast.iter_fields(node):
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, ast.AST):
                if not isinstance(v, ast.expr_context):
                    yield from parts(v)
            elif v is not None or field == "value":
                yield f"{field}={str(v)[:TOKEN_MOST]}"


def parsed(node: ast.AST, outer: str = "") -> Iterator[Definition]:
    """(dotted name, first line, last line, description) of every definition in a tree."""
    for child in ast.iter_child_nodes(node):
        inner = outer
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = f"{outer}.{child.name}" if outer else child.name
            yield inner, child.lineno, child.end_lineno, described(list(parts(child)))
        yield from parsed(child, inner)


def _lines(text: str) -> Iterator[tuple[int, int, re.Match | None, list[str]]]:
    """(number, indentation, head of a definition, tokens) of each line on which code begins, and indentation -1 for one that
    only goes on with a string, a bracket or a line before it."""
    quote, depth, goes_on = "", 0, False
    for number, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        bare = line.lstrip(" \t\f")
        head = HEAD.match(bare) if not quote else None
        if head:
            depth, goes_on = 0, False  # no definition begins in a bracket, so one that is open was never closed
        begins = not quote and not depth and not goes_on and bare and not bare.startswith("#")
        at, tokens, inside = 0, [], bool(quote)
        while at < len(line):
            if quote:
                end = line.find(quote, at)
                if end < 0:
                    break
                at, quote = end + 3, ""
                continue
            m = PART.search(line, at)
            if not m:
                break
            at = m.end()
            kind = m.lastgroup
            if kind == "comment":
                break
            tokens.append(m[0][:TOKEN_MOST])
            if kind == "triple":
                quote = m[0]
            depth += (kind == "open") - (kind == "close" and depth > 0)
        goes_on = not quote and line.endswith("\\")
        if begins:
            yield number, len(line.expandtabs(8)) - len(bare.expandtabs(8)), head, tokens
        elif inside or tokens:
            yield number, -1, None, tokens


def recovered(text: str) -> Iterator[Definition]:
    """(dotted name, first line, last line, description) of the definitions of a source that does not parse."""
    lines = text.split("\n")
    stack: list[list] = []  # indentation, dotted name, first line, last line, tokens, line of the first decorator
    done: list[list] = []
    decorated = 0
    for number, indent, head, tokens in _lines(text):
        if indent >= 0:
            while stack and indent <= stack[-1][0]:
                done.append(stack.pop())
            if head:
                name = f"{stack[-1][1]}.{head[1]}" if stack else head[1]
                stack.append([indent, name, number, number, [], decorated or number])
            decorated = (decorated or number) if tokens[:1] == ["@"] else 0
        for one in stack:
            one[3] = number
            one[4] += tokens
    for indent, name, first, last, tokens, begin in sorted(done + stack, key=lambda d: d[2]):
        try:  # below a line of its own, as it may be indented
            (holder,) = ast.parse("\n".join(["if 1:"] * bool(indent) + lines[begin - 1 : last])).body
            (node,) = holder.body if indent else (holder,)
            description = described(list(parts(node)))
        except (SyntaxError, ValueError, RecursionError):
            description = described(tokens)
        yield name, first, last, description


def definitions(text: str) -> list[Definition]:
    try:
        return list(parsed(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError):
        return list(recovered(text))
