"""What the recognisers of all languages share: token lists, bracket matching and the cursor."""

from __future__ import annotations

import re


class Broken(Exception):
    """The text breaks the grammar."""


PAIRS = {"(": ")", "[": "]", "{": "}"}
OPEN = frozenset("([{")
CLOSE = frozenset(")]}")
#: After one of these, an operand that stands alone is complete.
ENDS = frozenset([",", ")", "]", ";", "}"])


class Tokens:
    """Parallel lists: text, kind, start, and whether a line break precedes; a sentinel of kind "" ends them.

    Kinds: i identifier or keyword, n number, s string or other literal, p punctuation. `match` gives each bracket's partner.
    """

    __slots__ = ("text", "kind", "start", "line", "match")

    def __init__(self):
        self.text: list[str] = []
        self.kind: list[str] = []
        self.start: list[int] = []
        self.line: list[bool] = []
        self.match: dict[int, int] = {}

    def close(self, end: int) -> Tokens:
        stack = []
        for i, t in enumerate(self.text):
            if self.kind[i] == "p":
                if t in OPEN:
                    stack.append(i)
                elif t in CLOSE:
                    if not stack or PAIRS[self.text[stack[-1]]] != t:
                        raise Broken
                    j = stack.pop()
                    self.match[j], self.match[i] = i, j
        if stack:
            raise Broken
        for _ in range(4):
            self.text.append("")
            self.kind.append("")
            self.start.append(end)
            self.line.append(True)
        return self


def scan(pattern: re.Pattern, text: str, nested: bool = False) -> Tokens:
    """Tokens of a language whose lexing needs no context. Group w is what goes before a token, c opens a nested block comment, e is an error, z the end."""
    out = Tokens()
    add_t, add_k, add_s, add_l = out.text.append, out.kind.append, out.start.append, out.line.append
    fresh, pos, n = True, 0, len(text)
    match = pattern.match
    while pos < n:
        m = match(text, pos)
        if m is None:
            raise Broken
        kind, end = m.lastgroup, m.end()
        text_ = m[kind]
        start = end - len(text_)
        if start > pos and not fresh:
            fresh = text[pos] == "\n" if start == pos + 1 else "\n" in m["w"]
        if kind == "z":
            break
        if kind == "c":
            depth = 1
            for d in re.finditer(r"/\*|\*/", text[end:]):
                depth += 1 if d[0] == "/*" else -1
                if not depth:
                    fresh = fresh or "\n" in text[start : end + d.end()]
                    end += d.end()
                    break
            else:
                raise Broken
        elif kind == "e":
            raise Broken
        else:
            add_t(text_)
            add_k(kind)
            add_s(start)
            add_l(fresh)
            fresh = False
        pos = end
    return out.close(n)


class Cursor:
    """Recursive descent over Tokens. Methods return nothing of interest and raise Broken."""

    RESERVED: frozenset[str] = frozenset()

    def __init__(self, tokens: Tokens):
        self.T, self.K, self.S, self.L, self.M = tokens.text, tokens.kind, tokens.start, tokens.line, tokens.match
        self.p = 0

    def eat(self, t: str) -> bool:
        if self.T[self.p] == t and self.K[self.p] != "s":
            self.p += 1
            return True
        return False

    def need(self, t: str) -> None:
        if self.T[self.p] != t or self.K[self.p] == "s":
            raise Broken
        self.p += 1

    def name(self) -> None:
        if self.K[self.p] != "i" or self.T[self.p] in self.RESERVED:
            raise Broken
        self.p += 1

    def word(self) -> None:
        """Any identifier or keyword."""
        if self.K[self.p] != "i":
            raise Broken
        self.p += 1

    def attempt(self, *steps) -> bool:
        """Try the steps; on failure, stay where we were."""
        at = self.p
        try:
            for s in steps:
                s()
            return True
        except Broken:
            self.p = at
            return False

    def until(self, close: str, item, sep: str = ",", trailing: bool = True) -> None:
        """Items separated by `sep` up to and including `close`."""
        while not self.eat(close):
            item()
            if not self.eat(sep):
                self.need(close)
                return
            if not trailing and self.T[self.p] == close:
                raise Broken
