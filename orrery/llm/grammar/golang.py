"""Go 1.22."""

from __future__ import annotations

import re

from orrery.llm.grammar.base import ENDS, Broken, Cursor, Tokens, scan

_LEX = re.compile(
    r"""(?P<w>(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)*)(?:(?P<i>[^\W\d]\w*)
    |(?P<n>(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)i?(?!\w))
    |(?P<s>"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))')
    |(?P<p>\.\.\.|<<=|>>=|&\^=|&\^|<-|\+\+|--|&&|\|\||==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[+\-*/%&|^<>=!()\[\]{},;.:~])
    |(?P<z>\Z)|(?P<e>.))""",
    re.X,
)
RESERVED = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_BINARY = frozenset("+ - * / % & | ^ << >> &^ && || == != < <= > >=".split())
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_STOPS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def tokens(src: str) -> Tokens:
    """Tokens with the semicolons that line ends imply."""
    raw = scan(_LEX, src)
    out = Tokens()
    n = len(raw.text) - 4
    for i in range(n):
        if raw.line[i] and i and _ends(raw.text[i - 1], raw.kind[i - 1]):
            _semicolon(out, raw.start[i])
        out.text.append(raw.text[i])
        out.kind.append(raw.kind[i])
        out.start.append(raw.start[i])
        out.line.append(raw.line[i])
    if n and _ends(raw.text[n - 1], raw.kind[n - 1]):
        _semicolon(out, len(src))
    return out.close(len(src))


def _ends(t: str, k: str) -> bool:
    return k in ("n", "s") or t in _STOPS or k == "i" and t not in RESERVED


def _semicolon(out: Tokens, at: int) -> None:
    out.text.append(";")
    out.kind.append("p")
    out.start.append(at)
    out.line.append(False)


class File(Cursor):
    RESERVED = RESERVED

    def __init__(self, toks: Tokens):
        super().__init__(toks)
        self.level = 0  # below 0: in the head of a control clause, where a brace opens the block

    def program(self) -> None:
        self.need("package")
        self.name()
        self.need(";")
        while self.T[self.p] == "import":
            self.p += 1
            self.group(self.import_spec)
            self.need(";")
        while self.K[self.p]:
            t = self.T[self.p]
            if t == "func":
                self.p += 1
                if self.T[self.p] == "(":
                    self.params()
                self.name()
                if self.T[self.p] == "[":
                    self.type_params()
                self.signature()
                if self.T[self.p] == "{":
                    self.block()
            elif t in ("var", "const", "type"):
                self.declaration()
            else:
                raise Broken
            self.need(";")

    def group(self, item) -> None:
        self.first = True  # of its group
        if self.eat("("):
            while not self.eat(")"):
                item()
                self.first = False
                if not self.eat(";"):
                    self.need(")")
                    return
        else:
            item()

    def import_spec(self) -> None:
        if not self.eat(".") and self.K[self.p] == "i":
            self.name()
        if self.K[self.p] != "s":
            raise Broken
        self.p += 1

    def declaration(self) -> None:
        t = self.T[self.p]
        self.p += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[t])

    def names(self) -> None:
        self.name()
        while self.eat(","):
            self.name()

    def var_spec(self) -> None:
        self.names()
        if self.eat("="):
            return self.exprs()
        self.type()
        if self.eat("="):
            self.exprs()
        return None

    def const_spec(self) -> None:
        self.names()
        first = self.first
        typed = self.T[self.p] not in ("=", ";", ")")
        if typed:
            self.type()
        if self.eat("="):
            self.exprs()
        elif typed or first:
            raise Broken

    def type_spec(self) -> None:
        self.name()
        if self.T[self.p] == "[" and self.K[self.p + 1] == "i" and self.T[self.p + 2] != "]":
            self.type_params()
        self.eat("=")
        self.type()

    def type_params(self) -> None:
        self.need("[")
        while not self.eat("]"):
            self.names()
            self.constraint()
            if not self.eat(","):
                self.need("]")
                return

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def signature(self) -> None:
        self.params()
        if self.T[self.p] == "(":
            self.params()
        elif self.type_starts():
            self.type()

    def params(self) -> None:
        self.need("(")
        self.until(")", self.param)

    def param(self) -> None:
        if self.eat("..."):
            return self.type()
        self.type()
        if self.eat("..."):
            return self.type()
        if self.T[self.p] not in (",", ")"):
            self.type()
        return None

    def type_starts(self) -> bool:
        t, k = self.T[self.p], self.K[self.p]
        return k == "i" and (t not in RESERVED or t in ("func", "struct", "interface", "map", "chan")) or t in ("*", "[", "(", "<-") and k == "p"

    def type(self) -> None:
        t, k = self.T[self.p], self.K[self.p]
        self.p += 1
        if k == "i":
            if t == "func":
                self.signature()
            elif t == "struct":
                self.need("{")
                while not self.eat("}"):
                    self.field()
                    if not self.eat(";"):
                        self.need("}")
                        return
            elif t == "interface":
                self.need("{")
                while not self.eat("}"):
                    if self.K[self.p] == "i" and self.T[self.p + 1] == "(":
                        self.name()
                        self.signature()
                    else:
                        self.constraint()
                    if not self.eat(";"):
                        self.need("}")
                        return
            elif t == "map":
                self.need("[")
                self.type()
                self.need("]")
                self.type()
            elif t == "chan":
                self.eat("<-")
                self.type()
            elif t in RESERVED:
                raise Broken
            else:
                if self.eat("."):
                    self.name()
                if self.T[self.p] == "[" and self.T[self.p + 1] != "]":
                    at = self.p
                    if not self.attempt(lambda: self.need("["), lambda: self.until("]", self.type)):
                        self.p = at
        elif t == "*" and k == "p":
            self.type()
        elif t == "(" and k == "p":
            self.type()
            self.need(")")
        elif t == "<-":
            self.need("chan")
            self.type()
        elif t == "[" and k == "p":
            if not self.eat("]"):
                if not self.eat("..."):
                    level, self.level = self.level, 1
                    self.expr()
                    self.level = level
                self.need("]")
            self.type()
        else:
            raise Broken

    def field(self) -> None:
        if self.T[self.p] == "*" or self.K[self.p] == "i" and self.T[self.p + 1] in (";", "}", ".") or self.K[self.p + 1] == "s":
            self.eat("*")
            self.type()
        else:
            self.names()
            self.type()
        if self.K[self.p] == "s":
            self.p += 1

    # statements
    def block(self) -> None:
        self.need("{")
        level, self.level = self.level, 0
        self.statements()
        self.level = level
        self.need("}")

    def statements(self) -> None:
        while self.T[self.p] not in ("}", "case", "default") or self.K[self.p] == "s":
            if not self.K[self.p]:
                raise Broken
            self.statement()
            if not self.eat(";") and self.T[self.p] != "}":
                raise Broken

    def statement(self) -> None:
        t, k = self.T[self.p], self.K[self.p]
        if t == ";" and k == "p":
            return None
        if k == "i" and t in RESERVED:
            if t in ("var", "const", "type"):
                return self.declaration()
            if t in ("go", "defer"):
                self.p += 1
                return self.expr()
            if t == "return":
                self.p += 1
                if self.T[self.p] not in (";", "}"):
                    self.exprs()
                return None
            if t in ("break", "continue", "goto"):
                self.p += 1
                if self.K[self.p] == "i":
                    self.name()
                elif t == "goto":
                    raise Broken
                return None
            if t == "fallthrough":
                self.p += 1
                return None
            if t in ("if", "for", "switch", "select"):
                return getattr(self, t + "_")()
            if t not in ("func", "struct", "map", "chan", "interface"):
                raise Broken
        if t == "{" and k == "p":
            return self.block()
        if k == "i" and self.T[self.p + 1] == ":" and t not in RESERVED:
            self.p += 2
            if self.T[self.p] == "}":
                return None
            return self.statement()
        return self.simple()

    def simple(self, ranged: bool = False) -> None:
        if ranged and self.eat("range"):
            return self.expr()
        self.exprs()
        t = self.T[self.p]
        if self.K[self.p] != "p":
            return None
        if t in _ASSIGN:
            self.p += 1
            if ranged and self.eat("range"):
                return self.expr()
            return self.exprs()
        if t in ("++", "--"):
            self.p += 1
        elif t == "<-":
            self.p += 1
            self.expr()
        return None

    def if_(self) -> None:
        self.p += 1
        level, self.level = self.level, -1
        if self.T[self.p] != ";":
            self.simple()
        if self.eat(";"):
            self.simple()
        self.level = level
        self.block()
        if self.eat("else"):
            if self.T[self.p] == "if":
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.p += 1
        level, self.level = self.level, -1
        if self.T[self.p] != "{":
            if self.T[self.p] != ";":
                self.simple(True)
            if self.T[self.p] == ";":
                self.p += 1
                if self.T[self.p] != ";":
                    self.expr()
                self.need(";")
                if self.T[self.p] != "{":
                    self.simple()
        self.level = level
        self.block()

    def switch_(self) -> None:
        self.p += 1
        level, self.level = self.level, -1
        if self.T[self.p] != "{":
            if self.T[self.p] != ";":
                self.simple()
            if self.eat(";") and self.T[self.p] != "{":
                self.simple()
        self.level = level
        self.clauses(self.type_or_expr_list)

    def select_(self) -> None:
        self.p += 1
        self.clauses(self.simple)

    def clauses(self, head) -> None:
        self.need("{")
        level, self.level = self.level, 0
        while not self.eat("}"):
            if self.eat("case"):
                head()
            else:
                self.need("default")
            self.need(":")
            self.statements()
        self.level = level

    def type_or_expr_list(self) -> None:
        self.operand_or_type()
        while self.eat(","):
            self.operand_or_type()

    # expressions
    def exprs(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def operand_or_type(self) -> None:
        if self.T[self.p] in ("[", "map", "chan", "struct", "interface", "func", "*", "<-") and self.K[self.p] != "s":
            if self.attempt(self.expr):
                return
            return self.type()
        self.expr()

    def expr(self) -> None:
        p = self.p
        if self.T[p + 1] in ENDS and self.K[p + 1] == "p" and (self.K[p] in ("n", "s") or self.K[p] == "i" and self.T[p] not in RESERVED):
            self.p += 1
            return
        self.unary()
        while self.T[self.p] in _BINARY and self.K[self.p] == "p":
            self.p += 1
            self.unary()

    def unary(self) -> None:
        while self.T[self.p] in ("+", "-", "!", "^", "*", "&", "<-") and self.K[self.p] == "p":
            self.p += 1
        self.primary()

    def inside(self, f) -> None:
        level, self.level = self.level, 1
        f()
        self.level = level

    def primary(self) -> None:
        t, k = self.T[self.p], self.K[self.p]
        literal = False  # may a composite literal follow?
        if k in ("n", "s"):
            self.p += 1
        elif k == "i":
            if t == "func":
                self.p += 1
                self.signature()
                if self.T[self.p] == "{":
                    self.inside(self.block)
            elif t in ("struct", "map", "chan", "interface"):
                self.type()
                if self.T[self.p] == "{":
                    self.inside(self.composite)
                elif self.T[self.p] != "(":
                    if self.T[self.p] not in (",", ")"):
                        raise Broken
            elif t in RESERVED:
                raise Broken
            else:
                self.p += 1
                literal = True
        elif t == "(":
            self.p += 1
            self.inside(self.operand_or_type)
            self.need(")")
        elif t == "[":
            self.type()
            if self.T[self.p] == "{":
                self.inside(self.composite)
            elif self.T[self.p] not in ("(", ",", ")"):
                raise Broken
        else:
            raise Broken
        while self.K[self.p] == "p":
            t = self.T[self.p]
            if t == ".":
                self.p += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif t == "[":
                self.p += 1
                self.inside(self.index)
            elif t == "(":
                self.p += 1
                self.inside(self.call)
                literal = False
            elif t == "{" and literal and self.level >= 0:
                self.inside(self.composite)
                literal = False
            else:
                return

    def index(self) -> None:
        if self.T[self.p] != ":":
            self.operand_or_type()
            while self.eat(","):
                if self.T[self.p] == "]":
                    break
                self.operand_or_type()
        for _ in range(2):
            if self.eat(":") and self.T[self.p] not in (":", "]"):
                self.expr()
        self.need("]")

    def call(self) -> None:
        while not self.eat(")"):
            self.operand_or_type()
            self.eat("...")
            if not self.eat(","):
                self.need(")")
                return

    def composite(self) -> None:
        self.need("{")
        self.until("}", self.element)

    def element(self) -> None:
        self.value()
        if self.eat(":"):
            self.value()

    def value(self) -> None:
        if self.T[self.p] == "{" and self.K[self.p] == "p":
            self.composite()
        else:
            self.expr()


def recognise(src: str) -> None:
    """Raise Broken unless the text is a well-formed Go file."""
    File(tokens(src.removeprefix("\ufeff"))).program()
