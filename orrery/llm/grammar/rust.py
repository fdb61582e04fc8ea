"""Rust 2021."""

from __future__ import annotations

import re

from orrery.llm.grammar.base import ENDS, Broken, Cursor, Tokens, scan

_LEX = re.compile(
    r"""(?P<w>(?:\s+|//[^\n]*)*)(?:(?P<c>/\*)
    |(?P<s>b?r(?P<h>\#*)"[\s\S]*?"(?P=h)|[bc]?"(?:[^"\\]|\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|\r?\n))*"|b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')
    |(?P<l>'[^\W\d]\w*)
    |(?P<i>r\#[^\W\d]\w*|[^\W\d]\w*)
    |(?P<n>(?:0x_*[0-9a-fA-F][0-9a-fA-F_]*|0b_*[01][01_]*|0o_*[0-7][0-7_]*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?_*\d[\d_]*)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w))
    |(?P<p>\.\.\.|\.\.=|\.\.|->|=>|::|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<=|<<|[+\-*/%^!&|=<>@.,;:\#$?~(){}\[\]])
    |(?P<z>\Z)|(?P<e>.))""",
    re.X,
)
RESERVED = frozenset("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split())
_PATH_START = frozenset(["self", "Self", "super", "crate"])
_BINARY = frozenset("+ - * / % ^ & | && || << == != < <= as".split())
_ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<=".split())


def tokens(src: str) -> Tokens:
    out = scan(_LEX, src, True)
    for i, k in enumerate(out.kind):
        if k == "h":
            out.kind[i] = "s"
    return out


class Crate(Cursor):
    RESERVED = RESERVED

    def __init__(self, toks: Tokens):
        super().__init__(toks)
        self.bare = False  # in a condition, where a brace opens the block and not a struct

    def program(self) -> None:
        self.inner_attributes()
        while self.K[self.p]:
            self.item()

    # attributes, paths, generics
    def group(self) -> None:
        if self.T[self.p] not in ("(", "[", "{") or self.K[self.p] != "p":
            raise Broken
        self.p = self.M[self.p] + 1

    def inner_attributes(self) -> None:
        while self.T[self.p] == "#" and self.T[self.p + 1] == "!" and self.T[self.p + 2] == "[":
            self.p += 2
            self.group()

    def attributes(self) -> None:
        while self.T[self.p] == "#":
            self.p += 1
            self.eat("!")
            if self.T[self.p] != "[":
                raise Broken
            self.group()

    def visibility(self) -> None:
        if self.eat("crate") and not self.K[self.p]:
            raise Broken
        if self.eat("pub") and self.T[self.p] == "(" and self.T[self.p + 1] in ("crate", "self", "super", "in"):
            self.group()

    def segment(self) -> None:
        if self.K[self.p] != "i" or self.T[self.p] in RESERVED and self.T[self.p] not in _PATH_START:
            raise Broken
        self.p += 1

    def path(self, in_type: bool) -> None:
        if self.T[self.p] == "<" and self.K[self.p] == "p":
            self.p += 1
            self.type()
            if self.eat("as"):
                self.path(True)
            self.close_angle()
            if self.T[self.p] != "::":
                raise Broken
        else:
            self.eat("::")
            self.segment()
            if in_type:
                self.generic_args_here()
        while self.T[self.p] == "::" and self.K[self.p] == "p":
            if self.T[self.p + 1] in ("{", "*"):
                return
            self.p += 1
            if self.T[self.p] == "<":
                self.generic_args()
            else:
                self.segment()
                if in_type:
                    self.generic_args_here()

    def generic_args_here(self) -> None:
        if self.T[self.p] == "<" and self.K[self.p] == "p":
            self.generic_args()
        elif self.T[self.p] == "::" and self.T[self.p + 1] == "<":
            self.p += 1
            self.generic_args()
        elif self.T[self.p] == "(" and self.T[self.p - 1] in ("Fn", "FnMut", "FnOnce"):
            self.p += 1
            self.until(")", self.type)
            if self.eat("->"):
                self.type()

    def close_angle(self) -> None:
        self.need(">")

    def generic_args(self) -> None:
        self.need("<")
        while not self.eat(">"):
            self.generic_arg()
            if not self.eat(","):
                self.close_angle()
                return

    def generic_arg(self) -> None:
        if self.K[self.p] == "l":
            self.p += 1
        elif self.K[self.p] in ("n", "s") or self.T[self.p] in ("true", "false"):
            self.p += 1
        elif self.T[self.p] == "-" and self.K[self.p + 1] == "n":
            self.p += 2
        elif self.T[self.p] == "{":
            self.block()
        else:
            self.type()
            if self.eat("="):
                self.generic_arg()
            elif self.eat(":"):
                self.bounds()

    def generics(self) -> None:
        if self.T[self.p] != "<" or self.K[self.p] != "p":
            return
        self.p += 1
        while not self.eat(">"):
            self.attributes()
            if self.K[self.p] == "l":
                self.p += 1
                if self.eat(":"):
                    self.bounds()
            elif self.eat("const"):
                self.name()
                self.need(":")
                self.type()
                if self.eat("="):
                    self.generic_arg()
            else:
                self.name()
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.type()
            if not self.eat(","):
                self.close_angle()
                return

    def bounds(self) -> None:
        while True:
            if self.K[self.p] == "l":
                self.p += 1
            elif self.T[self.p] == "(":
                self.p += 1
                self.bounds()
                self.need(")")
            elif self.K[self.p] == "i" or self.T[self.p] in ("?", "<", "::", "~"):
                if self.eat("~"):
                    self.eat("const")
                self.eat("?")
                if self.eat("for"):
                    self.generics()
                self.path(True)
            else:
                return
            if not self.eat("+"):
                return

    def where(self) -> None:
        if not self.eat("where"):
            return
        while self.T[self.p] not in ("{", ";", "="):
            if self.K[self.p] == "l":
                self.p += 1
            else:
                if self.eat("for"):
                    self.generics()
                self.type()
            self.need(":")
            self.bounds()
            if not self.eat(","):
                return

    # types
    def type(self) -> None:
        p = self.p
        t, k = self.T[p], self.K[p]
        if k == "p":
            if t == "(":
                self.p += 1
                return self.until(")", self.type)
            if t == "!":
                self.p += 1
                return None
            if t in ("&", "&&"):
                self.p += 1
                if self.K[self.p] == "l":
                    self.p += 1
                self.eat("mut")
                return self.type()
            if t == "*":
                self.p += 1
                if not (self.eat("const") or self.eat("mut")):
                    raise Broken
                return self.type()
            if t == "[":
                self.p += 1
                self.type()
                if self.eat(";"):
                    self.expr()
                return self.need("]")
            if t not in ("<", "::"):
                raise Broken
        elif k == "i":
            if t in ("impl", "dyn"):
                self.p += 1
                return self.bounds()
            if t == "for":
                self.p += 1
                self.generics()
                return self.type()
            if t == "_":
                self.p += 1
                return None
            if t in ("unsafe", "extern", "fn"):
                self.eat("unsafe")
                if self.eat("extern") and self.K[self.p] == "s":
                    self.p += 1
                self.need("fn")
                self.need("(")
                self.until(")", self.fn_type_param)
                if self.eat("->"):
                    self.type()
                return None
        else:
            raise Broken
        self.path(True)
        if self.T[self.p] == "!" and self.T[self.p + 1] in ("(", "[", "{"):
            self.p += 1
            self.group()
        return None

    def fn_type_param(self) -> None:
        self.attributes()
        if self.eat("..."):
            return
        if self.K[self.p] == "i" and self.T[self.p + 1] == ":":
            self.p += 2
        self.type()

    # items
    def item(self) -> None:
        self.attributes()
        if not self.item_body():
            raise Broken

    def item_body(self) -> bool:
        """An item at the cursor, if one starts here."""
        start = self.p
        self.visibility()
        t = self.T[self.p]
        if self.K[self.p] != "i":
            if self.p != start:
                raise Broken
            return False
        f = _ITEMS.get(t)
        if f is None:
            if t == "macro_rules" and self.T[self.p + 1] == "!":
                self.p += 2
                self.name()
                return self.macro_group()
            if t == "union" and self.K[self.p + 1] == "i":
                self.p += 1
                self.struct_rest()
                return True
            if t not in RESERVED | _PATH_START or t in _PATH_START:
                at = self.p
                if self.attempt(lambda: self.path(False)) and self.T[self.p] == "!" and self.T[self.p + 1] in ("(", "[", "{"):
                    self.p += 1
                    return self.macro_group()
                self.p = at
            if self.p != start:
                raise Broken
            return False
        if t in ("const", "static") and self.T[self.p + 1] in ("{", "|", "||", "move", "async") and t == "const":
            return False
        if t == "unsafe" and self.T[self.p + 1] == "{" or t == "async" and self.T[self.p + 1] in ("{", "move", "|", "||"):
            return False
        f(self)
        return True

    def macro_group(self) -> bool:
        brace = self.T[self.p] == "{"
        self.group()
        if not brace:
            self.need(";")
        return True

    def i_fn(self) -> None:
        while self.T[self.p] in ("const", "async", "unsafe", "extern"):
            if self.T[self.p] == "unsafe" and self.T[self.p + 1] in ("impl", "trait"):
                self.p += 1
                return _ITEMS[self.T[self.p]](self)
            if self.T[self.p] == "extern":
                self.p += 1
                if self.eat("crate"):
                    self.segment()
                    if self.eat("as"):
                        self.name()
                    return self.need(";")
                if self.K[self.p] == "s":
                    self.p += 1
                if self.T[self.p] == "{":
                    self.p += 1
                    self.inner_attributes()
                    while not self.eat("}"):
                        self.item()
                    return None
            elif self.T[self.p] == "const" and self.T[self.p + 1] not in ("fn", "unsafe", "async", "extern"):
                return self.i_const()
            else:
                self.p += 1
        self.need("fn")
        self.name()
        self.generics()
        self.need("(")
        self.until(")", self.fn_param)
        if self.eat("->"):
            self.type()
        self.where()
        if not self.eat(";"):
            self.block()
        return None

    def fn_param(self) -> None:
        self.attributes()
        if self.eat("..."):
            return None
        at = self.p
        if self.eat("&") and self.K[self.p] == "l":
            self.p += 1
        self.eat("mut")
        if self.T[self.p] == "self" and self.T[self.p + 1] in (",", ")", ":"):
            self.p += 1
            if self.eat(":"):
                self.type()
            return None
        self.p = at
        self.pattern()
        self.need(":")
        return self.type()

    def i_struct(self) -> None:
        self.p += 1
        self.struct_rest()

    def struct_rest(self) -> None:
        self.name()
        self.generics()
        self.where()
        if self.eat("{"):
            self.until("}", self.field)
        elif self.eat("("):
            self.until(")", self.tuple_field)
            self.where()
            self.need(";")
        else:
            self.need(";")

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.need(":")
        self.type()

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def i_enum(self) -> None:
        self.p += 1
        self.name()
        self.generics()
        self.where()
        self.need("{")
        self.until("}", self.variant)

    def variant(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        if self.eat("{"):
            self.until("}", self.field)
        elif self.eat("("):
            self.until(")", self.tuple_field)
        if self.eat("="):
            self.expr()

    def i_impl(self) -> None:
        self.p += 1
        if self.T[self.p] == "<":
            self.generics()
        self.eat("const")
        self.eat("!")
        self.type()
        if self.eat("for"):
            self.type()
        self.where()
        self.associated()

    def i_trait(self) -> None:
        self.p += 1
        self.name()
        self.generics()
        if self.eat(":"):
            self.bounds()
        self.where()
        self.associated()

    def associated(self) -> None:
        self.need("{")
        self.inner_attributes()
        while not self.eat("}"):
            self.attributes()
            self.eat("default")
            self.item()

    def i_mod(self) -> None:
        self.p += 1
        self.name()
        if self.eat(";"):
            return
        self.need("{")
        self.inner_attributes()
        while not self.eat("}"):
            self.item()

    def i_use(self) -> None:
        self.p += 1
        self.use_tree()
        self.need(";")

    def use_tree(self) -> None:
        self.eat("::")
        if self.eat("{"):
            return self.until("}", self.use_tree)
        if self.eat("*"):
            return None
        self.segment()
        if self.eat("::"):
            return self.use_tree()
        if self.eat("as"):
            self.segment_or_blank()
        return None

    def segment_or_blank(self) -> None:
        if not self.eat("_"):
            self.name()

    def i_const(self) -> None:
        self.p += 1
        self.eat("mut")
        self.segment_or_blank()
        self.generics()
        self.need(":")
        self.type()
        if self.eat("="):
            self.expr()
        self.need(";")

    def i_type(self) -> None:
        self.p += 1
        self.name()
        self.generics()
        if self.eat(":"):
            self.bounds()
        self.where()
        if self.eat("="):
            self.type()
        self.where()
        self.need(";")

    # patterns
    def pattern(self) -> None:
        self.eat("|")
        self.one_pattern()
        while self.eat("|"):
            self.one_pattern()

    def one_pattern(self) -> None:
        t, k = self.T[self.p], self.K[self.p]
        if k == "p":
            if t in ("&", "&&"):
                self.p += 1
                self.eat("mut")
                return self.one_pattern()
            if t == "(":
                self.p += 1
                return self.until(")", self.pattern)
            if t == "[":
                self.p += 1
                return self.until("]", self.pattern)
            if t == ".." or t == "..=":
                self.p += 1
                if self.K[self.p] in ("n", "s") or self.T[self.p] == "-" or self.K[self.p] == "i" and t == "..=":
                    self.literal_or_path()
                return None
            if t not in ("-", "<", "::"):
                raise Broken
        elif k == "i":
            if t == "_":
                self.p += 1
                return None
            if t in ("ref", "mut"):
                self.eat("ref")
                self.eat("mut")
                self.name()
                if self.eat("@"):
                    self.one_pattern()
                return None
            if t == "box":
                self.p += 1
                return self.one_pattern()
            if t not in RESERVED and self.T[self.p + 1] == "@":
                self.p += 2
                return self.one_pattern()
        elif k not in ("n", "s"):
            raise Broken
        self.literal_or_path()
        t = self.T[self.p]
        if self.K[self.p] != "p":
            return None
        if t == "(":
            self.p += 1
            return self.until(")", self.pattern)
        if t == "{" and k == "i":
            self.p += 1
            return self.until("}", self.field_pattern)
        if t == "!" and self.T[self.p + 1] in ("(", "[", "{"):
            self.p += 1
            return self.group()
        if t in ("..=", "..", "..."):
            self.p += 1
            if self.K[self.p] in ("n", "s", "i") and self.T[self.p] not in ("if",) or self.T[self.p] == "-":
                self.literal_or_path()
        return None

    def literal_or_path(self) -> None:
        if self.eat("-"):
            if self.K[self.p] != "n":
                raise Broken
            self.p += 1
        elif self.K[self.p] in ("n", "s") or self.T[self.p] in ("true", "false"):
            self.p += 1
        else:
            self.path(False)

    def field_pattern(self) -> None:
        self.attributes()
        if self.eat(".."):
            return None
        if self.K[self.p] in ("i", "n") and self.T[self.p + 1] == ":":
            self.p += 2
            return self.pattern()
        self.eat("ref")
        self.eat("mut")
        return self.name()

    # statements and expressions
    def block(self) -> None:
        self.need("{")
        bare, self.bare = self.bare, False
        self.inner_attributes()
        while not self.eat("}"):
            self.statement()
        self.bare = bare

    def statement(self) -> None:
        if self.eat(";"):
            return None
        self.attributes()
        t, k = self.T[self.p], self.K[self.p]
        if t == "let" and k == "i":
            self.p += 1
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expr()
                if self.eat("else"):
                    self.block()
            return self.need(";")
        if k == "i" and (t in _ITEMS or t == "pub" or t in ("macro_rules", "union")):
            if self.item_body():
                return None
        start = self.p
        if self.block_like() and self.T[self.p] not in (".", "?"):
            self.eat(";")
            return None
        self.p = start
        macro = k == "i" and (self.T[self.p + 1] == "!" or self.T[self.p + 1] == "::")
        self.expr()
        if self.eat(";") or self.T[self.p] == "}" and self.K[self.p] == "p":
            return None
        if macro and self.T[self.p - 1] == "}":
            return None
        raise Broken

    def block_like(self) -> bool:
        """An expression that ends in a block and needs no semicolon as a statement."""
        t, k = self.T[self.p], self.K[self.p]
        if k == "l" and self.T[self.p + 1] == ":":
            self.p += 2
            t, k = self.T[self.p], self.K[self.p]
        if k == "p" and t == "{" or k == "i" and (t in ("if", "match", "while", "for", "loop") or t in ("unsafe", "async", "const") and self.T[self.p + 1] in ("{", "move")):
            self.primary()
            return True
        return False

    def condition(self) -> None:
        bare, self.bare = self.bare, True
        self.expr()
        self.bare = bare

    def expr(self) -> None:
        p = self.p
        if self.T[p + 1] in ENDS and self.K[p + 1] == "p" and (self.K[p] in ("n", "s") or self.K[p] == "i" and self.T[p] not in RESERVED):
            self.p += 1
            return None
        if self.T[p] in ("..", "..=") and self.K[p] == "p":
            self.p += 1
            if self.operand_starts():
                self.binary()
        else:
            self.binary()
            if self.T[self.p] in ("..", "..=") and self.K[self.p] == "p":
                self.p += 1
                if self.operand_starts():
                    self.binary()
        t = self.T[self.p]
        if self.K[self.p] == "p":
            if t in _ASSIGN:
                self.p += 1
                return self.expr()
            if t == ">" and self.S[self.p + 1] == self.S[self.p] + 1:
                q = self.p
                while self.T[q] == ">" and self.S[q + 1] == self.S[q] + 1:
                    q += 1
                if self.T[q] == "=" and q - self.p == 2:
                    self.p = q + 1
                    return self.expr()
        return None

    def operand_starts(self) -> bool:
        t, k = self.T[self.p], self.K[self.p]
        if k in ("n", "s", "l"):
            return True
        if k == "i":
            return t not in ("else", "in", "as", "where")
        return t in ("(", "[", "-", "!", "*", "&", "&&", "|", "||", "<", "::") or t == "{" and not self.bare

    def binary(self) -> None:
        self.unary()
        while True:
            t, k = self.T[self.p], self.K[self.p]
            if k == "i":
                if t != "as":
                    return
                self.p += 1
                self.type()
            elif k == "p" and t in _BINARY:
                self.p += 1
                self.unary()
            elif k == "p" and t == ">":
                q = self.p
                if self.T[q + 1] == ">" and self.S[q + 1] == self.S[q] + 1:
                    q += 1
                    if self.T[q + 1] in ("=", "==") and self.S[q + 1] == self.S[q] + 1:
                        return
                elif self.T[q + 1] == "=" and self.S[q + 1] == self.S[q] + 1:
                    q += 1
                self.p = q + 1
                self.unary()
            else:
                return

    def unary(self) -> None:
        t, k = self.T[self.p], self.K[self.p]
        if k == "p":
            if t in ("-", "!", "*"):
                self.p += 1
                return self.unary()
            if t in ("&", "&&"):
                self.p += 1
                if self.T[self.p] == "raw" and self.T[self.p + 1] in ("const", "mut"):
                    self.p += 2
                else:
                    self.eat("mut")
                return self.unary()
        elif k == "i" and t == "let":
            self.p += 1
            self.pattern()
            self.need("=")
            return self.unary_scrutinee()
        self.postfix()
        return None

    def unary_scrutinee(self) -> None:
        self.unary()
        while self.T[self.p] in ("+", "-", "*", "/", "%", "^", "&", "|", "<<", "==", "!=", "<", "<=", "..", "..=") and self.K[self.p] == "p":
            self.p += 1
            if self.operand_starts():
                self.unary()

    def inside(self, f) -> None:
        bare, self.bare = self.bare, False
        f()
        self.bare = bare

    def args(self) -> None:
        self.until(")", self.expr)

    def postfix(self) -> None:
        self.primary()
        while self.K[self.p] == "p":
            t = self.T[self.p]
            if t == "?":
                self.p += 1
            elif t == "(":
                self.p += 1
                self.inside(self.args)
            elif t == "[":
                self.p += 1
                self.inside(self.expr)
                self.need("]")
            elif t == ".":
                self.p += 1
                if self.K[self.p] == "n":
                    self.p += 1
                elif self.eat("await"):
                    pass
                else:
                    self.segment()
                    if self.T[self.p] == "::":
                        self.p += 1
                        self.generic_args()
            else:
                return

    def primary(self) -> None:
        p = self.p
        t, k = self.T[p], self.K[p]
        if k in ("n", "s"):
            self.p += 1
            return None
        if k == "l":
            self.p += 1
            self.need(":")
            if self.T[self.p] not in ("loop", "while", "for", "{"):
                raise Broken
            return self.primary()
        if k == "p":
            if t == "(":
                self.p += 1
                return self.inside(self.args)
            if t == "[":
                self.p += 1
                return self.inside(self.array)
            if t == "{":
                return self.block()
            if t in ("|", "||"):
                return self.closure()
            if t not in ("<", "::"):
                raise Broken
            return self.path_expr()
        if k != "i":
            raise Broken
        if t not in RESERVED or t in _PATH_START:
            return self.path_expr()
        self.p += 1
        if t in ("true", "false"):
            return None
        if t == "if":
            self.condition()
            self.block()
            if self.eat("else"):
                if self.T[self.p] == "if":
                    return self.primary()
                return self.block()
            return None
        if t == "match":
            self.condition()
            return self.inside(self.arms)
        if t == "while":
            self.condition()
            return self.block()
        if t == "for":
            self.pattern()
            self.need("in")
            self.condition()
            return self.block()
        if t == "loop":
            return self.block()
        if t == "unsafe" or t == "const":
            return self.block()
        if t == "async":
            self.eat("move")
            if self.T[self.p] in ("|", "||"):
                return self.closure()
            return self.block()
        if t == "move" or t == "static":
            self.eat("move")
            return self.closure()
        if t in ("return", "break"):
            if t == "break" and self.K[self.p] == "l":
                self.p += 1
            if self.operand_starts() or self.T[self.p] == "{" and not self.bare:
                self.expr()
            return None
        if t == "continue":
            if self.K[self.p] == "l":
                self.p += 1
            return None
        raise Broken

    def array(self) -> None:
        if self.eat("]"):
            return
        self.expr()
        if self.eat(";"):
            self.expr()
            self.need("]")
            return
        if self.eat(","):
            self.until("]", self.expr)
        else:
            self.need("]")

    def closure(self) -> None:
        if not self.eat("||"):
            self.need("|")
            while not self.eat("|"):
                self.attributes()
                self.one_pattern()
                if self.eat(":"):
                    self.type()
                if not self.eat(","):
                    self.need("|")
                    break
        if self.eat("->"):
            self.type()
            return self.block()
        return self.expr()

    def arms(self) -> None:
        self.need("{")
        self.inner_attributes()
        while not self.eat("}"):
            self.attributes()
            self.pattern()
            if self.eat("if"):
                self.expr()
            self.need("=>")
            brace = self.T[self.p] == "{" and self.K[self.p] == "p"
            if brace:
                at = self.p
                self.block()
                if self.T[self.p] in (".", "?"):
                    self.p = at
                    self.expr()
                    brace = False
            else:
                self.expr()
            if not self.eat(",") and not (brace or self.T[self.p] == "}"):
                raise Broken

    def path_expr(self) -> None:
        self.path(False)
        t = self.T[self.p]
        if self.K[self.p] != "p":
            return
        if t == "!" and self.T[self.p + 1] in ("(", "[", "{") and self.K[self.p + 1] == "p":
            self.p += 1
            self.group()
        elif t == "{" and not self.bare and self.struct_follows():
            self.p += 1
            self.inside(self.struct_fields)

    def struct_follows(self) -> bool:
        n, k, nn = self.T[self.p + 1], self.K[self.p + 1], self.T[self.p + 2]
        return n == "}" or n in ("..", "#") or k in ("i", "n") and nn in (":", ",", "}")

    def struct_fields(self) -> None:
        while not self.eat("}"):
            self.attributes()
            if self.eat(".."):
                if not self.eat("}"):
                    self.expr()
                    self.need("}")
                return
            if self.K[self.p] not in ("i", "n"):
                raise Broken
            self.p += 1
            if self.eat(":"):
                self.expr()
            if not self.eat(","):
                self.need("}")
                return


_ITEMS = {
    "fn": Crate.i_fn, "async": Crate.i_fn, "unsafe": Crate.i_fn, "extern": Crate.i_fn, "const": Crate.i_fn,
    "struct": Crate.i_struct, "enum": Crate.i_enum, "impl": Crate.i_impl, "trait": Crate.i_trait, "mod": Crate.i_mod,
    "use": Crate.i_use, "static": Crate.i_const, "type": Crate.i_type,
}


def recognise(src: str) -> None:
    """Raise Broken unless the text is a well-formed crate file; an empty one is."""
    src = src.removeprefix("\ufeff")
    if src.startswith("#!") and not src.startswith("#!["):
        src = src[len(src.split("\n", 1)[0]) :]
    Crate(tokens(src)).program()
