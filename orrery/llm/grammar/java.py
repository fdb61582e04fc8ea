"""Java 21."""

from __future__ import annotations

import re

from orrery.llm.grammar.base import ENDS, Broken, Cursor, Tokens, scan

_LEX = re.compile(
    r'''(?P<w>(?:\s+|//[^\n\r]*|/\*[\s\S]*?\*/|\x1a)*)(?:(?P<i>[^\W\d]\w*|\$[\w$]*)
    |(?P<n>(?:0[xX](?:_*[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB](?:_*[01])+[lL]?|(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d+)?[lLfFdD]?)(?!\w))
    |(?P<s>"""[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?"""|"(?!"")(?:[^"\\\n\r]|\\(?:[btnfrs"'\\]|u+[0-9a-fA-F]{4}|[0-7]{1,3}))*"|""|'(?:[^'\\\n\r]|\\(?:[btnfrs"'\\]|u+[0-9a-fA-F]{4}|[0-7]{1,3}))')
    |(?P<p>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<=|<<|[+\-*/%&|^<>=!~?:;,.@(){}\[\]])
    |(?P<z>\Z)|(?P<e>.))''',
    re.X,
)
RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
_PRIMITIVE = frozenset("boolean byte char double float int long short".split())
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
_BINARY = frozenset("+ - * / % & | ^ << && || == != < <= >= instanceof".split())
_ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<=".split())


class Unit(Cursor):
    RESERVED = RESERVED

    def program(self) -> None:
        if self.T[self.p] == "@":
            self.attempt(self.annotations, self.package)
        elif self.T[self.p] == "package":
            self.package()
        while True:
            if self.eat("import"):
                self.eat("static")
                self.name()
                while self.eat("."):
                    if self.eat("*"):
                        break
                    self.name()
                self.need(";")
            elif not self.eat(";"):
                break
        if self.T[self.p] in ("module", "open") and self.K[self.p + 1] == "i":
            return self.module()
        while self.K[self.p]:
            if not self.eat(";"):
                self.modifiers()
                if not self.type_declaration():
                    raise Broken
        return None

    def module(self) -> None:
        self.eat("open")
        self.need("module")
        self.qualified()
        self.need("{")
        self.p = self.M[self.p - 1] + 1
        if self.K[self.p]:
            raise Broken

    def package(self) -> None:
        self.need("package")
        self.qualified()
        self.need(";")

    def qualified(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def annotations(self) -> None:
        while self.T[self.p] == "@" and self.T[self.p + 1] != "interface":
            self.p += 1
            self.qualified()
            if self.eat("("):
                self.until(")", self.annotation_value)

    def annotation_value(self) -> None:
        if self.K[self.p] == "i" and self.T[self.p + 1] == "=":
            self.p += 2
        self.element_value()

    def element_value(self) -> None:
        if self.T[self.p] == "@":
            self.annotations()
        elif self.eat("{"):
            self.until("}", self.element_value)
        else:
            self.conditional()

    def modifiers(self) -> None:
        while True:
            if self.T[self.p] == "@" and self.T[self.p + 1] != "interface":
                self.annotations()
            elif self.T[self.p] in _MODIFIERS and self.K[self.p] == "i" and not (self.T[self.p] in ("default",) and self.T[self.p + 1] in (":", "->")):
                self.p += 1
            elif self.T[self.p] == "non" and self.T[self.p + 1] == "-" and self.T[self.p + 2] == "sealed":
                self.p += 3
            else:
                return

    def type_declaration(self) -> bool:
        t = self.T[self.p]
        if t == "class":
            self.p += 1
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.type()
            self.clause("implements")
            self.clause("permits")
            self.class_body()
        elif t == "interface":
            self.p += 1
            self.name()
            self.type_params()
            self.clause("extends")
            self.clause("permits")
            self.class_body()
        elif t == "@" and self.T[self.p + 1] == "interface":
            self.p += 2
            self.name()
            self.class_body()
        elif t == "enum":
            self.p += 1
            self.name()
            self.clause("implements")
            self.need("{")
            while self.K[self.p] == "i" or self.T[self.p] == "@":
                self.annotations()
                self.name()
                if self.T[self.p] == "(":
                    self.arguments()
                if self.T[self.p] == "{":
                    self.class_body()
                if not self.eat(","):
                    break
            if self.eat(";"):
                while not self.eat("}"):
                    self.member()
            else:
                self.eat(",")
                self.need("}")
        elif t == "record" and self.K[self.p + 1] == "i" and self.T[self.p + 2] in ("(", "<"):
            self.p += 1
            self.name()
            self.type_params()
            self.params()
            self.clause("implements")
            self.class_body()
        else:
            return False
        return True

    def clause(self, word: str) -> None:
        if self.T[self.p] == word and self.K[self.p] == "i":
            self.p += 1
            self.type()
            while self.eat(","):
                self.type()

    def class_body(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return None
        if self.T[self.p] == "{" or self.T[self.p] == "static" and self.T[self.p + 1] == "{":
            self.eat("static")
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return None
        self.type_params()
        self.annotations()
        if self.K[self.p] == "i" and self.T[self.p + 1] == "(" and self.T[self.p] not in RESERVED:  # constructor
            self.p += 1
            self.params()
            self.throws()
            return self.block()
        if self.K[self.p] == "i" and self.T[self.p + 1] == "{" and self.T[self.p] not in RESERVED:  # compact constructor
            self.p += 1
            return self.block()
        if not self.eat("void"):
            self.type()
        self.name()
        if self.T[self.p] == "(":
            self.params()
            self.dims()
            self.throws()
            if self.eat("default"):
                self.element_value()
            if self.T[self.p] == "{":
                return self.block()
            return self.need(";")
        self.rest_of_variables()
        return self.need(";")

    def throws(self) -> None:
        self.clause("throws")

    def dims(self) -> None:
        while self.T[self.p] == "[" and self.T[self.p + 1] == "]":
            self.p += 2

    def rest_of_variables(self) -> None:
        while True:
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.eat("{"):
            self.until("}", self.initializer)
        else:
            self.expr()

    def params(self) -> None:
        self.need("(")
        self.until(")", self.param, trailing=False)

    def param(self) -> None:
        self.modifiers()
        self.type()
        self.annotations()
        self.eat("...")
        if self.T[self.p] == "this":
            self.p += 1
            return
        self.name()
        self.dims()

    # types
    def type_params(self) -> None:
        if self.T[self.p] == "<" and self.K[self.p] == "p":
            self.p += 1
            self.until(">", self.type_param, trailing=False)

    def type_param(self) -> None:
        self.annotations()
        self.name()
        if self.eat("extends"):
            self.type()
            while self.eat("&"):
                self.type()

    def type(self) -> None:
        self.annotations()
        if self.T[self.p] in _PRIMITIVE and self.K[self.p] == "i":
            self.p += 1
        else:
            self.name()
            self.type_args()
            while self.T[self.p] == "." and (self.K[self.p + 1] == "i" and self.T[self.p + 1] not in RESERVED or self.T[self.p + 1] == "@"):
                self.p += 1
                self.annotations()
                self.name()
                self.type_args()
        self.annotations()
        self.dims()

    def type_args(self) -> None:
        if self.T[self.p] == "<" and self.K[self.p] == "p":
            self.p += 1
            if self.eat(">"):
                return
            self.until(">", self.type_arg, trailing=False)

    def type_arg(self) -> None:
        self.annotations()
        if self.eat("?"):
            if self.eat("extends") or self.eat("super"):
                self.type()
            return
        self.type()

    # statements
    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def statement(self) -> None:
        t, k = self.T[self.p], self.K[self.p]
        if k == "p":
            if t == "{":
                return self.block()
            if t == ";":
                self.p += 1
                return None
            if t == "@":
                self.modifiers()
                if self.type_declaration():
                    return None
                self.type()
                self.name()
                self.rest_of_variables()
                return self.need(";")
        elif k == "i":
            f = getattr(self, "s_" + t, None) if t in _HEADS else None
            if f is not None:
                return f()
            nt = self.T[self.p + 1]
            if nt == ":" and t not in RESERVED:
                self.p += 2
                return self.statement()
            if t == "yield" and nt not in ("=", ".", "(", "++", "--", "["):
                self.p += 1
                self.expr()
                return self.need(";")
            if t in ("final", "abstract", "static", "class", "interface", "enum", "strictfp", "sealed") or t == "record" and self.K[self.p + 1] == "i":
                self.modifiers()
                if self.type_declaration():
                    return None
                self.type()
                self.name()
                self.rest_of_variables()
                return self.need(";")
            if t not in RESERVED or t in _PRIMITIVE:
                if self.K[self.p + 1] == "i" and nt != "instanceof" or nt in ("<", "[", ".") or t in _PRIMITIVE:
                    at = self.p
                    if self.attempt(self.type, self.name):
                        if self.T[self.p] in ("=", ";", ",", "[", ":"):
                            self.rest_of_variables()
                            return self.need(";")
                        raise Broken
                    self.p = at
        at = self.p
        self.expr()
        if not self.statement_like(at):
            raise Broken
        return self.need(";")

    def statement_like(self, at: int) -> bool:
        """Whether the expression from `at` on may be a statement: an assignment, a call, an increment or a creation."""
        last = self.T[self.p - 1]
        if self.K[self.p - 1] == "p" and last in (")", "++", "--", "}"):
            return True
        depth = 0
        for i in range(at, self.p):
            t = self.T[i]
            if self.K[i] == "p":
                if t in ("(", "[", "{"):
                    depth += 1
                elif t in (")", "]", "}"):
                    depth -= 1
                elif depth == 0 and (t in _ASSIGN or t in ("++", "--") or t == ">=" and self.T[i - 1] == ">" and self.S[i] == self.S[i - 1] + 1):
                    return True
        return self.T[at] == "new" or self.T[at] in ("++", "--")

    def s_if(self) -> None:
        self.p += 1
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def s_while(self) -> None:
        self.p += 1
        self.paren()
        self.statement()

    def s_synchronized(self) -> None:
        self.p += 1
        self.paren()
        self.block()

    def s_do(self) -> None:
        self.p += 1
        self.statement()
        self.need("while")
        self.paren()
        self.need(";")

    def s_for(self) -> None:
        self.p += 1
        self.need("(")
        if self.T[self.p] != ";":
            declared = self.attempt(self.modifiers, self.type, self.name)
            if declared and self.eat(":"):
                self.expr()
                self.need(")")
                return self.statement()
            if declared:
                self.rest_of_variables()
            else:
                self.exprs()
        self.need(";")
        if self.T[self.p] != ";":
            self.expr()
        self.need(";")
        if self.T[self.p] != ")":
            self.exprs()
        self.need(")")
        return self.statement()

    def exprs(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def s_return(self) -> None:
        self.p += 1
        if self.T[self.p] != ";":
            self.expr()
        self.need(";")

    def s_throw(self) -> None:
        self.p += 1
        self.expr()
        self.need(";")

    def s_assert(self) -> None:
        self.p += 1
        self.expr()
        if self.eat(":"):
            self.expr()
        self.need(";")

    def s_break(self) -> None:
        self.p += 1
        if self.K[self.p] == "i":
            self.name()
        self.need(";")

    s_continue = s_break

    def s_try(self) -> None:
        self.p += 1
        enough = False
        if self.eat("("):
            enough = True
            while not self.eat(")"):
                self.attempt(self.modifiers, self.type, self.name, lambda: self.need("="))
                self.expr()
                if not self.eat(";"):
                    self.need(")")
                    break
        self.block()
        while self.eat("catch"):
            enough = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            enough = True
            self.block()
        if not enough:
            raise Broken

    def s_switch(self) -> None:
        self.switch()
        if self.T[self.p] == ".":
            raise Broken

    def switch(self) -> None:
        self.need("switch")
        self.paren()
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                self.case_label()
                while self.eat(","):
                    self.case_label()
                if self.eat("when"):
                    self.expr()
            else:
                self.need("default")
            if self.eat("->"):
                if self.T[self.p] == "{":
                    self.block()
                elif self.T[self.p] == "throw":
                    self.s_throw()
                else:
                    self.expr()
                    self.need(";")
            else:
                self.need(":")
                while self.T[self.p] not in ("case", "}") and not (self.T[self.p] == "default" and self.T[self.p + 1] in (":", "->")):
                    self.statement()

    def case_label(self) -> None:
        if self.eat("default"):
            return
        if self.attempt(self.pattern, self.after_pattern):
            return
        self.ternary(False)

    def after_pattern(self) -> None:
        if self.T[self.p] not in ("->", ":", ",", "when"):
            raise Broken

    def pattern(self) -> None:
        self.modifiers()
        if self.T[self.p] == "_" and self.T[self.p + 1] in (",", ")"):
            self.p += 1
            return
        self.type()
        if self.eat("("):
            self.until(")", self.pattern, trailing=False)
            if self.K[self.p] == "i" and self.T[self.p] not in ("when",):
                self.name()
        elif self.T[self.p] == "_":
            self.p += 1
        else:
            self.name()

    # expressions
    def expr(self) -> None:
        p = self.p
        T, K = self.T, self.K
        k = K[p]
        if T[p + 1] in ENDS and K[p + 1] == "p" and (k in ("n", "s") or k == "i" and T[p] not in RESERVED):
            self.p += 1
            return None
        if k == "i" and T[p + 1] == "->":
            self.p += 2
            return self.lambda_body()
        if T[p] == "(" and k == "p" and T[self.M[p] + 1] == "->":
            at = self.p
            self.p += 1
            if not self.attempt(lambda: self.until(")", self.name, trailing=False)):
                self.p = at
                self.params()
            self.need("->")
            return self.lambda_body()
        self.ternary(True)
        if K[self.p] == "p":
            t = T[self.p]
            if t in _ASSIGN:
                self.p += 1
                return self.expr()
            if t == ">":
                q = self.p
                while T[q] == ">" and self.S[q + 1] == self.S[q] + 1:
                    q += 1
                if T[q] == ">=" and self.S[q] == self.S[q - 1] + 1:
                    self.p = q + 1
                    return self.expr()
        return None

    def lambda_body(self) -> None:
        if self.T[self.p] == "{" and self.K[self.p] == "p":
            self.block()
        else:
            self.expr()

    def conditional(self) -> None:
        self.ternary(True)

    def ternary(self, lambdas: bool) -> None:
        self.binary()
        if self.T[self.p] == "?" and self.K[self.p] == "p":
            self.p += 1
            self.expr()
            self.need(":")
            if lambdas:
                p = self.p
                if self.K[p] == "i" and self.T[p + 1] == "->" or self.T[p] == "(" and self.K[p] == "p" and self.T[self.M[p] + 1] == "->":
                    return self.expr()
            self.ternary(lambdas)
        return None

    def binary(self) -> None:
        self.unary()
        while True:
            t, k = self.T[self.p], self.K[self.p]
            if t == "instanceof" and k == "i":
                self.p += 1
                if not self.attempt(self.pattern):
                    self.modifiers()
                    self.type()
            elif t in _BINARY and k == "p":
                self.p += 1
                self.unary()
            elif t == ">" and k == "p":
                q = self.p
                while self.T[q + 1] == ">" and self.S[q + 1] == self.S[q] + 1:
                    q += 1
                if self.T[q + 1] == ">=" and self.S[q + 1] == self.S[q] + 1:
                    return
                if q - self.p > 2:
                    raise Broken
                self.p = q + 1
                self.unary()
            else:
                return

    def unary(self) -> None:
        t, k = self.T[self.p], self.K[self.p]
        if k == "p":
            if t in ("+", "-", "!", "~", "++", "--"):
                self.p += 1
                return self.unary()
            if t == "(" and self.attempt(self.cast):
                return None
        elif t == "switch" and k == "i":
            return self.switch()
        self.postfix()
        while self.T[self.p] in ("++", "--") and self.K[self.p] == "p":
            self.p += 1
        return None

    def cast(self) -> None:
        self.need("(")
        primitive = self.T[self.p] in _PRIMITIVE and self.T[self.p + 1] == ")"
        self.type()
        while self.eat("&"):
            self.type()
        self.need(")")
        t, k = self.T[self.p], self.K[self.p]
        if not primitive:
            if not (k in ("s", "n") or k == "i" and t not in ("instanceof",) or t in ("(", "!", "~")):
                raise Broken
            if k == "i" and t in RESERVED and t not in ("this", "super", "new", "true", "false", "null", "switch") and t not in _PRIMITIVE:
                raise Broken
        p = self.p
        if k == "i" and self.T[p + 1] == "->" or t == "(" and k == "p" and self.T[self.M[p] + 1] == "->":
            return self.expr()
        return self.unary()

    def arguments(self) -> None:
        self.need("(")
        self.until(")", self.expr, trailing=False)

    def postfix(self) -> None:
        self.primary()
        while self.K[self.p] == "p":
            t = self.T[self.p]
            if t == ".":
                self.p += 1
                if self.T[self.p] == "<":
                    self.type_args()
                if self.T[self.p] == "new":
                    self.creation()
                elif self.T[self.p] in ("this", "super", "class"):
                    self.p += 1
                else:
                    self.name()
            elif t == "(":
                self.arguments()
            elif t == "[":
                if self.T[self.p + 1] == "]":
                    self.dims()
                    if not (self.T[self.p] == "." and self.T[self.p + 1] == "class" or self.T[self.p] == "::"):
                        raise Broken
                    continue
                self.p += 1
                self.expr()
                self.need("]")
            elif t == "::":
                self.p += 1
                self.type_args()
                if not self.eat("new"):
                    self.name()
            elif t == "<" and self.attempt(self.type_args, self.dims, lambda: self.need("::")):
                self.p -= 1
            else:
                return

    def primary(self) -> None:
        t, k = self.T[self.p], self.K[self.p]
        if k in ("n", "s"):
            self.p += 1
        elif k == "i":
            if t not in RESERVED or t in ("this", "super", "true", "false", "null"):
                self.p += 1
            elif t == "new":
                self.creation()
            elif t in _PRIMITIVE or t == "void":
                self.p += 1
                self.dims()
                if self.T[self.p] not in (".", "::"):
                    raise Broken
            elif t == "switch":
                self.switch()
            else:
                raise Broken
        elif t == "(":
            self.paren()
        else:
            raise Broken

    def creation(self) -> None:
        self.need("new")
        self.annotations()
        if self.T[self.p] in _PRIMITIVE:
            self.p += 1
        else:
            self.name()
            self.type_args()
            while self.eat("."):
                self.name()
                self.type_args()
        if self.T[self.p] == "(":
            self.arguments()
            if self.T[self.p] == "{":
                self.class_body()
            return
        if self.T[self.p] == "[" and self.T[self.p + 1] == "]":
            self.dims()
            self.need("{")
            self.until("}", self.initializer)
            return
        self.need("[")
        self.expr()
        self.need("]")
        while self.T[self.p] == "[" and self.T[self.p + 1] != "]":
            self.p += 1
            self.expr()
            self.need("]")
        self.dims()


_HEADS = frozenset(m[2:] for m in dir(Unit) if m.startswith("s_"))


def tokens(src: str) -> Tokens:
    return scan(_LEX, src)


def recognise(src: str) -> None:
    """Raise Broken unless the text is a well-formed compilation unit; an empty one is."""
    Unit(tokens(src.removeprefix("\ufeff"))).program()
