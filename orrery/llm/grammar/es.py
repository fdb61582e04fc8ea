"""JavaScript (ES2023 modules and scripts, with JSX) and TypeScript."""

from __future__ import annotations

import re

from orrery.llm.grammar.base import ENDS, Broken, Cursor, Tokens

_LEX = re.compile(
    r"""(?P<w>(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)*)(?:(?P<i>[#@]?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<n>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0(?!_)\d*|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$]))
    |(?P<s>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<t>`)
    |(?P<p>\.\.\.|=>|===|!==|\*\*=|\?\?=|&&=|\|\|=|<<=|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])|(?P<z>\Z))""",
    re.X,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_ELEMENT = re.compile(r"<\s*(?:>|[A-Za-z_$][\w$.:-]*(?!\s*(?:,|extends\b))(?![\w$.:-]))")
_CONTEXT = frozenset(["{", "}", "<", "/", "/="])
_AFTER_OPERAND = frozenset([")", "]", "}", "++", "--"])
_JSX_TEXT = re.compile(r"[^{}<>]*")
_JSX_TAG = re.compile(r"<\s*(?:[A-Za-z_$][\w$.:-]*)?")
_JSX_ATTR = re.compile(r"\s*(?:([A-Za-z_$][\w$:-]*)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?=\{)))?|(?=\{))")
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())


_HEADED = frozenset("if while for with switch catch".split())
_OPENS_STATEMENT = frozenset("else do export default declare abstract try finally catch".split())
_TYPE_GOES_ON = frozenset([":", "|", "&", "=>", "<", ",", "=", "(", "?", "[", "..."])
_TYPE_WORDS = frozenset("extends implements is keyof readonly infer typeof".split())


class _Places:
    """Whether an operand may follow a closing bracket, which tells a regular expression from a division.

    One pass over the tokens so far, made only as far as it is asked: most texts never ask. Each open bracket is a
    frame of what it holds (statements, class members, an object, expressions), of whether a statement may follow its
    end, and of a function or class whose body is still to come.
    """

    def __init__(self, toks: Tokens, statements: bool):
        self.T, self.K, self.L = toks.text, toks.kind, toks.line
        self.frames: list[list] = [["statements" if statements else "values", False, None, False]]
        self.open: dict[int, bool] = {}  # closing brackets after which an operand may come
        self.colons: set[int] = set()  # those of labels and cases
        self.i = 0

    def after(self, at: int) -> bool:
        while self.i <= at:
            self._step(self.i)
            self.i += 1
        return self.open.get(at, False)

    def _starts(self, i: int) -> bool:
        """Whether token i begins a statement."""
        kind = self.frames[-1][0]
        if not i:
            return kind == "statements"
        t, k = self.T[i - 1], self.K[i - 1]
        if k == "p":
            if t in (";", "{"):
                return kind == "statements"
            if t in (")", "}"):
                return self.open.get(i - 1, False) or self.L[i]
            if t == ":":
                return i - 1 in self.colons
            return t in ("]", "++", "--") and self.L[i]
        if k == "i":
            if t == "async":
                return self._starts(i - 1)
            return t in _OPENS_STATEMENT or t not in _BEFORE_OPERAND
        return k != "q" or t == "}`"

    def _step(self, i: int) -> None:
        t, k, f = self.T[i], self.K[i], self.frames[-1]
        if k == "i":
            if i and self.K[i - 1] == "p" and self.T[i - 1] in (".", "?."):
                return
            if t in ("function", "class"):
                f[2] = (t, self._starts(i))
            elif t in ("interface", "enum", "namespace", "module") and i + 1 < len(self.T) and self.K[i + 1] in ("i", "s"):
                f[2] = (t, True)
            elif t in ("case", "default") and f[0] == "statements":
                f[3] = True
        elif k == "q":
            if t == "`${":
                self.frames.append(["values", False, None, False])
            elif t == "}`" and len(self.frames) > 1:
                self.frames.pop()
        elif k == "p":
            if t == "(":
                before = self.T[i - 1] if i and self.K[i - 1] == "i" else ""
                named = i > 1 and self.T[i - 2] in (".", "?.")
                head = f[0] not in ("class", "object") and (before in _HEADED and not named or before == "await" and i > 1 and self.T[i - 2] == "for")
                self.frames.append(["values", head, None, False])
            elif t == "[":
                self.frames.append(["values", False, None, False])
            elif t == "{":
                self.frames.append(self._brace(i, f))
            elif t in (")", "]", "}"):
                if len(self.frames) > 1:
                    self.open[i] = self.frames.pop()[1]
            elif t == ";":
                f[2], f[3] = None, False
            elif t == "," and f[0] == "object":
                f[2] = None
            elif t == ":" and f[0] == "statements":
                if f[3] or i and self.K[i - 1] == "i" and self._starts(i - 1):
                    self.colons.add(i)
                    f[3] = False

    def _brace(self, i: int, f: list) -> list:
        t, k = (self.T[i - 1], self.K[i - 1]) if i else ("", "")
        going = k == "p" and t in _TYPE_GOES_ON or k == "i" and t in _TYPE_WORDS
        if f[2] and not going:
            what, declared = f[2]
            f[2] = None
            return ["class" if what == "class" else "object" if what in ("interface", "enum") else "statements", declared, None, False]
        if k == "p" and t == "=>":
            return ["statements", True, None, False]
        if f[0] == "class" and not going:
            return ["statements", True, None, False]
        if f[0] == "object" and (k == "p" and t == ")" or k == "i" and t not in _BEFORE_OPERAND):
            return ["statements", False, None, False]
        if f[0] == "statements" and (self._starts(i) or k == "p" and t == ")"):
            return ["statements", True, None, False]
        return ["object", False, None, False]


def tokens(src: str, jsx: bool, start: int = 0, stop_brace: bool = False) -> tuple[Tokens, int, list[Tokens]]:
    """Tokens from `start`; with stop_brace up to the brace that closes what was open before. JSX elements are single
    tokens, the expressions inside them come back as lists of their own."""
    out = Tokens()
    inner: list[Tokens] = []
    add_t, add_k, add_s, add_l = out.text.append, out.kind.append, out.start.append, out.line.append
    braces: list[bool] = []  # True: opened inside a template
    pos, n, fresh = start, len(src), True
    if not start and src.startswith("#!"):
        pos = len(src.split("\n", 1)[0])
    match = _LEX.match
    texts, kinds = out.text, out.kind
    places = _Places(out, not stop_brace)

    def operand() -> bool:
        """Whether an operand may come next, judged by the token before and, if that closes a bracket, by its place."""
        if not kinds:
            return True
        k, t = kinds[-1], texts[-1]
        if k == "p" and t in (")", "}"):
            return places.after(len(texts) - 1)
        return k == "p" and t not in _AFTER_OPERAND or k == "q" and t != "}`" or k == "i" and t in _BEFORE_OPERAND

    while pos < n:
        m = match(src, pos)
        if m is None:
            raise Broken
        kind, end = m.lastgroup, m.end()
        t = m[kind]
        start = end - len(t)
        if start > pos and not fresh:
            gap = src[pos] if start == pos + 1 else m["w"]
            fresh = "\n" in gap or "\r" in gap
        if kind == "i":
            if t[0] == "@":
                add_t("@")
                add_k("p")
                add_s(start)
                add_l(fresh)
                fresh, t = False, t[1:]
        elif kind == "p":
            if t in _CONTEXT:
                if t == "{":
                    braces.append(False)
                elif t == "}":
                    if not braces:
                        if stop_brace:
                            return out.close(start), end, inner
                        raise Broken
                    if braces.pop():
                        r = _TEMPLATE.match(src, end)
                        if r is None:
                            raise Broken
                        end, kind = r.end(), "q"
                        if r[1] == "`":
                            t = "}`"
                        else:
                            t = "}${"
                            braces.append(True)
                elif t == "<":
                    if jsx and _ELEMENT.match(src, start) and operand():
                        end = _jsx(src, start, inner)
                        kind, t = "s", "<jsx/>"
                else:
                    if operand():
                        r = _REGEX.match(src, start)
                        if r is None:
                            raise Broken
                        kind, end, t = "s", r.end(), "/re/"
        elif kind == "s":
            t = '"'
        elif kind == "t":
            r = _TEMPLATE.match(src, end)
            if r is None:
                raise Broken
            end = r.end()
            if r[1] == "`":
                kind, t = "s", "`"
            else:
                kind, t = "q", "`${"
                braces.append(True)
        elif kind == "z":
            break
        add_t(t)
        add_k(kind)
        add_s(start)
        add_l(fresh)
        fresh = False
        pos = end
    if stop_brace or any(braces):
        raise Broken
    return out.close(n), n, inner


def _jsx(src: str, pos: int, inner: list[Tokens]) -> int:
    """The end of the JSX element at pos."""
    m = _JSX_TAG.match(src, pos)
    tag = m[0][1:].strip()
    pos = m.end()
    while True:
        rest = re.compile(r"\s*").match(src, pos).end()
        if src.startswith("/>", rest):
            return rest + 2
        if src.startswith(">", rest):
            pos = rest + 1
            break
        a = _JSX_ATTR.match(src, pos)
        if a is None or a.end() == pos and not src.startswith("{", pos):
            raise Broken
        pos = a.end()
        if src.startswith("{", pos):
            pos = _jsx_braces(src, pos, inner)
    while True:
        pos = _JSX_TEXT.match(src, pos).end()
        if pos >= len(src):
            raise Broken
        c = src[pos]
        if c == "{":
            pos = _jsx_braces(src, pos, inner)
        elif c == "<":
            close = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(src, pos)
            if close:
                if close[1] != tag:
                    raise Broken
                return close.end()
            pos = _jsx(src, pos, inner)
        else:
            raise Broken


def _jsx_braces(src: str, pos: int, inner: list[Tokens]) -> int:
    toks, end, more = tokens(src, True, pos + 1, True)
    inner.append(toks)
    inner += more
    return end


RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_BINARY = frozenset("+ - * / % ** << < <= == != === !== & | ^ && || ?? in instanceof".split())
_UNARY = frozenset("+ - ! ~ typeof void delete ++ -- await".split())
_MODS = frozenset("public private protected readonly static abstract override declare async accessor".split())


class Script(Cursor):
    RESERVED = RESERVED

    def __init__(self, toks: Tokens, ts: bool):
        super().__init__(toks)
        self.ts = ts
        self.noin = False
        self.inside = 0  # functions around
        self.nocond = False  # in the extends clause of a conditional type

    def attempt(self, *steps) -> bool:
        kept = self.noin, self.inside, self.nocond
        if super().attempt(*steps):
            return True
        self.noin, self.inside, self.nocond = kept
        return False

    # statements ---------------------------------------------------------------------------------------------------
    def program(self) -> None:
        while self.K[self.p]:
            self.statement()

    def semi(self) -> None:
        if self.T[self.p] == ";":
            self.p += 1
        elif not (self.T[self.p] == "}" or self.L[self.p]):
            raise Broken

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def statement(self) -> None:
        p = self.p
        t, k = self.T[p], self.K[p]
        if k == "i":
            f = getattr(self, "s_" + t, None) if t in _HEADS else None
            if f is not None:
                return f()
            nt, nk = self.T[p + 1], self.K[p + 1]
            if t == "let" and (nk == "i" and nt not in ("in", "of", "instanceof") or nt in ("[", "{")):
                return self.declaration()
            if t == "async" and nt == "function" and not self.L[p + 1]:
                self.p += 1
                return self.function()
            if self.ts and (nk == "i" or nk == "s" and t == "module") and not self.L[p + 1] and self.ts_statement(t, nt):
                return None
            if self.ts and t in ("declare", "global") and nt == "{":
                self.p += 1
                return self.block()
            if nt == ":" and t not in RESERVED:
                self.p += 2
                return self.statement()
        elif t == "{" and k == "p":
            return self.block()
        elif t == ";":
            self.p += 1
            return None
        elif t == "@" and k == "p":
            self.decorators()
            if self.eat("export"):
                self.eat("default")
            self.eat("abstract")
            return self.klass()
        self.expr()
        self.semi()
        return None

    def ts_statement(self, t: str, nt: str) -> bool:
        if t == "interface":
            self.p += 1
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.type_list()
            self.object_type()
        elif t == "type":
            self.p += 1
            self.name()
            self.type_params()
            self.need("=")
            self.type()
            self.semi()
        elif t == "abstract" and nt == "class":
            self.p += 1
            self.klass()
        elif t == "declare":
            self.p += 1
            self.statement_or_signature()
        elif t in ("namespace", "module") or t == "global":
            self.p += 1
            if self.K[self.p] == "s":
                self.p += 1
            else:
                self.name()
                while self.eat("."):
                    self.name()
            if self.T[self.p] == "{":
                self.block()
            else:
                self.semi()
        else:
            return False
        return True

    def statement_or_signature(self) -> None:
        self.statement()

    def declaration(self) -> None:
        const = self.T[self.p] == "const"
        self.p += 1
        if const and self.ts and self.T[self.p] == "enum":
            return self.s_enum()
        self.declarators(const)
        self.semi()
        return None

    def declarators(self, const: bool, loop: bool = False) -> None:
        while True:
            pattern = self.T[self.p] in ("{", "[")
            self.binding()
            if self.ts:
                self.eat("!")
            self.annotation()
            self.plain = loop
            if loop and self.T[self.p] in ("of", "in"):
                return
            if self.eat("="):
                self.plain = False
                self.assign()
            elif (const or pattern) and not (self.ts and not pattern and self.declared()):
                raise Broken
            if not self.eat(","):
                return
            loop = False

    def declared(self) -> bool:
        i = self.p
        while i > 0 and not self.L[i]:
            i -= 1
        return "declare" in self.T[i : self.p]

    s_var = s_const = declaration

    def s_function(self) -> None:
        self.function()

    def function(self, need_name: bool = True) -> None:
        self.need("function")
        self.eat("*")
        if self.T[self.p] not in ("(", "<"):
            self.name()
        elif need_name:
            raise Broken
        self.rest_of_function(self.ts)

    def rest_of_function(self, may_lack_body: bool = False) -> None:
        self.type_params()
        self.params()
        self.return_type()
        if may_lack_body and self.T[self.p] != "{":
            self.semi()
        else:
            self.body()

    def body(self) -> None:
        noin, self.noin = self.noin, False
        self.inside += 1
        self.block()
        self.inside -= 1
        self.noin = noin

    def return_type(self) -> None:
        if self.ts and self.eat(":"):
            self.predicate()

    def params(self) -> None:
        self.need("(")
        self.until(")", self.param)

    def param(self) -> None:
        self.decorators()
        if self.ts:
            while self.T[self.p] in _MODS and (self.K[self.p + 1] == "i" or self.T[self.p + 1] in ("{", "[")):
                self.p += 1
            if self.T[self.p] == "this":
                self.p += 1
                return self.annotation()
        rest = self.eat("...")
        self.binding()
        if self.ts:
            self.eat("?")
        self.annotation()
        if self.eat("="):
            if rest:
                raise Broken
            self.assign()
        if rest and self.T[self.p] != ")":
            raise Broken
        return None

    def annotation(self) -> None:
        if self.ts and self.eat(":"):
            self.type()

    def binding(self) -> None:
        if self.eat("{"):
            self.until("}", self.binding_property)
        elif self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding_default()
                if not self.eat(","):
                    self.need("]")
                    break
        else:
            self.name()

    def binding_default(self) -> None:
        self.binding()
        if self.eat("="):
            self.assign()

    def binding_property(self) -> None:
        if self.eat("..."):
            return self.binding()
        simple = self.K[self.p] == "i"
        t = self.T[self.p]
        self.property_name()
        if self.eat(":"):
            return self.binding_default()
        if not simple or t in RESERVED:
            raise Broken
        if self.eat("="):
            self.assign()
        return None

    def property_name(self) -> None:
        if self.eat("["):
            self.assign()
            self.need("]")
        elif self.K[self.p] in ("i", "s", "n"):
            self.p += 1
        else:
            raise Broken

    def decorators(self) -> None:
        while self.T[self.p] == "@" and self.K[self.p] == "p":
            self.p += 1
            if self.T[self.p] == "(":
                self.paren()
            else:
                self.word()
                while self.eat("."):
                    self.word()
                if self.T[self.p] == "(":
                    self.arguments()

    def s_class(self) -> None:
        self.klass()

    def klass(self, need_name: bool = True) -> None:
        self.need("class")
        if self.K[self.p] == "i" and self.T[self.p] not in ("extends", "implements"):
            self.name()
        elif need_name:
            raise Broken
        self.type_params()
        if self.eat("extends"):
            self.postfix()
            if self.ts and self.T[self.p] == "<":
                self.type_args()
        if self.ts and self.eat("implements"):
            self.type_list()
        self.need("{")
        while not self.eat("}"):
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return None
        self.decorators()
        if self.T[self.p] == "static" and self.T[self.p + 1] == "{":
            self.p += 1
            inside, self.inside = self.inside, 0
            self.block()
            self.inside = inside
            return None
        after = ("(", "=", ";", "}", ":", "?", "!", "<", ",")
        accessor = ""
        while self.K[self.p] == "i" and self.T[self.p + 1] not in after and not (self.L[self.p + 1] and self.T[self.p] not in ("static", "async") and self.K[self.p + 1] == ""):
            t = self.T[self.p]
            if t in ("static", "async", "get", "set", "accessor") or self.ts and t in _MODS:
                if t in ("get", "set", "async") and self.L[self.p + 1]:
                    break
                accessor = t if t in ("get", "set") else accessor
                self.p += 1
            else:
                break
        self.eat("*")
        if self.ts and self.T[self.p] == "[" and self.K[self.p + 1] == "i" and self.T[self.p + 2] == ":":
            self.p += 3
            self.type()
            self.need("]")
            self.annotation()
            return self.semi()
        self.property_name()
        if self.ts and not self.eat("?"):
            self.eat("!")
        if self.T[self.p] in ("(", "<"):
            self.accessor_params(accessor)
            return self.rest_of_function(self.ts)
        if accessor:
            raise Broken
        self.annotation()
        if self.eat("="):
            self.assign()
        return self.semi()

    def accessor_params(self, kind: str) -> None:
        """A getter takes nothing, a setter one thing."""
        if not kind:
            return
        at, end = self.p, self.M.get(self.p, -1)
        if self.T[at] != "(" or (kind == "get") != (end == at + 1):
            raise Broken
        if kind == "set":
            depth = 0
            for i in range(at + 1, end):
                if self.K[i] == "p":
                    depth += (self.T[i] in "([{") - (self.T[i] in ")]}")
                    if self.T[i] == "," and not depth and i + 1 < end and not self.ts:
                        raise Broken

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

    def s_with(self) -> None:
        self.s_while()

    def s_do(self) -> None:
        self.p += 1
        self.statement()
        self.need("while")
        self.paren()
        self.eat(";")

    def s_for(self) -> None:
        self.p += 1
        wait = self.eat("await")
        self.need("(")
        t = self.T[self.p]
        self.noin = True
        if t in ("var", "const") or t == "let" and (self.K[self.p + 1] == "i" and self.T[self.p + 1] not in ("of", "in") or self.T[self.p + 1] in ("{", "[")):
            self.p += 1
            self.declarators(t == "const", True)
            if self.T[self.p] in ("of", "in") and not self.plain:
                raise Broken
        elif t != ";":
            self.expr()
        self.noin = False
        if self.eat("of"):
            self.assign()
        elif not wait and self.eat("in"):
            self.expr()
        elif wait:
            raise Broken
        else:
            self.need(";")
            if self.T[self.p] != ";":
                self.expr()
            self.need(";")
            if self.T[self.p] != ")":
                self.expr()
        self.need(")")
        self.statement()

    def s_return(self) -> None:
        if not self.inside:
            raise Broken
        self.p += 1
        if self.T[self.p] not in (";", "}") and not self.L[self.p]:
            self.expr()
        self.semi()

    def s_throw(self) -> None:
        self.p += 1
        if self.L[self.p]:
            raise Broken
        self.expr()
        self.semi()

    def s_break(self) -> None:
        self.p += 1
        if self.K[self.p] == "i" and not self.L[self.p]:
            self.name()
        self.semi()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.p += 1
        self.semi()

    def s_try(self) -> None:
        self.p += 1
        self.block()
        caught = self.eat("catch")
        if caught:
            if self.eat("("):
                self.binding()
                self.annotation()
                self.need(")")
            self.block()
        if self.eat("finally"):
            self.block()
        elif not caught:
            raise Broken

    def s_switch(self) -> None:
        self.p += 1
        self.paren()
        self.need("{")
        default = False
        while not self.eat("}"):
            if self.eat("case"):
                self.expr()
            else:
                self.need("default")
                if default:
                    raise Broken
                default = True
            self.need(":")
            while self.T[self.p] not in ("case", "default", "}"):
                self.statement()

    def s_import(self) -> None:
        if self.T[self.p + 1] in ("(", "."):
            self.expr()
            return self.semi()
        self.p += 1
        if self.K[self.p] == "s":
            self.p += 1
            return self.with_attributes()
        if self.ts and self.T[self.p] == "type" and self.T[self.p + 1] != "from" and self.T[self.p + 1] != ",":
            self.p += 1
        if self.K[self.p] == "i":
            self.name()
            if self.ts and self.eat("="):
                self.expr()
                return self.semi()
            if not self.eat(","):
                return self.from_clause()
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.need("{")
            self.until("}", self.specifier)
        return self.from_clause()

    def specifier(self) -> None:
        if self.ts and self.T[self.p] == "type" and self.K[self.p + 1] in ("i", "s") and not (self.T[self.p + 1] == "as" and self.T[self.p + 2] in (",", "}")):
            self.p += 1
        if self.K[self.p] not in ("i", "s"):
            raise Broken
        self.p += 1
        if self.eat("as"):
            if self.K[self.p] not in ("i", "s"):
                raise Broken
            self.p += 1

    def from_clause(self) -> None:
        self.need("from")
        if self.K[self.p] != "s":
            raise Broken
        self.p += 1
        self.with_attributes()

    def with_attributes(self) -> None:
        if self.T[self.p] in ("with", "assert") and self.T[self.p + 1] == "{":
            self.p += 1
            self.object()
        self.semi()

    def s_export(self) -> None:
        self.p += 1
        if self.eat("default"):
            t = self.T[self.p]
            if t == "function" or t == "async" and self.T[self.p + 1] == "function":
                self.eat("async")
                return self.function(False)
            if t == "class" or t == "abstract" or t == "@":
                self.decorators()
                self.eat("abstract")
                return self.klass(False)
            if self.ts and t == "interface":
                return self.statement()
            self.assign()
            return self.semi()
        if self.eat("*"):
            if self.eat("as"):
                self.specifier()
            return self.from_clause()
        if self.ts and self.T[self.p] == "type" and self.T[self.p + 1] in ("{", "*"):
            self.p += 1
            if self.eat("*"):
                return self.from_clause()
        if self.eat("{"):
            self.until("}", self.specifier)
            if self.T[self.p] == "from":
                return self.from_clause()
            return self.semi()
        if self.ts and self.eat("="):
            self.expr()
            return self.semi()
        if self.ts and self.T[self.p] == "import":
            return self.statement()
        t = self.T[self.p]
        if t not in ("var", "let", "const", "function", "class", "async", "@") and not (self.ts and t in ("interface", "type", "enum", "declare", "abstract", "namespace", "module")):
            raise Broken
        return self.statement()

    def s_enum(self) -> None:
        if not self.ts:
            raise Broken
        self.need("enum")
        self.name()
        self.need("{")
        self.until("}", self.enum_member)

    def enum_member(self) -> None:
        self.property_name()
        if self.eat("="):
            self.assign()

    # expressions --------------------------------------------------------------------------------------------------
    def expr(self) -> None:
        self.assign()
        while self.eat(","):
            self.assign()

    def assign(self) -> None:
        p = self.p
        T, K = self.T, self.K
        k = K[p]
        if T[p + 1] in ENDS and K[p + 1] == "p" and (k in ("n", "s") or k == "i" and T[p] not in RESERVED):
            self.p += 1
            return
        if k == "i":
            t = T[p]
            if T[p + 1] == "=>" and t not in RESERVED:
                self.p += 2
                return self.arrow_body()
            if t == "async" and not self.L[p + 1]:
                if K[p + 1] == "i" and T[p + 2] == "=>":
                    self.p += 3
                    return self.arrow_body()
                if T[p + 1] in ("(", "<"):
                    self.p += 1
                    if self.arrow():
                        return
                    self.p = p
            elif t == "yield" and (T[p + 1] not in ENDS) and T[p + 1] not in _ASSIGN and T[p + 1] not in (".", ":"):
                self.p += 1
                self.eat("*")
                if not self.L[self.p]:
                    self.assign()
                return
        elif (T[p] == "(" or self.ts and T[p] == "<") and k == "p" and self.arrow():
            return
        target = self.conditional()
        if self.T[self.p] in _ASSIGN and self.K[self.p] == "p":
            if not target:
                raise Broken
            self.p += 1
            self.assign()
        elif self.T[self.p] == ">" and self.K[self.p] == "p":
            # >>= and >>>= arrive as single signs
            q = self.p
            while self.T[q] == ">" and self.S[q + 1] == self.S[q] + 1:
                q += 1
            if self.T[q] == "=" and target:
                self.p = q + 1
                self.assign()
        return

    def arrow(self) -> bool:
        """An arrow function at a parenthesis or type parameters, if there is one."""
        p = self.p
        if self.T[p] == "(":
            after = self.T[self.M[p] + 1]
            if after != "=>" and not (self.ts and after == ":"):
                return False
            if after == "=>":
                self.params()
                self.need("=>")
                self.arrow_body()
                return True
        return self.attempt(self.type_params, self.params, self.return_type, lambda: self.need("=>"), self.arrow_body)

    def arrow_body(self) -> None:
        if self.T[self.p] == "{" and self.K[self.p] == "p":
            self.body()
        else:
            self.assign()

    def conditional(self) -> bool:
        target = self.binary()
        if self.T[self.p] == "?" and self.K[self.p] == "p":
            self.p += 1
            noin, self.noin = self.noin, False
            self.assign()
            self.noin = noin
            self.need(":")
            self.assign()
            return False
        return target

    def binary(self) -> bool:
        if self.K[self.p] == "i" and self.T[self.p][0] == "#" and self.T[self.p + 1] == "in":
            self.p += 2  # a brand check
        target = self.unary()
        mixed = 0
        while True:
            t, k = self.T[self.p], self.K[self.p]
            if k == "p" or k == "i":
                if t in _BINARY and not (t == "in" and self.noin):
                    if t == "??" or t == "||" or t == "&&":
                        mixed |= 1 if t == "??" else 2
                        if mixed == 3:
                            raise Broken
                    self.p += 1
                    self.unary()
                    target = False
                    continue
                if t == ">" and k == "p":
                    q = self.p
                    while self.T[q + 1] == ">" and self.S[q + 1] == self.S[q] + 1:
                        q += 1
                    if q - self.p > 2:
                        raise Broken
                    if self.T[q + 1] in ("=", "==", "===") and self.S[q + 1] == self.S[q] + 1:
                        if q > self.p or self.T[q + 1] != "=":
                            return target  # a compound assignment, or an error
                        q += 1
                    self.p = q + 1
                    self.unary()
                    target = False
                    continue
                if self.ts and k == "i" and t in ("as", "satisfies") and not self.L[self.p]:
                    self.p += 1
                    if not self.eat("const"):
                        self.type()
                    continue
            return target

    def unary(self) -> bool:
        t, k = self.T[self.p], self.K[self.p]
        if t in _UNARY and (k == "p" or k == "i"):
            if t == "await" and (self.T[self.p + 1] in ENDS or self.T[self.p + 1] in _ASSIGN or self.T[self.p + 1] in (".", "=>", ":")):
                return self.postfix()
            self.p += 1
            target = self.unary()
            if t in ("++", "--"):
                if not target:
                    raise Broken
            elif self.T[self.p] == "**" and self.K[self.p] == "p":
                raise Broken
            return False
        if self.ts and t == "<" and k == "p":
            self.p += 1
            self.type()
            self.need(">")
            return self.unary()
        target = self.postfix()
        if self.T[self.p] in ("++", "--") and self.K[self.p] == "p" and not self.L[self.p]:
            if not target:
                raise Broken
            self.p += 1
            return False
        return target

    def arguments(self) -> None:
        self.need("(")
        noin, self.noin = self.noin, False
        self.until(")", self.spread)
        self.noin = noin

    def spread(self) -> None:
        self.eat("...")
        self.assign()

    def postfix(self) -> bool:
        target = self.primary()
        T, K = self.T, self.K
        while True:
            t, k = T[self.p], K[self.p]
            if k == "p":
                if t == ".":
                    self.p += 1
                    self.word()
                    target = True
                elif t == "(":
                    self.arguments()
                    target = False
                elif t == "[":
                    self.p += 1
                    noin, self.noin = self.noin, False
                    self.expr()
                    self.noin = noin
                    self.need("]")
                    target = True
                elif t == "?.":
                    self.p += 1
                    if T[self.p] == "(":
                        self.arguments()
                    elif self.eat("["):
                        self.expr()
                        self.need("]")
                    else:
                        self.word()
                    target = False
                elif self.ts and t == "!" and not self.L[self.p]:
                    self.p += 1
                elif self.ts and t == "<":
                    at = self.p
                    if not self.attempt(self.type_args) or not (T[self.p] in ("(", ")", ",", ";", "]", ".", "?.") or K[self.p] in ("s", "q", "")):
                        self.p = at
                        return target
                else:
                    return target
            elif k == "q" and t == "`${" or k == "s" and t == "`":
                self.template()
                target = False
            else:
                return target

    def template(self) -> None:
        if self.K[self.p] == "s":
            self.p += 1
            return
        while True:
            self.p += 1
            noin, self.noin = self.noin, False
            self.expr()
            self.noin = noin
            if self.K[self.p] != "q":
                raise Broken
            if self.T[self.p] == "}`":
                self.p += 1
                return

    def primary(self) -> bool:
        """One operand; True if it may be assigned to."""
        p = self.p
        t, k = self.T[p], self.K[p]
        if k == "i":
            if t == "async" and self.T[p + 1] == "function" and not self.L[p + 1]:
                self.p += 1
                self.function(False)
                return False
            if t not in RESERVED:
                self.p += 1
                return True
            if t == "function":
                self.function(False)
            elif t == "class":
                self.klass(False)
            elif t == "new":
                self.p += 1
                if self.eat("."):
                    self.need("target")
                    return False
                self.new_target()
            elif t in ("this", "null", "true", "false"):
                self.p += 1
            elif t == "super":
                self.p += 1
                if self.T[self.p] not in ("(", ".", "["):
                    raise Broken
            elif t == "import":
                self.p += 1
                if self.eat("."):
                    self.word()
                elif self.T[self.p] != "(" or self.T[self.p + 1] == ")":
                    raise Broken
            else:
                raise Broken
            return False
        if k == "n" or k == "s":
            self.p += 1
            return False
        if k == "q":
            self.template()
            return False
        if t == "(":
            self.p += 1
            noin, self.noin = self.noin, False
            self.expr()
            self.noin = noin
            self.need(")")
            return True
        if t == "[":
            self.p += 1
            noin, self.noin = self.noin, False
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.spread()
                if not self.eat(","):
                    self.need("]")
                    break
            self.noin = noin
            return True
        if t == "{":
            self.object()
            return True
        if t == "@":
            self.decorators()
            self.klass(False)
            return False
        raise Broken

    def new_target(self) -> None:
        self.primary()
        while True:
            if self.eat("."):
                self.word()
            elif self.eat("["):
                self.expr()
                self.need("]")
            else:
                break
        if self.ts and self.T[self.p] == "<":
            self.attempt(self.type_args)
        if self.T[self.p] == "(":
            self.arguments()

    def object(self) -> None:
        self.need("{")
        noin, self.noin = self.noin, False
        self.until("}", self.property)
        self.noin = noin

    def property(self) -> None:
        if self.eat("..."):
            return self.assign()
        T, K = self.T, self.K
        after = (",", ":", "(", "}", "=", "<")
        accessor = ""
        while K[self.p] == "i" and T[self.p] in ("async", "get", "set") and T[self.p + 1] not in after:
            accessor = T[self.p] if T[self.p] != "async" else accessor
            self.p += 1
        star = self.eat("*")
        simple = K[self.p] == "i" and T[self.p] not in RESERVED and not star
        self.property_name()
        if T[self.p] in ("(", "<"):
            self.accessor_params(accessor)
            return self.rest_of_function()
        if accessor:
            raise Broken
        if self.eat(":"):
            return self.assign()
        if not simple:
            raise Broken
        if self.eat("="):
            self.assign()
        return None

    # types --------------------------------------------------------------------------------------------------------
    def type_params(self) -> None:
        if self.ts and self.T[self.p] == "<" and self.K[self.p] == "p":
            self.p += 1
            if self.T[self.p] == ">":
                raise Broken
            self.until(">", self.type_param)

    def type_param(self) -> None:
        while self.T[self.p] in ("const", "in", "out") and self.K[self.p + 1] == "i" and self.T[self.p + 1] != "extends":
            self.p += 1
        self.name()
        if self.eat("extends"):
            self.type()
        if self.eat("="):
            self.type()

    def type_args(self) -> None:
        self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.need(">")

    def type_list(self) -> None:
        self.type()
        while self.eat(","):
            self.type()

    def predicate(self) -> None:
        if self.T[self.p] == "asserts" and self.K[self.p + 1] == "i" and not self.L[self.p + 1]:
            self.p += 2
            if self.eat("is"):
                self.type()
            return
        if self.K[self.p] == "i" and self.T[self.p + 1] == "is" and not self.L[self.p + 1]:
            self.p += 2
        self.type()

    def type(self) -> None:
        p = self.p
        if self.K[p] == "i" and self.T[p + 1] in (",", ")", ";", "}", "=", "{", "]") and self.T[p] not in _NOT_TYPES:
            self.p += 1
            return
        nocond, self.nocond = self.nocond, False
        self.union()
        if self.T[self.p] == "extends" and not self.L[self.p]:
            self.p += 1
            self.nocond = True
            self.union()
            self.nocond = False
            self.need("?")
            self.type()
            self.need(":")
            self.type()
        self.nocond = nocond

    def union(self) -> None:
        self.eat("|")
        self.intersection()
        while self.eat("|"):
            self.intersection()

    def intersection(self) -> None:
        self.eat("&")
        self.type_operator()
        while self.eat("&"):
            self.type_operator()

    def type_operator(self) -> None:
        t = self.T[self.p]
        if t in ("keyof", "unique", "readonly", "infer") and self.K[self.p] == "i" and (self.K[self.p + 1] in ("i", "s") or self.T[self.p + 1] in ("{", "[", "(")):
            self.p += 1
            self.type_operator()
            if t == "infer" and self.T[self.p] == "extends":
                self.attempt(lambda: self.need("extends"), self.type_operator, self._no_question)
            return
        self.type_primary()
        while self.T[self.p] == "[" and not self.L[self.p]:
            self.p += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def _no_question(self) -> None:
        if self.T[self.p] == "?" and not self.nocond:
            raise Broken

    def type_primary(self) -> None:
        p = self.p
        t, k = self.T[p], self.K[p]
        if k == "s" or k == "n":
            self.p += 1
        elif k == "q":
            while True:
                self.p += 1
                self.type()
                if self.K[self.p] != "q":
                    raise Broken
                if self.T[self.p] == "}`":
                    self.p += 1
                    return
        elif t == "-":
            self.p += 1
            if self.K[self.p] != "n":
                raise Broken
            self.p += 1
        elif t == "{":
            self.object_type()
        elif t == "[":
            self.p += 1
            self.until("]", self.tuple_member)
        elif t == "(" or t == "<":
            if t == "<" or self.T[self.M[p] + 1] == "=>":
                self.type_params()
                self.params()
                self.need("=>")
                self.predicate()
            else:
                self.p += 1
                self.type()
                self.need(")")
        elif k == "i":
            if t == "new" or t == "abstract" and self.T[p + 1] == "new":
                self.eat("abstract")
                self.p += 1
                self.type_params()
                self.params()
                self.need("=>")
                self.type()
            elif t == "typeof":
                self.p += 1
                if self.T[self.p] == "import":
                    return self.type_primary()
                self.word()
                while self.eat("."):
                    self.word()
                if self.T[self.p] == "<" and not self.L[self.p]:
                    self.type_args()
            elif t == "import":
                self.p += 1
                self.need("(")
                self.type()
                self.need(")")
                while self.eat("."):
                    self.word()
                if self.T[self.p] == "<":
                    self.type_args()
            else:
                if t in _NOT_TYPES:
                    raise Broken
                self.p += 1
                while self.eat("."):
                    self.word()
                if self.T[self.p] == "<" and not self.L[self.p]:
                    self.type_args()
        else:
            raise Broken
        return None

    def tuple_member(self) -> None:
        self.eat("...")
        if self.K[self.p] == "i" and (self.T[self.p + 1] == ":" or self.T[self.p + 1] == "?" and self.T[self.p + 2] == ":"):
            self.p += 1
            self.eat("?")
            self.need(":")
        self.type()
        self.eat("?")

    def object_type(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.type_member()
            if not (self.eat(";") or self.eat(",") or self.T[self.p] == "}" or self.L[self.p]):
                raise Broken

    def type_member(self) -> None:
        T, K = self.T, self.K
        after = ("?", ":", "(", "<", ";", ",", "}")
        if T[self.p] in ("+", "-") and T[self.p + 1] == "readonly":
            self.p += 1
        while K[self.p] == "i" and T[self.p] in ("readonly", "get", "set") and T[self.p + 1] not in after:
            self.p += 1
        if T[self.p] == "new" and T[self.p + 1] in ("(", "<"):
            self.p += 1
        if T[self.p] in ("(", "<"):
            self.type_params()
            self.params()
            return self.return_type()
        if T[self.p] == "[" and K[self.p + 1] == "i" and T[self.p + 2] in (":", "in"):
            mapped = T[self.p + 2] == "in"
            self.p += 3
            self.type()
            if mapped and self.eat("as"):
                self.type()
            self.need("]")
            if T[self.p] in ("+", "-"):
                self.p += 1
            self.eat("?")
            return self.annotation()
        self.property_name()
        self.eat("?")
        if T[self.p] in ("(", "<"):
            self.type_params()
            self.params()
            return self.return_type()
        return self.annotation()


_NOT_TYPES = (RESERVED - {"void", "null", "this", "true", "false", "typeof", "new", "import"})
_HEADS = frozenset(m[2:] for m in dir(Script) if m.startswith("s_"))


def may_hold_elements(src: str) -> bool:
    """Whether anything in a text looks like the start of a JSX element."""
    return _ELEMENT.search(src) is not None


def recognise(src: str, ts: bool, jsx: bool) -> None:
    """Raise Broken unless the text is a well-formed module or script. A leading byte order mark is allowed."""
    toks, _, inner = tokens(src.removeprefix("\ufeff"), jsx)
    recognise_tokens(toks, inner, ts)


def recognise_tokens(toks: Tokens, inner: list[Tokens], ts: bool) -> None:
    Script(toks, ts).program()
    for part in inner:
        c = Script(part, ts)
        if c.K[0]:
            c.eat("...")
            c.expr()
            if c.K[c.p]:
                raise Broken
