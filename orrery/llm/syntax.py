"""Source files that do not parse.

The tokens of a text rank the languages, and every file is then parsed by all supported grammars in that order. The
grammar of the language that its path claims decides whether it is well-formed; if that refuses it and another one
accepts, the extension is wrong; if none does, the text is corrupt, and its end, its brackets and conflict markers tell
how. A grammar that can't begin with a text's first token refuses it there, and JavaScript and TypeScript share their
tokens, so that the foreign parses cost little. Parsing is done in the Python workers, one text at a time; equal texts of
a task that claim one extension are parsed once, so that a text which a third of the files share costs one parse a task
and no exchange.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.grammar import es, golang, java, rust
from orrery.llm.grammar.base import Broken

#: Language by extension.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "py": "python", "rs": "rust", "go": "go", "java": "java", "json": "json",
}

#: Tokens that speak for a language, each as often as it stands in a text.
SIGNS = {
    "typescript": ("interface ", "readonly ", ": string", ": number", ": boolean", ": void", ": unknown", " as ", "export type "),
    "javascript": ("const ", "let ", "function ", "require(", "module.exports", "=> ", "===", "export "),
    "python": ("def ", "self.", "elif ", "except", "None", " not ", "raise ", ":\n"),
    "rust": ("fn ", "let mut ", "impl ", "pub ", "match ", "&self", "&mut ", "::", "-> "),
    "go": ("func ", "package ", "defer ", "range ", " nil", ":= ", "err ", "struct {"),
    "java": ("public ", "private ", "final ", "static ", "void ", "String ", "throws ", "new "),
    "json": ("\": ", "\":", "\",\n", "},\n", "],\n"),
}
#: What a text of these languages begins with, after blanks and comments.
_GAP = r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)*+"
_BEGINS = {
    "go": re.compile(_GAP + r"package\s+\w+\b(?!\s*\.)"),
    "java": re.compile(_GAP + r"(?:\Z|[@;]|\x1a|package\s[^;{}()]*;|import\s[^;{}()'\"]*;|(?:public|protected|private|abstract|final|static|strictfp|sealed|non|class|interface|enum|record|module|open)\b)"),
    "rust": re.compile(r"(?:#!(?!\[)[^\n]*)?" + _GAP + r"(?:\Z|/\*|#!?\s*\[|::|const\s+(?:\w+\s*:|(?:fn|unsafe|async|extern)\b)|async\s+(?:fn|unsafe|extern)\b|(?:pub|use|mod|fn|static|unsafe|extern|impl|trait|struct|enum|union|type|auto|safe|crate|default)\b|(?:r#)?\w+\s*(?:::|!))"),
    "json": re.compile(r'[ \t\r\n]*[\[{"\-\dtfn]'),
}
#: Beginnings that some grammars refuse: two names on one line where the first is no word that a name may follow, and others.
_NAMES = re.compile(_GAP + r"([A-Za-z_]\w*)[ \t]+[A-Za-z_]\w*")
_NO_SCRIPT = re.compile(_GAP + r"(?:\"\"\"|'{3}|import\s+(?!type\b|defer\b|source\b)\w+\b(?!\s*(?:,|=|from\b))|class\s+\w+\s*[:(]|async\s+def\b|from[ \t]+[.\w]+[ \t]+import\b)")
_NO_PYTHON = re.compile(r"\s*(?://|/\*|import\s*[{*(\"']|export\s|const\s|let\s|var\s|function\s)")
_BEFORE_NAME = {
    "script": frozenset(
        "var let const function class import export async await return throw typeof delete void new yield case default do else break continue type interface enum declare namespace module abstract global static in of instanceof as satisfies is extends if for while".split()
    ),
    "python": frozenset("and as assert async await break case class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try type while with yield".split()),
}
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: |$)", re.M)
#: Frames of the interpreter that a parse may nest; they lie on the heap.
DEPTH = 1_000_000

#: Python's messages for nesting beyond its tokeniser's tables.
_DEPTH = ("too many nested parentheses", "too many levels of indentation")


def _no_constant(name: str):
    raise Broken


def _python(src: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        limit = sys.get_int_max_str_digits()
        sys.set_int_max_str_digits(0)
        try:
            ast.parse(src.removeprefix("﻿"))
        except MemoryError:  # the parser's own stack is full
            raise RecursionError from None
        except SyntaxError as e:
            raise RecursionError if str(e.msg).startswith(_DEPTH) else Broken from None
        except ValueError:
            raise Broken from None
        finally:
            sys.set_int_max_str_digits(limit)


_JSON = re.compile(r'[ \t\r\n]*+(?:(?P<v>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null)|(?P<p>[\[\]{},:])|(?P<z>\Z))')


def _deep_json(src: str) -> None:
    """JSON of any depth, by an explicit stack."""
    stack: list[str] = []
    want, pos = "value", 0  # value, value or end, key, key or end, colon, after
    while True:
        m = _JSON.match(src, pos)
        if m is None:
            raise Broken
        kind, t, pos = m.lastgroup, m[m.lastgroup], m.end()
        if kind == "z":
            if want == "after" and not stack:
                return
            raise Broken
        if want in ("key", "key or end") and kind == "v" and t[0] == '"':
            want = "colon"
        elif want == "colon" and t == ":":
            want = "value"
        elif want in ("value", "value or end") and (kind == "v" or t in ("[", "{")):
            if kind == "p":
                stack.append(t)
            want = "after" if kind == "v" else "value or end" if t == "[" else "key or end"
        elif t == "]" and stack and stack[-1] == "[" and want in ("after", "value or end") or t == "}" and stack and stack[-1] == "{" and want in ("after", "key or end"):
            stack.pop()
            want = "after"
        elif t == "," and want == "after" and stack:
            want = "value" if stack[-1] == "[" else "key"
        else:
            raise Broken


def _json(src: str) -> None:
    try:
        json.loads(src, parse_constant=_no_constant, parse_int=len, parse_float=len)  # numbers of any length, unread
    except RecursionError:
        _deep_json(src)
    except ValueError:
        raise Broken from None


class Text:
    """A text and what its parses share."""

    def __init__(self, src: str):
        self.src = src
        self._script: dict[bool, tuple] = {}

    def script(self, jsx: bool):
        """Tokens of JavaScript or TypeScript; those with JSX serve for both if there is no element."""
        got = self._script.get(jsx)
        if got is None:
            if not jsx:
                try:
                    both = self.script(True)
                    if not both[2]:
                        return both
                except Broken:
                    if not es.may_hold_elements(self.src):
                        raise
            toks, _, inner = es.tokens(self.src.removeprefix("﻿"), jsx)
            got = self._script[jsx] = (toks, inner, "<jsx/>" in toks.text)
        return got


def _refused_at_once(src: str, language: str) -> bool:
    """Whether a grammar can't begin as the text does."""
    if language != "json":
        src = src.removeprefix("\ufeff")
    begins = _BEGINS.get(language)
    if begins is not None:
        return not begins.match(src)
    script = language != "python"
    if (_NO_SCRIPT if script else _NO_PYTHON).match(src):
        return True
    m = _NAMES.match(src)
    return m is not None and m[1] not in _BEFORE_NAME["script" if script else "python"]


def parses(src: str | Text, language: str, jsx: bool = False) -> bool | None:
    """Whether a text is well-formed in a language; None if its nesting is beyond the parser's depth, so that it isn't known."""
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    text = src if isinstance(src, Text) else Text(src)
    src = text.src
    if _refused_at_once(src, language):
        return False
    try:
        if language in ("typescript", "javascript"):
            toks, inner, _ = text.script(jsx or language == "javascript")
            es.recognise_tokens(toks, inner, language == "typescript")
        elif language == "python":
            _python(src)
        elif language == "rust":
            rust.recognise(src)
        elif language == "go":
            golang.recognise(src)
        elif language == "java":
            java.recognise(src)
        elif language == "json":
            _json(src)
        else:
            raise ValueError(language)
    except RecursionError:
        return None
    except Broken:
        return False
    return True


def ranked(src: str) -> list[str]:
    """The languages, those that the text's tokens speak for most first."""
    count = src.count
    score = {k: sum(map(count, tokens)) for k, tokens in SIGNS.items()}
    return sorted(score, key=lambda k: (-score[k], k))


#: Languages of which one contains the other, so that a text of both says nothing about its extension.
_FAMILY = {"typescript": "script", "javascript": "script"}


def verdict(src: str, extension: str) -> tuple[bool | None, str, str | None, str | None]:
    """(well-formed, finding, language it parses as, likelier language).

    Findings: ok, wrong_extension, merge_conflict, truncated, corrupt, too_deep (beyond a parser's depth, so that it
    isn't known whether it is well-formed) and unjudged (a parser failed). The language it parses as is the claimed
    one or else the best ranked that accepts it. A well-formed text that also parses as a language outside its family which its tokens
    speak for more has that as the likelier one; that doesn't make it broken.
    """
    language = EXTENSIONS[extension]
    jsx = extension in ("tsx", "jsx")
    order, text = ranked(src), Text(src)
    said: dict[str, bool | None] = {}
    for one in order:
        try:
            said[one] = parses(text, one, extension == "tsx" if one == language else jsx)
        except (IndexError, KeyError):
            if one == language:
                return None, "unjudged", None, None
            said[one] = False
    own = said[language]
    accepted = [k for k in order if said[k]]
    if own is None:
        return None, "too_deep", None, None
    if own:
        family = _FAMILY.get(language, language)
        first = accepted[0] if src.strip() else language
        return True, "ok", language, first if _FAMILY.get(first, first) != family else None
    if src.strip() and accepted:
        return False, "wrong_extension", accepted[0], accepted[0]
    if _CONFLICT.search(src):
        return False, "merge_conflict", None, None
    tail = src.rstrip()
    opened = sum(map(tail.count, "([{")) - sum(map(tail.count, ")]}"))
    if opened > 0 and not src.endswith("\n") or not tail:
        return False, "truncated", None, None
    return False, "corrupt", None, None


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


SCHEMA = "repo string, path string, language string, well_formed boolean, finding string, parses_as string, likelier string"


def check_files(files: DataFrame) -> DataFrame:
    """Findings (SCHEMA) of files (repo, path, content), one row per distinct file of a supported extension.

    Null paths, null contents and other extensions (Markdown among them) have no row; empty texts are well-formed
    where the grammar allows it (not in Go and JSON); repeated rows count once, and of a path with several texts each
    is judged and the file is broken if any text is. Texts are parsed whole, however long, by all grammars; one nested
    beyond the parser's depth is `too_deep` and neither well-formed nor broken, and so is one on which a parser itself
    fails (`unjudged`); columns besides those named are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, tuple] = {}  # of a task: a digest and a finding per distinct text
        for pdf in batches:
            rows = []
            for repo, path, ext, content in zip(pdf["repo"], pdf["path"], pdf["ext"], pdf["content"]):
                key = hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=16, person=ext.encode()).digest()
                got = seen.get(key)
                if got is None:
                    got = seen[key] = verdict(content, ext)
                rows.append((repo, path, EXTENSIONS[ext], *got))
            yield pd.DataFrame(rows, columns=["repo", "path", "language", "well_formed", "finding", "parses_as", "likelier"])

    known = files.select("repo", "path", "content").withColumn("ext", extension(F.col("path"))).where(F.col("content").isNotNull() & F.col("ext").isin(*EXTENSIONS))
    out = known.mapInPandas(run, SCHEMA)
    worst = F.min(F.struct(F.coalesce("well_formed", F.lit(True)).alias("unbroken"), "well_formed", "finding", "parses_as", "language", "likelier"))
    return out.groupBy("repo", "path").agg(worst.alias("w")).select("repo", "path", "w.language", "w.well_formed", "w.finding", "w.parses_as", "w.likelier")


def rates(checked: DataFrame, files: DataFrame, analysis: DataFrame) -> DataFrame:
    """Per repository and language: files, broken ones by finding, their rate, and how many of each the index knew.

    `files` is (project_id, path, language), `analysis` (project_id, kind, samples). A file counts as warned if a
    parser_fallback warning names it, as mislabelled if the index gives it another language than its extension.
    """
    warned = analysis.where("kind = 'parser_fallback' AND samples IS NOT NULL").select(F.col("project_id").alias("repo"), F.explode("samples").alias("path")).select("repo", F.translate("path", "\\", "/").alias("path")).distinct().withColumn("warned", F.lit(True))
    said = files.where("language IS NOT NULL").groupBy(F.col("project_id").alias("repo"), F.translate("path", "\\", "/").alias("path")).agg(F.max(F.lower("language")).alias("said"))
    all_ = checked.join(warned, ["repo", "path"], "left").join(said, ["repo", "path"], "left")
    broken = ~F.col("well_formed")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    kinds = ("wrong_extension", "merge_conflict", "truncated", "corrupt", "too_deep", "unjudged")
    return all_.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"), n(broken).alias("broken"), *[n(F.col("finding") == k).alias(k) for k in kinds],
        (n(broken) / F.count(F.lit(1))).alias("broken_rate"), n(F.col("warned").isNotNull()).alias("warned"), n(broken & F.col("warned").isNotNull()).alias("broken_and_warned"),
        n(F.col("said") != F.col("language")).alias("mislabelled"), n(F.col("likelier").isNotNull() & F.col("well_formed")).alias("likelier_other"),
    )
