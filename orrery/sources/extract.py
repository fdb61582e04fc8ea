"""Symbols, imports, calls and blocks out of source texts.

Python is read by the standard parser. The other languages are read by a lexical extractor: declarations by pattern on lines
with strings and comments blanked, their ends by matching brackets. It sees nested declarations and methods, not
macros or computed names. Texts stream through `mapInPandas`; nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "project_id string, path string, name string, kind string, start_line int, end_line int, exported boolean, signature string"
REFERENCES = "project_id string, path string, kind string, target string, line int, within string"

_BLANK = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_DECL = {
    "typescript": [
        ("function", r"^[ \t]*(?P<x>export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)"), ("class", r"^[ \t]*(?P<x>export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>[\w$]+)"),
        ("type", r"^[ \t]*(?P<x>export\s+)?(?:declare\s+)?(?:interface|type|enum)\s+(?P<n>[\w$]+)"), ("variable", r"^(?P<x>export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)"),
        ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[\w$]+)\s*\([^;{}]*\)\s*(?::[^;{}=]+)?\{"),
    ],
    "go": [("function", r"^func\s+(?P<n>\w+)"), ("method", r"^func\s+\([^)]*\)\s*(?P<n>\w+)"), ("type", r"^type\s+(?P<n>\w+)")],
    "rust": [("function", r"^[ \t]*(?P<x>pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(?P<n>\w+)"), ("type", r"^[ \t]*(?P<x>pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union|type)\s+(?P<n>\w+)"), ("class", r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<n>\w+)")],
    "java": [("class", r"^[ \t]*(?P<x>public\s+)?(?:(?:abstract|final|static|private|protected|sealed)\s+)*(?:class|interface|enum|record)\s+(?P<n>\w+)"), ("method", r"^[ \t]+(?P<x>public\s+)?(?:(?:private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\],.? ]+\s+(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|new\b|return\b)\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?\{")],
}
_DECL["javascript"] = _DECL["typescript"]
_DECL = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in _DECL.items()}
_IMPORT = {
    "typescript": r"(?:from\s+|import\s*\(?\s*|require\s*\(\s*)[\"']([^\"']+)[\"']", "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
}
_IMPORT["javascript"] = _IMPORT["typescript"]
_IMPORT = {k: re.compile(v, re.M) for k, v in _IMPORT.items()}
_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return function fn func match def class new await typeof sizeof super with elif and or not in print".split())


def _blanked(text: str) -> str:
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(text: str, at: int) -> int:
    """Where the bracketed body after `at` ends; the end of the line if there is none."""
    eol = text.find("\n", at)
    eol = len(text) if eol < 0 else eol
    brace = text.find("{", at)
    stop = text.find(";", at)
    if brace < 0 or 0 <= stop < brace:
        return eol
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, brace):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def symbols_of(text: str, language: str) -> list[tuple[str, str, int, int, bool, str]]:
    """(name, kind, start_line, end_line, exported, signature) of the declarations of a text, in order."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        lines = text.split("\n")
        out = []
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                out.append((node.name, kind, node.lineno, node.end_lineno or node.lineno, not node.name.startswith("_"), lines[node.lineno - 1].strip()))
        return sorted(out, key=lambda r: (r[2], r[3]))
    if language not in _DECL:
        return []
    code = _blanked(text)
    out, seen = [], set()
    for kind, p in _DECL[language]:
        for m in p.finditer(code):
            at = m.start("n")
            if at in seen:
                continue
            seen.add(at)
            line = code.count("\n", 0, at) + 1
            end = code.count("\n", 0, max(at, _end(code, m.end("n")) - 1)) + 1
            name = m["n"]
            public = name[0].isupper() if language == "go" else bool(m.groupdict().get("x"))
            start = text.rfind("\n", 0, at) + 1
            out.append((name, kind, line, end, public, text[start : text.find("\n", at) if "\n" in text[at:] else len(text)].strip().rstrip("{").strip()))
    return sorted(out, key=lambda r: (r[2], r[3], r[0]))


def references_of(text: str, language: str) -> list[tuple[str, str, int, str | None]]:
    """(imports or calls, target, line, innermost symbol) of a text."""
    spans = symbols_of(text, language)

    def within(line: int) -> str | None:
        around = [s for s in spans if s[2] <= line <= s[3]]
        return min(around, key=lambda s: (s[3] - s[2], s[0]))[0] if around else None

    out = []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                out += [("imports", a.name, n.lineno, within(n.lineno)) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out.append(("imports", "." * n.level + (n.module or ""), n.lineno, within(n.lineno)))
            elif isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.append(("calls", name, n.lineno, within(n.lineno)))
        return sorted(out, key=lambda r: (r[2], r[0], r[1]))
    if language not in _DECL:
        return []
    for m in _IMPORT[language].finditer(text):
        out.append(("imports", m[1], text.count("\n", 0, m.start(1)) + 1, None))
    code = _blanked(text)
    names = {(s[0], s[2]) for s in spans}
    pos = line = 0
    for m in _CALL.finditer(code):
        line += code.count("\n", pos, m.start())
        pos = m.start()
        if m[1] not in _NOT_CALLS and (m[1], line + 1) not in names:
            out.append(("calls", m[1], line + 1, within(line + 1)))
    return sorted(out, key=lambda r: (r[2], r[0], r[1]))


def _over(texts: DataFrame, per_text, schema: str) -> DataFrame:
    """Rows of `per_text` for each (project_id, path, language, content); null contents give none."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, f, *r) for p, f, lang, t in zip(pdf["project_id"], pdf["path"], pdf["language"], pdf["content"]) for r in per_text(t, lang)]
            yield pd.DataFrame(rows, columns=names)

    return texts.where("content IS NOT NULL AND language IS NOT NULL").select("project_id", "path", "language", "content").mapInPandas(run, schema)


def extract_symbols(texts: DataFrame) -> DataFrame:
    return _over(texts, symbols_of, SYMBOLS)


def extract_references(texts: DataFrame) -> DataFrame:
    return _over(texts, references_of, REFERENCES)


def blocks(texts: DataFrame, size: int = 80) -> DataFrame:
    """(project_id, path, start_line, end_line, content): texts in blocks of lines, those of blanks only left out."""
    lines = F.when(F.col("content") == "", F.array().cast("array<string>")).otherwise(F.split("content", r"\r?\n"))
    t = texts.select("project_id", "path", lines.alias("l")).where(F.size("l") > 0)
    t = t.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int"))))
    body = F.slice("l", F.col("b") * size + 1, size)
    out = t.select("project_id", "path", (F.col("b") * size + 1).alias("start_line"), F.least(F.size("l"), (F.col("b") + 1) * size).alias("end_line"), F.array_join(body, "\n").alias("content"))
    return out.where(F.col("content").rlike(r"\S"))
