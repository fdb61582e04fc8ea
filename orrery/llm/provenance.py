"""Generated, minified, vendored source files and data saved as code.

An Aho-Corasick automaton over lower-cased text finds the phrases that notices are made of, anywhere in a file; only
where it hits are the comments taken apart and the notices read, so that a string or a sentence about generated files
proves nothing. Path rules cover names of tool output and folders of outside code; shape rules cover minified
text and data literals; and equal texts in several projects are found by their fingerprints, of which only
(repo, path, fingerprint) is shuffled, never the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.syntax import EXTENSIONS, extension, parses
from orrery.session import cut

CODE = {e: lang for e, lang in EXTENSIONS.items() if lang != "json"}

#: Phrases of notices; a file without any of them holds no notice.
GENERATED_PHRASES = (
    "generated", "do not edit", "do not modify", "do not change", "automatically", "ne pas modifier", "ne pas éditer", "produit par", "généré",
    "erzeugt", "generiert", "nicht bearbeiten", "nicht ändern", "generado", "no editar", "no modificar", "regenerate", "will be overwritten", "machine-written",
)
THIRD_PARTY_PHRASES = ("copyright", "(c)", "license", "licence", "part of the", "taken ", "copied ", "vendored", "upstream", "://", "spdx", "adapted from", "distribution")

#: Notices of tool output, read in one comment line or block at a time.
GENERATED = re.compile(
    r"""\bcode\ generated\ by\b.{0,200}?\bdo\ not\ edit
    |(?<![\w.])@generated\b
    |<auto-?generated
    |^\W*auto-?generated\b
    |^\W*(?:this\ (?:file|module|code|class|source)\ (?:is|was|has\ been)\ )?(?:automatically\ |auto-?)?generated\ (?:automatically|by|from|with|using)\b
    |\bthis\ (?:file|module|code|class|source)\ (?:is|was|has\ been)\ (?:(?:produced|generated|created|written|built)\ automatically|automatically\ (?:produced|generated|created|written|built)|machine-written)
    |\b(?:manual|hand|local)\ (?:changes|edits)\ (?:will\ be|are)\ (?:overwritten|lost)
    |\bdo\ not\ (?:edit|modify|change)\ this\ (?:file|module)\b.{0,80}?(?:by\ hand|manually|generat|directly)
    |\b(?:produit|généré|genere|créé)\ (?:automatiquement|par)\b.{0,200}?\bne\ pas\ (?:modifier|éditer|editer)
    |\b(?:automatisch|maschinell)\ (?:erzeugt|generiert|erstellt)|\b(?:erzeugt|generiert)\ (?:von|durch|aus)\b.{0,200}?\bnicht\ (?:von\ hand\ )?(?:bearbeiten|ändern|editieren)
    |\bgenerado\ (?:automáticamente|por)\b.{0,200}?\bno\ (?:editar|modificar)""",
    re.X,
)
#: Notices of another package; group 1 is its name.
_NAME = r"([a-z0-9@][\w@./+-]*)"
THIRD_PARTY = (
    re.compile(rf"\bpart of (?:the )?{_NAME} (?:library|package|project|distribution|framework)\b"),
    re.compile(rf"\b(?:taken|copied|vendored|imported)(?: unchanged| verbatim| unmodified)? from {_NAME},? v?\d+\.\d+"),
    re.compile(rf"\b(?:copyright )?(?:\(c\)|©|copyright)(?: \d{{4}}(?:\s*[-,]\s*\d{{4}})*)? (?:by )?(?:the )?{_NAME} (?:contributors|authors|developers|maintainers|project|team|foundation)\b"),
    re.compile(rf"^\W*(?:@preserve )?{_NAME} v?\d+\.\d+(?:\.\d+)?\b.{{0,20}}?https?://"),
    re.compile(rf"^\W*(?:@preserve )?{_NAME} v?\d+\.\d+(?:\.\d+)?\b.{{0,300}}?(?:\(c\)|@license|licensed|released under)", re.S),
)
UPSTREAM = re.compile(r"\bsee the licen[sc]e file of the upstream distribution\b|\bupstream licen[sc]e applies\b")

TOOL_NAME = re.compile(r"(?:\.(?:generated|g|designer|pb|pb2|gen)\.[a-z]+|_(?:pb|pb2|pb2_grpc|grpc_pb|generated)\.[a-z]+|\.pb\.(?:go|rs|cc|h)|^zz_generated\.[\w.]+)$", re.I)
MIN_NAME = re.compile(r"(?:[.-]min|\.bundle|[.-]prod\.min)\.(?:js|mjs|jsx)$", re.I)
PACKAGE_FOLDER = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|\.yarn/cache|\.cargo/registry|pkg/mod|Pods)/")
LABELLED_FOLDER = re.compile(r"(?:^|/)(?:vendor(?:ed)?|third[_-]?party|extern(?:al|als)?)/(?:[^/]+/)*?[\w.+-]*[A-Za-z][\w.+-]*(?:@|-|/|_|==)v?\d+\.\d+[\w.+-]*/")

_COMMENTS = {
    "python": re.compile(r"(?P<s>[rbuf]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'))|#(?P<c>[^\n]*)", re.I),
    "rust": re.compile(r"(?P<s>b?r(#*)\"[\s\S]*?\"\2|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.[^'\n]*)')|//(?P<c>[^\n]*)|/\*(?P<b>[\s\S]*?)\*/"),
    "": re.compile(r"(?P<s>\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`)|//(?P<c>[^\n]*)|/\*(?P<b>[\s\S]*?)\*/"),
}
_DATA = re.compile(  # a run begins after a bracket, which spares trying it at every letter
    r"""(?<=[\[({])\s*(?>(?:-?(?:0[xX][0-9a-fA-F_]+|\d[\w.]*(?:[eE][+-]?\d+)?)|b?"(?:[^"\\\n]|\\.)*"|b?'(?:[^'\\\n]|\\.)*'|\b(?:true|false|null|None|True|False|nil|undefined)\b|[A-Za-z_]\w*\s*(?=:))\s*[,:;]?\s*|[\[\]{}(),:+]\s*){8,}"""
)
_BUNDLE = re.compile(r"__webpack_require__\s*\(|^/\*{6}/ |^//# sourceMappingURL=|^\(\(\)\s*=>\s*\{\s*var __m=|^System\.register\(", re.M)


def comments(text: str, language: str) -> list[str]:
    """Comments in lower case without their markers: each line, and each run of adjacent lines as one."""
    out: list[str] = []
    run: list[str] = []
    last = -2
    pos = line = 0
    for m in _COMMENTS.get(language, _COMMENTS[""]).finditer(text):
        if m["s"] is not None:
            continue
        block = m.groupdict().get("b")
        line += text.count("\n", pos, m.start())
        pos = m.start()
        rows = [m["c"]] if block is None else block.split("\n")
        rows = [re.sub(r"^[\s*!/#;-]+|[\s*/]+$", "", r.replace("\r", "")).lower() for r in rows]
        out += rows
        if block is not None or line != last + 1:
            if run:
                out.append(" ".join(run))
            run = []
        run += rows
        last = line
        if block is not None:
            out.append(" ".join(run))
            run = []
            last = -2
    if run:
        out.append(" ".join(run))
    return [re.sub(r"\s+", " ", x) for x in out if x]


def notices(text: str, language: str, own: set[str], generated: bool, foreign: bool) -> str | None:
    """generated or third_party, if a comment says so. Names in `own` are the project's."""
    said = comments(text, language)
    if generated and any(GENERATED.search(x) for x in said):
        return "generated"
    if foreign:
        for x in said:
            if UPSTREAM.search(x):
                return "third_party"
            for p in THIRD_PARTY:
                m = p.search(x)
                if m and m[1].strip("./").lower() not in own and m[1] not in ("the", "this", "our", "a", "an"):
                    return "third_party"
    return None


def minified(text: str, language: str) -> bool:
    """Script text with its blanks squeezed out, or a bundler's wrapper."""
    if language not in ("javascript", "typescript"):
        return False
    if _BUNDLE.search(text):
        return True
    if len(text) < 300:
        return False
    code = _COMMENTS[""].sub(lambda m: '""' if m["s"] is not None else "", text)
    blank = sum(map(code.count, " \t\n\r"))
    lines = code.count("\n") + 1
    return len(code) > 200 and blank < 0.1 * len(code) and len(code) / lines > 100


def data_share(text: str) -> float:
    """The share of a text in runs of eight or more literals and brackets."""
    return sum(m.end() - m.start() for m in _DATA.finditer(text)) / max(1, len(text))


class Classifier:
    """Reasons by path, notice and shape."""

    def __init__(self):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for i, phrases in enumerate((GENERATED_PHRASES, THIRD_PARTY_PHRASES)):
            for p in phrases:
                self.auto.add_word(p, i)
        self.auto.make_automaton()

    def reason(self, path: str, text: str, language: str, own: set[str]) -> str | None:
        """generated, minified, third_party or data, in this order; None: written by hand as far as the file shows."""
        path = path.replace("\\", "/")
        base = path.rsplit("/", 1)[-1]
        if TOOL_NAME.search(base):
            return "generated"
        hits = {i for _, i in self.auto.iter(text.lower())}
        said = notices(text, language, own, 0 in hits, 1 in hits) if hits else None
        if said == "generated":
            return said
        if MIN_NAME.search(base) or minified(text, language):
            return "minified"
        if said or PACKAGE_FOLDER.search(path) or LABELLED_FOLDER.search(path):
            return "third_party"
        if data_share(text) > 0.5:
            return "data"
        return None


SCHEMA = "repo string, path string, language string, size long, key binary, reason string, well_formed boolean"


def classify_files(files: DataFrame, projects: DataFrame, copies: int = 3, copy_chars: int = 400) -> DataFrame:
    """(repo, path, language, reason, well_formed) of files (repo, path, content) in the six programming languages.

    `reason` is null for hand-written files; `well_formed` is set where there is a reason. `projects` is (project_id,
    display_name, repo_root), whose names are the own ones. A text of `copy_chars` or more in `copies` or more repositories is
    third_party if nothing else holds. Null paths and contents, JSON and Markdown have no row; repeated rows count
    once; of several texts of a path the first reason in alphabetic order holds; empty files are hand-written.
    """
    names = projects.groupBy("project_id").agg(F.max("display_name").alias("n1"), F.max(F.regexp_extract("repo_root", r"([^/\\]+)[/\\]*$", 1)).alias("n2"))
    known = files.select("repo", "path", "content").withColumn("ext", extension(F.col("path"))).where(F.col("content").isNotNull() & F.col("ext").isin(*CODE))
    named = known.join(names, known["repo"] == names["project_id"], "left").select("repo", "path", "ext", "content", "n1", "n2", F.unhex(F.sha2("content", 256)).alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Classifier()
        for pdf in batches:
            rows = []
            for repo, path, ext, text, n1, n2, key in pdf.itertuples(index=False):
                own = {n.lower() for n in (n1, n2) if n}
                why = c.reason(path, text, CODE[ext], own)
                rows.append((repo, path, CODE[ext], len(text), key, why, parses(text, CODE[ext], ext == "tsx") is not False if why else None))
            yield pd.DataFrame(rows, columns=["repo", "path", "language", "size", "key", "reason", "well_formed"])

    facts = cut(named.mapInPandas(run, SCHEMA).distinct())
    wide = facts.where(F.col("size") >= copy_chars).select("key", "repo").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("repos")).where(F.col("repos") >= copies).select("key")
    open_ = facts.where("reason IS NULL").join(wide, "key", "left_semi").select("repo", "path", "key")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "ext": pdf["ext"], "fine": [parses(t, CODE[e], e == "tsx") is not False for e, t in zip(pdf["ext"], pdf["content"])]})

    # one text of each copied fingerprint and extension is read again and parsed
    one = open_.withColumn("ext", extension(F.col("path"))).groupBy("key", "ext").agg(F.min(F.struct("repo", "path")).alias("f")).select("key", "ext", "f.repo", "f.path")
    texts = known.select("repo", "path", "content").join(one, ["repo", "path"]).where(F.unhex(F.sha2("content", 256)) == F.col("key"))
    judged = texts.select("key", "ext", "content").mapInPandas(parse, "key binary, ext string, fine boolean").groupBy("key", "ext").agg(F.min("fine").alias("fine"))
    copied = open_.withColumn("ext", extension(F.col("path"))).join(judged, ["key", "ext"]).select("repo", "path", "key", F.lit("third_party").alias("copied"), "fine")
    out = facts.join(copied, ["repo", "path", "key"], "left").select("repo", "path", "language", F.coalesce("reason", "copied").alias("reason"), F.coalesce("well_formed", "fine").alias("well_formed"))
    first = F.min_by(F.struct("language", "reason", "well_formed"), F.when(F.col("reason").isNotNull(), F.concat(F.when(F.col("well_formed"), "0").otherwise("1"), F.col("reason"))).otherwise("2"))
    return out.groupBy("repo", "path").agg(first.alias("x")).select("repo", "path", "x.language", "x.reason", "x.well_formed")


def hints(classified: DataFrame, files: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per repository, language and class: files, bytes the index noted, and how many the index's role or skip reason also set apart."""
    role = files.groupBy(F.col("project_id").alias("repo"), F.translate("path", "\\", "/").alias("path")).agg(F.max_by("role", "generation").alias("role"), F.max_by("size_bytes", "generation").alias("size_bytes"))
    why = skipped.where("project_id IS NOT NULL").groupBy(F.col("project_id").alias("repo"), F.translate("file_path", "\\", "/").alias("path")).agg(F.max("reason").alias("skip"))
    x = classified.join(role, ["repo", "path"], "left").join(why, ["repo", "path"], "left")
    kind = F.when(~F.col("well_formed"), "broken").otherwise(F.coalesce("reason", F.lit("hand_written")))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return x.groupBy("repo", "language", kind.alias("class")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), n(F.col("role").isin("generated", "minified", "vendor", "build")).alias("role_set_apart"), n(F.col("skip").isNotNull()).alias("skipped")
    )
