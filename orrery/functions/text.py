"""Tokens, identifiers, term matching and text scores, as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.stemming import stem

#: The runs that an identifier is made of: an acronym up to the word after it, a word with its capitals, capitals alone.
_RUN = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]*[a-z0-9]+|[A-Z]+"
#: A word of a query, the signs that make it a path or a qualified name, and the change of case that makes it several words.
_WORD = r"[A-Za-z0-9_./:-]+"
_QUALIFIED = r"[._/:-]"
_SEVERAL = r"[a-z0-9][A-Z]|[A-Z]{2}[a-z]"


def split_identifier(c: Column) -> Column:
    """Lower-case parts of an identifier: it is cut at case changes and at everything that is neither letter nor digit."""
    return F.transform(F.regexp_extract_all(c, F.lit(_RUN), F.lit(0)), F.lower)


def normalize_identifier(c: Column) -> Column:
    return F.array_join(split_identifier(c), "")


def tokens(c: Column) -> Column:
    """Distinct query tokens in order; identifiers in camel case add their parts."""
    words = F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))
    parts = lambda x: F.when(x.rlike(_SEVERAL) & ~x.rlike(_QUALIFIED), split_identifier(x)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(words, lambda x: F.array_prepend(parts(x), F.lower(x)))))


def py_split_identifier(text: str) -> list[str]:
    """`split_identifier` on the driver."""
    return [run.lower() for run in re.findall(_RUN, text)]


def py_tokens(query: str) -> list[str]:
    """`tokens` on the driver."""
    found = []
    for word in re.findall(_WORD, query):
        found.append(word.lower())
        if re.search(_SEVERAL, word) and not re.search(_QUALIFIED, word):
            found += py_split_identifier(word)
    return list(dict.fromkeys(found))


def py_words(query: str) -> list[str]:
    """The distinct words of a query as a full-text index knows them: runs of letters and digits in lower case."""
    return list(dict.fromkeys(w.lower() for w in re.findall(r"[^\W_]+", query)))


def variants(terms: list[str]) -> list[str]:
    """The terms and, for those of letters only, their stems."""
    out: dict[str, None] = {}
    for t in terms:
        out[t] = None
        if re.fullmatch(r"[a-z]+", t, re.I):
            out[stem(t.lower())] = None
    return list(out)


def plural(word: str) -> str:
    """The pattern of a word in either number."""
    return f"{word[:-1]}(?:y|ies)" if word.endswith("y") else f"{word}(?:e?s)?"


def term_pattern(term: str) -> str | None:
    """The pattern that finds a term as a whole token, singular or plural; None if it is searched as it stands."""
    low = term.lower()
    return rf"(?:^|[^a-z0-9]){plural(low)}(?:[^a-z0-9]|$)" if low.isascii() and low.isalnum() else None


def contains_term(text: Column, term: str) -> Column:
    """Whether lower-case text holds a term; the empty one is in none."""
    if not term:
        return F.lit(False)
    pattern = term_pattern(term)
    return text.rlike(pattern) if pattern else F.contains(text, F.lit(term.lower()))


def contains_any_variant(text: Column, term: str) -> Column:
    out = None
    for v in variants([term]):
        out = contains_term(text, v) if out is None else out | contains_term(text, v)
    return out


def searchable(*parts: Column) -> Column:
    """Lower-case text of the non-empty parts, followed by its identifier parts."""
    raw = F.concat_ws("\n", *[F.when(p != "", p) for p in parts])
    return F.concat_ws("\n", F.lower(raw), F.array_join(split_identifier(raw), " "))


def count_true(conditions: list[Column]) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c, F.lit(False)).cast("int")
    return total


@dataclass
class Profile:
    """A query made ready for matching: its terms, and symbol names that it expands to."""

    query: str
    terms: list[str]
    names: list[str] = field(default_factory=list)

    @property
    def term_variants(self) -> list[str]:
        return variants(self.terms)

    @property
    def expanded(self) -> list[str]:
        return list(dict.fromkeys(x for x in ("".join(py_split_identifier(n)) for n in self.names) if x))


def symbol_coverage(parts: Column, stems: Column, profile: Profile) -> Column:
    """Share of an identifier's parts (with their stems, in step) that the query names; null below two parts or two matches."""
    wanted = F.array(*[F.lit(v) for v in profile.term_variants]) if profile.terms else F.array().cast("array<string>")
    hit = F.zip_with(parts, stems, lambda p, s: (F.array_contains(wanted, p) | F.array_contains(wanted, s)).cast("int"))
    n = F.aggregate(hit, F.lit(0), lambda a, x: a + x)
    return F.when((F.size(parts) >= 2) & (n >= 2), n / F.size(parts))


def chunk_score(text: Column, coverage: Column, profile: Profile) -> Column:
    """Query coverage + min(0.45, 0.15 per expanded term) + 0.85 symbol coverage; null if nothing matched."""
    n = count_true([contains_any_variant(text, t) for t in profile.terms])
    e = count_true([contains_term(text, t) for t in profile.expanded])
    score = n / F.lit(float(max(1, len(profile.terms)))) + F.least(F.lit(0.45), e * 0.15) + 0.85 * F.coalesce(coverage, F.lit(0.0))
    return F.when((n > 0) | (e > 0) | coverage.isNotNull(), score)


def symbol_score(text: Column, coverage: Column, profile: Profile) -> Column:
    """Query coverage + 1.2 symbol coverage + min(0.4, 0.15 per expanded term); null if nothing matched."""
    n = count_true([contains_any_variant(text, t) for t in profile.terms])
    e = count_true([contains_term(text, t) for t in profile.expanded])
    score = n / F.lit(float(max(1, len(profile.terms)))) + 1.2 * F.coalesce(coverage, F.lit(0.0)) + F.least(F.lit(0.4), e * 0.15)
    return F.when((n > 0) | (e > 0) | coverage.isNotNull(), score)


#: Words that speak for a mode; the first mode with most of them wins (fixed values).
MODE_WORDS = {
    "debug": ["error", "bug", "fail", "failure", "stack", "trace", "exception", "crash", "log", "fix"],
    "feature": ["add", "create", "implement", "feature", "ui", "api", "route", "flow"],
    "refactor": ["refactor", "cleanup", "rename", "move", "simplify", "replace", "migrate"],
    "review": ["review", "diff", "risk", "regression", "test", "pr"],
    "explain": ["explain", "how", "why", "architecture", "overview", "onboard", "understand"],
}
#: Words whose presence in a hit raises it in a mode, and by how much (fixed values).
MODE_BOOSTS = {
    "debug": (0.35, ["error", "catch", "throw", "log", "trace", "exception"]),
    "feature": (0.3, ["route", "handler", "component", "service", "controller", "store"]),
    "refactor": (0.25, ["export", "interface", "type", "class", "function"]),
    "review": (0.3, ["test", "spec", "assert", "expect", "mock"]),
    "explain": (0.2, ["readme", "architecture", "index", "main", "server"]),
}


def resolve_mode(query: str, explicit: str | None = None) -> str:
    if explicit and explicit != "auto":
        return explicit
    words = set(re.split(r"[^a-z0-9]+", query.lower())) - {""}
    best = max(MODE_WORDS, key=lambda m: sum(w in words for w in MODE_WORDS[m]))  # max keeps the first of equals
    return best if any(w in words for w in MODE_WORDS[best]) else "explain"


def mode_boost(text: Column, evidence: Column, mode: str, query: str) -> Column:
    """The change of a score by mode: `text` is the hit in lower case, `evidence` the class of its path."""
    from orrery.functions.paths import asks_for_support

    amount, needles = MODE_BOOSTS[mode]
    named = None
    for w in needles:
        named = F.contains(text, F.lit(w)) if named is None else named | F.contains(text, F.lit(w))
    boost = F.when(named, amount).otherwise(0.0)
    if mode in ("feature", "refactor", "explain") and not asks_for_support(query):
        boost = boost + F.when(evidence == "implementation", 0.25).when(evidence == "test", -0.65).otherwise(-0.55)
    return boost


def next_queries(query: str, mode: str) -> list[str]:
    """Follow-up questions by mode (fixed wording)."""
    return {
        "debug": [f"owner chain for {query}", f"related tests for {query}", f"error handling around {query}"],
        "feature": [f"entry points for {query}", f"state and API owners for {query}", f"tests for {query}"],
        "refactor": [f"callers of {query}", f"impact analysis for {query}", f"public exports for {query}"],
        "review": ["changed files impact", "related tests", "risk hotspots"],
    }.get(mode, [f"module overview for {query}", f"key symbols for {query}", f"main execution flow for {query}"])


def _specific(word: str) -> bool:
    """Whether a word of a query names one thing: a path or qualified name of eight signs, or a compound or capitalised word of five."""
    if re.search(_QUALIFIED, word):
        return len(word) >= 8
    return len(word) >= 5 and (word.lower() != word or len(py_split_identifier(word)) > 1)


def exact_identifiers(query: str) -> list[str]:
    """Identifiers of a query that are specific enough to be looked up as they stand."""
    return list(dict.fromkeys(word.lower() for word in re.findall(_WORD, query) if _specific(word)))


#: Requests that bring further terms with them (fixed values).
REUSE_TERMS = {
    r"rate[-\s]?limit|limiting|throttle": ["rate", "limit", "limiter", "throttle", "throttlerequest", "token", "bucket", "tokenbucket"],
    r"payment|billing|checkout": ["payment", "billing", "checkout", "charge", "invoice"],
    r"auth|login|session": ["auth", "login", "session", "user"],
}


def reuse_terms(query: str) -> list[str]:
    """Words of a request, and the terms that its topics bring."""
    q = query.lower()
    words = [w for w in re.split(r"[^a-z0-9_]+", q) if w]
    return list(dict.fromkeys([*words, *(t for p, ts in REUSE_TERMS.items() if re.search(p, q) for t in ts)]))
