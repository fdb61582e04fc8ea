"""Evaluation texts leaking into training text.

Pigeonhole edit matching over words. A passage of `window` words that survives with at most `errors` edited words
keeps, of the error-budget-plus-one pieces it falls into, at least one untouched. Test items are therefore cut into
consecutive pieces so short that every passage holds errors + 1 of them whole; an Aho-Corasick automaton finds
all exact piece hits in one pass over a document's words; each hit is extended to the full run of equal words; and runs
that are long enough to belong to a passage within the budget, yet shorter than a passage, are verified by Myers'
bit-parallel edit distance. Documents stream through the workers once and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Items of a broadcast block; more items take further passes over the documents, never a larger broadcast.
BLOCK = 20_000


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters or digits, lower-cased."""
    return [w.lower() for w in WORD.findall(text)]


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance (in words) of `pattern` to any substring of `text`, bit-parallel over the pattern."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & mask  # a match may start anywhere, hence no carry-in
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        best = min(best, score)
    return best


class Matcher:
    """Finds the items of a block in a text."""

    def __init__(self, items: list[tuple[int, str]], window: int, errors: int):
        import ahocorasick

        self.window, self.errors = window, errors
        self.piece = max(1, (window + 1) // (errors + 2))
        self.least = -(-(window - errors) // (errors + 1))  # some run of a passage within the budget is this long
        self.items = {k: words(t) for k, t in items}
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, w in self.items.items():
            if len(w) >= window:
                for i in range(0, len(w) - self.piece + 1, self.piece):
                    at[" " + " ".join(w[i : i + self.piece]) + " "].append((k, i))
        self.auto = ahocorasick.Automaton()
        for p, where in at.items():
            self.auto.add_word(p, where)
        if at:
            self.auto.make_automaton()
        self.empty = not at

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, fewest errors of a passage, words of the longest exact run) for each item found."""
        if self.empty or not text:
            return []
        line = " " + " ".join(WORD.findall(text)).lower() + " "
        hits = list(self.auto.iter(line))
        if not hits:
            return []
        doc = line.split()
        found: dict[int, list[int]] = {}
        covered: dict[tuple[int, int], int] = {}  # of (item, diagonal): the words of the document already looked at
        count, pos = 0, 0
        for end, where in hits:
            count += line.count(" ", pos, end)  # words before the blank that ends the hit
            pos = end
            start = count - self.piece
            for k, i in where:
                diagonal = start - i
                if covered.get((k, diagonal), 0) > start:
                    continue
                item = self.items[k]
                a, b = start, start + self.piece
                while a > 0 and a - diagonal > 0 and doc[a - 1] == item[a - 1 - diagonal]:
                    a -= 1
                while b < len(doc) and b - diagonal < len(item) and doc[b] == item[b - diagonal]:
                    b += 1
                covered[(k, diagonal)] = b
                run = b - a
                best = found.get(k)
                if run >= self.window:
                    errors = 0
                elif run < self.least or (best and best[0] == 0):
                    continue
                else:
                    errors = self._verify(item, doc, a - diagonal, a, run)
                    if errors > self.errors:
                        continue
                if best is None:
                    found[k] = [errors, run]
                else:
                    best[0], best[1] = min(best[0], errors), max(best[1], run)
        return [(k, e, r) for k, (e, r) in found.items()]

    def _verify(self, item: list[str], doc: list[str], i: int, a: int, run: int) -> int:
        """Fewest errors of a passage of the item that overlaps the run of `run` equal words at item[i], doc[a]."""
        w, best = self.window, self.window
        text = doc[max(0, a - w - self.errors) : a + run + w + self.errors]
        for s in range(max(0, i + self.least - w), min(len(item) - w, i + run - self.least) + 1):
            best = min(best, myers(item[s : s + w], text))
            if best == 0:
                break
        return best


def leaks(documents: DataFrame, items: DataFrame, window: int = 13, errors: int = 1, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, errors, run): the items of which a document holds a passage of `window` words within `errors` word edits.

    `errors` of the result is the fewest edits of a passage, `run` the longest run of equal words seen. Words are
    runs of letters or digits in lower case, so that layout and punctuation don't matter. Null and blank texts hold
    nothing; items of fewer words than a passage leak nothing; repeated rows of either side count once; empty tables
    give an empty result; texts are scanned whole. Items reach the workers in blocks of at most `block`.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    schema = "doc_id long, item_id long, errors int, run int"
    out = None
    part: list[tuple[int, str]] = []

    def scan(chunk: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(chunk)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Matcher(shared.value, window, errors)
            for pdf in batches:
                got = [(d, *x) for d, t in zip(pdf["doc_id"], pdf["text"]) for x in m.find(t)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "errors", "run"]).astype({"doc_id": "int64", "item_id": "int64", "errors": "int32", "run": "int32"})

        return docs.mapInPandas(run, schema)

    for r in rows.toLocalIterator():
        part.append((r["item_id"], r["text"]))
        if len(part) == block:
            out = scan(part) if out is None else out.unionByName(scan(part))
            part = []
    if part or out is None:
        out = scan(part) if out is None else out.unionByName(scan(part))
    return out.groupBy("doc_id", "item_id").agg(F.min("errors").alias("errors"), F.max("run").alias("run"))
