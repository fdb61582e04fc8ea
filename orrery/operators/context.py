"""Budgeted context: expansion choice, focus windows, snippet costs, greedy selection, packs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.paths import asks_for_support, evidence_class

LINE_BREAK = r"\r?\n"
LARGE = 80
WINDOW = 28
MAX_LINES, MAX_CHARS = 150, 8000


def lines_of(content: Column) -> Column:
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(content, LINE_BREAK))


def focus_terms(query: str) -> list[str]:
    return [p for p in re.split(r"[^a-z0-9_:-]+", query.lower()) if len(p) >= 3]


def focus_line(lines: Column, query: str) -> Column:
    """The first line (from 1) whose query terms are longest in sum; null if no line has any."""
    terms = focus_terms(query)

    def score(x: Column) -> Column:
        total = F.lit(0)
        for t in terms:
            total = total + F.when(F.contains(F.lower(x), F.lit(t)), len(t)).otherwise(0)
        return total

    scores = F.transform(lines, score)
    best = F.array_max(scores)
    return F.when(best > 0, F.array_position(scores, best).cast("int"))


def expansion(content: Column, symbol: Column, query: str, mode: str) -> Column:
    """full_body, focused_body or skeleton."""
    if re.search(r"\b(full body|full source|entire file)\b", query, re.I):
        return F.lit("full_body")
    lines = lines_of(content)
    named = F.contains(F.lit(query.lower()), F.lower(symbol)) & (symbol != "")
    focus = focus_line(lines, query).isNotNull() & (F.lit(mode in ("debug", "review")) | F.coalesce(named, F.lit(False)))
    return F.when((F.size(lines) <= LARGE) | focus, "focused_body").otherwise("skeleton")


def focus_window(content: Column, line: Column, window: int = WINDOW) -> Column:
    """The lines around a line, with dots where others are left out."""
    lines = lines_of(content)
    start = F.greatest(F.lit(0), line - 1 - window // 2)
    end = F.least(F.size(lines), start + window)
    dots = F.array(F.lit("..."))
    none = F.array().cast("array<string>")
    kept = F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))
    return F.array_join(F.concat(F.when(start > 0, dots).otherwise(none), kept, F.when(end < F.size(lines), dots).otherwise(none)), "\n")


def truncated(content: Column) -> Column:
    """A snippet within the size limits, cut after a closing brace near the line limit if there is one."""
    lines = F.split(content, LINE_BREAK)
    near = F.filter(F.sequence(F.lit(MAX_LINES - 9), F.lit(MAX_LINES + 11)), lambda i: (i <= F.size(lines)) & F.trim(F.try_element_at(lines, i)).rlike(r"^\}(;?$| )"))
    cut = F.coalesce(F.try_element_at(near, F.lit(1)), F.lit(MAX_LINES))
    return (
        F.when(F.length(content) > MAX_CHARS, F.concat(F.substring(content, 1, MAX_CHARS), F.lit("\n... [truncated: +"), (F.length(content) - MAX_CHARS).cast("string"), F.lit(" chars]")))
        .when(F.size(lines) > MAX_LINES, F.concat(F.array_join(F.slice(lines, F.lit(1), cut), "\n"), F.lit("\n... [truncated: +"), (F.size(lines) - cut).cast("string"), F.lit(" lines]")))
        .otherwise(content)
    )


def skeleton(content: Column) -> Column:
    """Declaration lines of a text, or its first line."""
    lines = lines_of(content)
    decl = r"^\s*(export\s+|public\s+|private\s+|protected\s+|pub\s+|async\s+|static\s+|abstract\s+|final\s+)*(function|class|interface|type|enum|def|fn|func|struct|trait|impl|record)\b"
    kept = F.transform(F.filter(lines, lambda x: x.rlike(decl)), lambda x: F.concat(F.regexp_replace(x, r"\s*[{:]\s*$", ""), F.lit(" ...")))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(F.concat(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), F.lit("\n...")))


def snippet_cost(*parts: Column) -> Column:
    total = F.lit(0)
    for p in parts:
        total = total + F.coalesce(F.length(p), F.lit(0))
    return (F.ceil(total * 1.3) + 200).cast("int")


def within_budget(items: DataFrame, group: list[str], order: str, cost: str, budget: int, stop: float | None = None) -> DataFrame:
    """Items of each group that fit a budget, taken greedily in order: those too large are skipped and smaller ones
    after them may fit. With `stop`, a share of the budget, items are taken up to that share and nothing after the first that goes
    beyond it; as long as nothing is taken, an item that goes beyond is taken all the same, but skipped if it exceeds the whole
    budget and the group has others.

    The groups are ranked lists that a limit has cut to size before, so that one array holds a group.
    """
    listed = items.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).alias("c")))).alias("x"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("took"), F.lit(False).alias("ended"))

    def step(acc: Column, x: Column) -> Column:
        fits, none = acc["used"] + x["c"] <= budget, F.size(acc["took"]) == 0
        if stop is not None:
            fits = ~acc["ended"] & ((acc["used"] + x["c"] <= F.lit(budget * stop)) | none & ~((F.size("x") > 1) & (x["c"] > budget)))
        return F.struct(
            F.when(fits, acc["used"] + x["c"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["took"], F.array(x["o"].cast("int")))).otherwise(acc["took"]).alias("took"),
            (acc["ended"] | ~fits & ~none).alias("ended"),
        )

    took = listed.select(*group, F.explode(F.aggregate("x", zero, step)["took"]).alias(order))
    return items.join(took, [*group, order], "left_semi")


def diverse(hits: DataFrame, group: list[str], order: str, cost: str, budget: int, query: str) -> DataFrame:
    """Ranked hits chosen within a budget: first one of each file, then up to three of code files and fewer of others."""
    most = F.when(evidence_class(F.col("file_path")) == "implementation", 3).otherwise(2 if asks_for_support(query) else 1)
    rank = F.row_number().over(Window.partitionBy(*group, "file_path").orderBy(order))
    turn = hits.withColumn("_r", rank).withColumn("_most", most).where("_r <= _most")
    w = Window.partitionBy(*group).orderBy(F.when(F.col("_r") == 1, 0).otherwise(1), order)
    return within_budget(turn.withColumn("_turn", F.row_number().over(w)), group, "_turn", cost, budget).drop("_r", "_most", "_turn")


def owner_chain(snippets: DataFrame, group: list[str]) -> DataFrame:
    """Files of the chosen snippets with their summed scores, the shortest reason and the distinct symbols."""
    why = F.min(F.struct(F.length("reason").alias("n"), "reason")).alias("w")
    return snippets.groupBy(*group, "file_path").agg(F.sum("score").alias("score"), why, F.array_sort(F.collect_set("symbol_name")).alias("symbols")).select(*group, "file_path", "score", "w.reason", "symbols")


def pack_confidence(snippets: DataFrame, group: list[str]) -> DataFrame:
    a = snippets.groupBy(*group).agg(F.count(F.lit(1)).alias("snippets"), F.max("score").alias("top"))
    return a.select(*group, "snippets", F.when((F.col("snippets") >= 3) & (F.col("top") > 1), "high").otherwise("medium").alias("confidence"))


def as_markdown(row: Column, title: Column, snippets: Column) -> Column:
    """A pack as text: `snippets` is an array of (file_path, start_line, end_line, reason, content)."""
    part = F.transform(snippets, lambda s: F.concat(F.lit("### "), s["file_path"], F.lit(":"), s["start_line"].cast("string"), F.lit("-"), s["end_line"].cast("string"), F.lit("\n"), s["reason"], F.lit("\n```\n"), s["content"], F.lit("\n```")))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce(row, F.lit("")), F.lit("\n\n"), F.array_join(part, "\n\n"))
