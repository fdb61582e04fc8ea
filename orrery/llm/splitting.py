"""Splitting oversized items at natural boundaries.

An item is a run of lines. Each of its lines is written as one letter, the strength of the boundary after it, and a
regular expression with bounded quantifiers cuts that string: its alternatives are ordered by strength and consume
up to the limit, the last one cuts after any line. Pieces after the first look back over the lines they share with their
neighbour, so that a piece with its overlap stays within the limit. All of it is built-in SQL functions.

Strengths: A after a blank line, or a closing bracket in the first column; B after a line of closing brackets; C after a
line that ends a statement or block; D elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|\n|\r"


def strengths(lines: Column) -> Column:
    """The letters of an array of lines, as one string."""
    letter = lambda x: (
        F.when(x.rlike(r"^\s*$") | x.rlike(r"^[\])}]+[;,]?\s*$"), "A")
        .when(x.rlike(r"^\s+[\])}]+[;,]?\s*$"), "B")
        .when(x.rlike(r"[;}]\s*$|^\s*(return|pass|break|continue)\b"), "C")
        .otherwise("D")
    )
    return F.array_join(F.transform(lines, letter), "")


def cutter(limit: Column, overlap: Column) -> Column:
    """The expression that cuts a string of strengths. A natural boundary is taken in the upper
    half of the room only, and the first piece holds at least the lines that it shares."""
    lim, step = limit.cast("string"), (limit - overlap)

    def by(start: str, room: Column, least: Column) -> Column:
        low, high = F.greatest(F.lit(0), F.floor(room / 2).cast("int") - 1, least - 1).cast("string"), (room - 1).cast("string")
        return F.concat_ws("|", *[F.concat(F.lit(start + ".{"), low, F.lit(","), high, F.lit("}" + s)) for s in "ABC"])

    st = step.cast("string")
    return F.concat(
        by("^", limit, overlap), F.lit("|^.{1,"), lim, F.lit("}|.{1,"), st, F.lit("}$|"),
        by("", step, F.lit(0)), F.lit("|.{1,"), st, F.lit("}"),
    )


def split_items(items: DataFrame, texts: DataFrame, default_limit: int = 80) -> DataFrame:
    """Pieces (scope, id, piece, first_line, last_line, overlap, boundary, text) of every oversized item.

    `items` is (scope, id, path, start_line, end_line, limit, overlap), `texts` (scope, path, content). An item is
    oversized if end_line - start_line + 1 > limit, by its line numbers alone; null numbers make it none. A null limit
    stands for `default_limit`, a limit under 1 for 1; a null or negative overlap for 0, and one that fills the limit
    for the limit - 1. Pieces cover the lines that the text has, in order, `overlap` lines shared with the piece
    before. An item without text, or whose first line lies outside it, is one piece of boundary `unlocated`; one that fits once its
    lines are clipped to the text is one piece of boundary `whole`. Repeated rows count once (of several texts of a
    path the greatest is taken); columns besides those named are ignored.
    """
    big = (
        items.select("scope", "id", "path", F.col("start_line").cast("long").alias("s"), F.col("end_line").cast("long").alias("e"), F.greatest(F.coalesce("limit", F.lit(default_limit)), F.lit(1)).cast("int").alias("t"), F.greatest(F.coalesce("overlap", F.lit(0)), F.lit(0)).cast("int").alias("o"))
        .where(F.col("e") - F.col("s") + 1 > F.col("t"))
        .withColumn("o", F.least("o", F.col("t") - 1))
        .distinct()
    )
    wanted = big.select("scope", "path").where("path IS NOT NULL").distinct()
    text = texts.select("scope", "path", "content").join(wanted, ["scope", "path"], "left_semi").groupBy("scope", "path").agg(F.max("content").alias("content"))
    own = F.slice(F.split("content", LINE_BREAK), F.greatest(F.col("s"), F.lit(1)).cast("int"), F.least(F.col("e") - F.greatest(F.col("s"), F.lit(1)) + 1, F.lit(2**31 - 1)).cast("int"))
    placed = big.join(text, ["scope", "path"], "left").withColumn("lines", F.when(F.col("content").isNotNull() & (F.col("e") >= 1), own)).drop("content")
    cut = placed.withColumn("cuts", F.when(F.size("lines") > F.col("t"), F.regexp_extract_all(strengths(F.col("lines")), cutter(F.col("t"), F.col("o")), F.lit(0))))
    rows = cut.select("scope", "id", "path", "s", "e", "t", "o", "lines", F.posexplode_outer("cuts").alias("piece", "letters"))
    key = Window.partitionBy("scope", "id", "path", "s", "e", "t", "o").orderBy("piece")
    after = F.sum(F.length("letters")).over(key.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("to", after).withColumn("back", F.when(F.col("piece") > 0, F.col("o")).otherwise(0))
    rows = rows.withColumn("from", F.col("to") - F.length("letters") - F.col("back") + 1)
    line0 = F.greatest(F.col("s"), F.lit(1)) - 1
    done = F.col("piece").isNotNull()
    located = F.coalesce(F.size("lines") > 0, F.lit(False))
    return rows.select(
        "scope", "id",
        F.coalesce("piece", F.lit(0)).alias("piece"),
        F.when(done, line0 + F.col("from")).otherwise(F.col("s")).alias("first_line"),
        F.when(done, line0 + F.col("to")).when(located, line0 + F.size("lines")).otherwise(F.col("e")).alias("last_line"),
        F.when(done, F.col("back")).otherwise(0).alias("overlap"),
        F.when(done, F.substring("letters", -1, 1)).when(located, "whole").otherwise("unlocated").alias("boundary"),
        F.when(done, F.array_join(F.slice("lines", F.col("from").cast("int"), (F.col("to") - F.col("from") + 1).cast("int")), "\n")).when(located, F.array_join("lines", "\n")).alias("text"),
    )
