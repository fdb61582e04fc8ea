"""Embeddings and similarities as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """The first 24 hex digits of the hash of the non-null parts."""
    return F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 24)


def dot(a: Column, b: Column) -> Column:
    z = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(F.filter(z, lambda x: x.isNotNull()), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter width; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a of the characters of an ASCII word, as a long."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def words_for_embedding(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda x: x != "")


def py_embed(text: str, width: int = 64) -> list[float]:
    """Hashed word counts of a query, scaled to length 1; a text without words is the zero vector."""
    v = [0.0] * width
    for w in re.split(r"[^a-z0-9_]+", text.lower()):
        if w:
            h = 2166136261
            for c in w:
                h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
            v[h % width] += 1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embed_rows(df: DataFrame, key: str, text: Column, width: int = 64) -> DataFrame:
    """(key, slot, weight): the non-zero entries of each text's vector. Words are counted before the shuffle, so a long text costs at most `width` rows."""
    words = df.select(key, F.explode(words_for_embedding(text)).alias("w"))
    slots = words.groupBy(key, F.pmod(fnv1a(F.col("w")), F.lit(width)).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))  # at most `width` rows a key
    return slots.select(key, "slot", (F.col("n") / norm).alias("weight"))


def embedding_text(path: Column, symbol: Column, language: Column, content: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(F.trim(c), F.lit("")) for c in (path, symbol, language, content)])
