"""Filling fixed-capacity containers with items.

Token counts are taken in one streaming pass; from then on only (id, count) rows exist. The global histogram of counts
(at most one entry per token of capacity, hence bounded) goes to the driver, where dynamic programming chooses the
bucket boundaries that minimise padding. Token-budget batches are formed inside each bucket, the bucket of the longest items
first: its items are taken in order of length until the next one would exceed the budget. The room that a batch leaves is
then topped up with items of shorter buckets, the longest that fit, which is the only way in which buckets mix; a
column tells what came so. Batches are planned as patterns: so many items of this length and that, repeated so many
times. Items meet their pattern by their rank among the items of their length; hot lengths are ranked in salted parts.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import cut

#: Default rank file of the tokenizer; a parameter of every function that needs one.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the rank files split text before merging (fixed value of this public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(ranks_path: str):
    """The tokenizer of a rank file; special tokens are ordinary text."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space as the pattern above means it, and runs of it too long for its backtracking.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_GAP = re.compile(f"[{_WHITE}]{{4096,}}")
_END = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")


def _count(enc, text: str, piece: int = 1 << 20) -> int:
    """Tokens of a text, the same as of encoding it at once.

    A token never goes on from a visible character into white space, so that long texts are encoded from one such place to
    the next after `piece` characters. A run of white space is one token group but for its last character if
    a visible one follows; long runs are given to the merges directly, as the pattern's backtracking fails on them.
    """
    n = at = 0
    while at < len(text):
        gap = _LONG_GAP.search(text, at)
        stop = gap.start() if gap else len(text)
        while at < stop:
            cut = _END.search(text, at + piece, stop) if stop - at > piece else None
            end = cut.start() if cut else stop
            n += len(enc.encode_ordinary(text[at:end]))
            at = end
        if gap:
            at = gap.end() - (gap.end() < len(text))
            n += len(enc._encode_single_piece(text[stop:at]))
    return n


def token_counts(documents: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, tokens) of every document with a text; null texts have no row, empty ones 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks_path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": np.fromiter((_count(enc, t) for t in pdf["text"]), np.int64, len(pdf))})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return docs.mapInPandas(run, "doc_id long, tokens long")


def bucket_bounds(hist: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least total padding; hist[l] items have length l."""
    c, s = np.cumsum(hist, dtype=np.float64), np.cumsum(hist * np.arange(len(hist)), dtype=np.float64)
    n = len(hist)
    idx = np.arange(n)
    cost = idx[None, :] * (c[None, :] - c[:, None]) - (s[None, :] - s[:, None])  # bucket (i, j]
    cost[idx[:, None] >= idx[None, :]] = np.inf
    best = np.where(idx == 0, 0.0, np.inf)
    back = []
    for _ in range(buckets):
        total = best[:, None] + cost
        stay = best <= total.min(0)
        arg = total.argmin(0)
        best = np.minimum(best, total.min(0))
        back.append(np.where(stay, -1, arg))
    out, j = [], int(np.nonzero(hist)[0].max()) if hist.any() else 0
    for b in reversed(back):
        if j <= 0:
            break
        if b[j] >= 0:
            out.append(j)
            j = int(b[j])
    return sorted(out)


def plan(hist: np.ndarray, capacity: int, bounds: list[int]) -> pd.DataFrame:
    """Patterns: for each length, from rank `base` on `uses` items in each of `reps` containers from `first` on, at `place`.

    `bounds` are the upper bounds of the buckets, ascending. A container belongs to the `bucket` that its batch was
    formed in; `topped` rows fill what that left. Rows are in order of length and base. Every pattern exhausts a length, so that
    their number is bounded by the capacity and not by the items.
    """
    left = hist.astype(np.int64).copy()
    used = np.zeros_like(left)
    have = [int(x) for x in np.nonzero(left)[0]]  # lengths with items left, ascending
    rows, first = [], 0
    edges = sorted({0, *bounds, have[-1] if have else 0})
    for low, high in reversed(list(zip(edges, edges[1:]))):
        while have and have[-1] > low:
            room, pattern = capacity, []
            i = len(have) - 1
            while i >= 0 and have[i] > low and have[i] <= room:  # the batch: the bucket's items in order, up to the budget
                n = min(int(left[have[i]]), room // have[i])
                pattern.append((have[i], n, capacity - room, False))
                room -= n * have[i]
                if n < left[have[i]]:
                    break
                i -= 1
            limit = low
            while room > 0 and limit > 0:  # what it left: the longest items of shorter buckets
                k = bisect.bisect_right(have, min(limit, room)) - 1
                if k < 0:
                    break
                n = min(int(left[have[k]]), room // have[k])
                pattern.append((have[k], n, capacity - room, True))
                room -= n * have[k]
                limit = have[k] - 1
            reps = min(int(left[size]) // n for size, n, _, _ in pattern)
            for size, n, place, topped in pattern:
                rows.append((size, int(used[size]), n, reps, first, place, high, topped))
                used[size] += n * reps
                left[size] -= n * reps
                if not left[size]:
                    have.pop(bisect.bisect_left(have, size))
            first += reps
    out = pd.DataFrame(rows, columns=["length", "base", "uses", "reps", "first", "place", "bucket", "topped"])
    return out.sort_values(["length", "base"], kind="stable").reset_index(drop=True)


def pack(counts: DataFrame, capacity: int = 2048, buckets: int = 16, part_rows: int = 250_000) -> DataFrame:
    """(doc_id, part, container, place, length, bucket, topped) of counts (doc_id, tokens), one row per item or piece.

    An item longer than the capacity is split into full pieces and a rest; none else is. Items of no tokens, nulls
    and empty tables give no rows; repeated rows of a doc_id count once (the greatest count). Containers are numbered
    from 0, `place` is the offset in tokens; items of a container never overlap and never exceed the capacity. `bucket` is
    the upper bound of the bucket in which the container's batch was formed, `topped` tells items of shorter buckets
    that fill its rest.
    """
    spark = counts.sparkSession
    items = cut(counts.where("doc_id IS NOT NULL AND tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int"))).alias("part")
    pieces = items.select("doc_id", "tokens", part).select("doc_id", "part", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part") * F.lit(capacity).cast("long")).cast("int").alias("length"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        hist[r["length"]] = r["count"]
    patterns = plan(hist, capacity, bucket_bounds(hist, buckets))
    shared = spark.sparkContext.broadcast(patterns)

    salts = max(1, int(-(-hist.max() // part_rows)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "part")) - 1
    ranked = salted.withColumn("own", rank).join(before, ["length", "salt"]).select("doc_id", "part", "length", (F.col("own") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        step = int(hist_max) + 1
        keys = p["length"].to_numpy(np.int64) * step + p["base"].to_numpy(np.int64)
        cols = {c: p[c].to_numpy(np.int64) for c in ("base", "uses", "first", "place", "bucket", "topped")}
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            i = rank - cols["base"][at]
            uses = cols["uses"][at]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "part": pdf["part"], "container": cols["first"][at] + i // uses,
                "place": (cols["place"][at] + i % uses * length).astype(np.int32), "length": pdf["length"], "bucket": cols["bucket"][at].astype(np.int32), "topped": cols["topped"][at].astype(bool),
            })

    hist_max = hist.max()
    return ranked.mapInPandas(place, "doc_id long, part int, container long, place int, length int, bucket int, topped boolean")
