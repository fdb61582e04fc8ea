"""Near-duplicate sets: an exact Jaccard join by regions of shared values and, inside large ones, Voronoi regions.

The Jaccard distance d = 1 - |a & b| / |a | b| is a metric, so that a document within eps of another lies, for any
pivot p, within eps of that other's distance to p. Pivots drawn from the documents are the last level here, not the
first: sparse unrelated sets are all at distances near 1 from any document, where the triangle inequality excludes
nothing and would replicate every document into every region.

The first level is therefore a region per value. In an order of the values from rare to common a set keeps at least a share t
of its values, so that two sets within the threshold share one of the |a| - ceil(t|a|) + 1 first of each. Only (value, set number,
place, size, bitmap) rows move there; places, sizes and bitmaps bound what two sets can share, and only pairs that
pass the bounds fetch their sets and are verified. The values in at most one of `COMMON` sets need no order among
each other but their fingerprints', so that the counts of the others, a bounded list, are all that is broadcast.

A region of more than `cap` sets is divided by the next shared value and the next (the k-th that two sets share is among the
|a| - ceil(t|a|) + k first), up to `values` of them. Two sets that share no further value part there, and are joined before:
they share the path alone, so that they pass if and only if |a| + |b| <= |path| (1 + 1/t), and the join is on the region
and the sizes that may meet.

What is still large by then are sets that lie close to each other. Documents drawn by hash become pivots, each member
goes to the region of the nearest, and is replicated into every other region whose pivot p has
d(x, p) <= min(d(x, home) + 2 eps, radius(p) + eps). This repeats until regions are small, or stop shrinking; then
the pairs inside a region are verified. Values are compared by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import cut

#: Values in more than one of so many sets are ordered by their counts; there are at most COMMON times the mean size of them.
COMMON = 10_000
#: Counts that are broadcast, at most; sets of a greater mean size than 200 have fewer values ordered.
COUNTS = 2_000_000


def pooled(*parts: Column) -> Column:
    """The distinct non-null values of array columns, null arrays counting as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*[F.coalesce(p.cast("array<string>"), empty) for p in parts]))))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _distance(a: Column, b: Column) -> Column:
    n = _shared(a, b)
    return F.lit(1.0) - n / (F.size(a) + F.size(b) - n)


def _passes(shared: Column, na: Column, nb: Column, t: float) -> Column:
    return shared >= F.lit(t) * (na + nb - shared) - F.lit(1e-9)


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives (rep, s), membership (id, rep)) of records (id, vals) with equal sets; rep is the smallest id.

    `s` are the fingerprints of the values, ascending. Repeated rows count once; of several sets of an id one is taken, the same in every run.
    """
    s = F.array_sort(F.transform("vals", lambda x: F.xxhash64(x)))
    rec = records.where("id IS NOT NULL AND size(vals) > 0").select("id", s.alias("s")).withColumns({"h1": F.xxhash64("s"), "h2": F.hash("s")})
    own = cut(rec.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("m")).select("id", "m.h1", "m.h2"))
    heads = own.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    reps = rec.select("h1", "h2", "s").groupBy("h1", "h2").agg(F.first("s").alias("s")).join(heads, ["h1", "h2"]).select("rep", "s")
    return reps, own.join(heads, ["h1", "h2"]).select("id", "rep")


class Order:
    """The order of values: those of the list by their counts, all others before them, equals by fingerprint."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        at = np.argsort(values)
        self.values, self.counts = values[at], counts[at]

    def sets(self, column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(values in order, set of each, place of each, size of each set)."""
        size = column.map(len).to_numpy(np.int64)
        flat = np.concatenate(list(column)).astype(np.int64) if len(column) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        rank = np.zeros(len(flat), np.int64)
        if len(self.values):
            at = np.minimum(np.searchsorted(self.values, flat), len(self.values) - 1)
            rank = np.where(self.values[at] == flat, self.counts[at], 0)
        order = np.lexsort((flat, rank, owner))
        return flat[order], owner, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), size


def _bitmaps(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits of each set, one set for each value."""
    bit = (flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    words = [np.where(bit >> np.uint64(6) == w, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)) for w in (0, 1)]
    begin = np.cumsum(size) - size
    return np.stack([np.bitwise_or.reduceat(w, begin) for w in words]).view(np.int64) if len(flat) else np.zeros((2, 0), np.int64)


def similar_pairs(reps: DataFrame, t: float, cap: int = 128, values: int = 3, pivots: int = 12, depth: int = 8, block: int = 512) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of distinct sets (rep, s) whose Jaccard similarity is at least t > 0.

    No pair is lost and none is approximate. Empty sets are not in `reps`; an empty table gives an empty result.
    """
    base = cut(reps.select("rep", "s").withColumn("rid", F.monotonically_increasing_id()))
    n, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("s")), F.lit(0))).first()
    common = min(COMMON, COUNTS * n // max(total, 1))
    often = base.select(F.explode("s").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > max(1, n // max(common, 1))).toPandas()
    order = base.sparkSession.sparkContext.broadcast(Order(often["v"].to_numpy(np.int64), often["f"].to_numpy(np.int64)))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            flat, owner, place, size = order.value.sets(pdf["s"])
            bits = _bitmaps(flat, size)
            keep = place <= (size - np.ceil(t * size - 1e-9).astype(np.int64))[owner]
            of = owner[keep]
            yield pd.DataFrame({"v": flat[keep], "rid": pdf["rid"].to_numpy()[of], "place": place[keep].astype(np.int32), "n": size[of].astype(np.int32), "b0": bits[0][of], "b1": bits[1][of]})

    slim = base.select("rid", "s").mapInPandas(prefixes, "v long, rid long, place int, n int, b0 long, b1 long")
    met = slim.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    wide = cut(met.where(F.col("size") > cap))
    regions = slim.join(met.where(F.col("size") <= cap).drop("size"), "v")
    pairs = _bounded_pairs(regions, t)
    sa, sb = (base.select(F.col("rid").alias(f"r{x}"), F.col("rep").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    whole = pairs.join(sa, "ra").join(sb, "rb").withColumn("shared", _shared(F.col("sa"), F.col("sb")))
    na, nb = F.size("sa"), F.size("sb")
    similarity = (F.col("shared") / (na + nb - F.col("shared"))).alias("similarity")
    fine = whole.where(_passes(F.col("shared"), na, nb, t)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), similarity)
    if wide.isEmpty():
        return fine
    # the sets of large regions, whole and in order
    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                flat, _, _, size = order.value.sets(pdf["s"])
                yield pd.DataFrame({"rid": pdf["rid"], "rep": pdf["rep"], "s": np.split(flat, np.cumsum(size)[:-1])})

    large = slim.join(wide, "v").select("rid", "v", "size")
    texts = base.join(large.select("rid").distinct(), "rid", "left_semi").select("rid", "rep", "s").mapInPandas(ordered, "rid long, rep string, s array<long>")
    level = large.join(texts, "rid").select("rep", "s", F.array("v").alias("path"), F.col("v").cast("string").alias("region"), F.lit(True).alias("home"), "size")
    return fine.unionByName(_large_regions(level, base, t, cap, values, pivots, depth, block)).dropDuplicates(["a", "b"])


def _bounded_pairs(regions: DataFrame, t: float) -> DataFrame:
    """(ra, rb): pairs of a region of one value that may pass, by sizes, by what follows their places, and by their bitmaps."""
    a, b = (regions.select("v", *[F.col(c).alias(c + x) for c in ("rid", "place", "n", "b0", "b1")]) for x in "ab")
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")) - F.lit(1e-9))
    # each shared prefix value is a row of its own: the first of them has nothing shared before it
    room = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))
    lacks = lambda x, y: F.bit_count(F.col(f"b0{x}").bitwiseAND(F.bitwise_not(F.col(f"b0{y}")))) + F.bit_count(F.col(f"b1{x}").bitwiseAND(F.bitwise_not(F.col(f"b1{y}"))))
    may = (room >= need) & (F.col("na") - lacks("a", "b") >= need) & (F.col("nb") - lacks("b", "a") >= need)
    close = (F.col("na") >= F.lit(t) * F.col("nb") - 1e-9) & (F.col("nb") >= F.lit(t) * F.col("na") - 1e-9)
    return a.join(b, "v").where((F.col("rida") < F.col("ridb")) & close & may).select(F.col("rida").alias("ra"), F.col("ridb").alias("rb")).distinct()


def _large_regions(level: DataFrame, reps: DataFrame, t: float, cap: int, values: int, pivots: int, depth: int, block: int) -> DataFrame:
    """(a, b, similarity) of the regions of more than `cap` sets."""
    n = F.size("s")
    spare = n - F.ceil(F.lit(t) * n - F.lit(1e-9)).cast("int")  # values that a set within the threshold may lack
    found: list[DataFrame] = []
    for d in range(depth + 1):
        if d:
            sizes = level.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.count_if("home").alias("homes")).where("size > 1 AND homes > 0")
            level = level.join(sizes, "region").drop("homes")
        level = cut(level)
        large = level.where(F.col("size") > cap)
        if d == depth or large.isEmpty():
            found.append(_leaf(level, t, block))
            break
        found.append(_leaf(level.where(F.col("size") <= cap), t, block))
        found.append(_ended(large.where(F.size("path") < values), t))
        # by the next shared value
        at = F.array_position("s", F.element_at("path", -1)).cast("int")
        rest = F.slice("s", at + 1, F.greatest(spare + F.size("path") + 1 - at, F.lit(0)))
        by_value = large.where(F.size("path") < values).select("rep", "s", "path", "region", "home", F.explode(rest).alias("v"))
        level = by_value.select("rep", "s", F.concat("path", F.array("v")).alias("path"), F.concat_ws(".", "region", F.col("v").cast("string")).alias("region"), "home")
        close = large.where(F.size("path") >= values)
        if not close.isEmpty():
            stuck, moved = _divide(close, d, t, cap, pivots)
            found.append(_leaf(stuck, t, block))
            level = level.unionByName(moved)
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    sa, sb = reps.select(F.col("rep").alias("a"), F.col("s").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    checked = pairs.distinct().join(sa, "a").join(sb, "b").withColumn("n", _shared(F.col("sa"), F.col("sb")))
    na, nb = F.size("sa"), F.size("sb")
    return checked.where(_passes(F.col("n"), na, nb, t)).select("a", "b", (F.col("n") / (na + nb - F.col("n"))).alias("similarity"))


def _ended(large: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of a region of values that pass by the values of its path alone; sets of the region that share more pass then too."""
    p, n = F.size("path"), F.size("s")
    small = large.select("rep", "region", p.alias("p"), n.alias("n"), F.floor(p * F.lit(1.0 + 1.0 / t) + 1e-9).cast("int").alias("most")).where("n + p <= most")
    left = small.select("region", F.col("rep").alias("a"), F.explode(F.sequence(F.col("p"), F.col("most") - F.col("n"))).alias("nb"))
    right = small.select("region", F.col("rep").alias("b"), F.col("n").alias("nb"))
    return left.join(right, ["region", "nb"]).where("a < b").select("a", "b")


def _divide(close: DataFrame, d: int, t: float, cap: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(rows of regions that pivots can't tell apart, rows of the new regions) by document pivots."""
    eps = 1.0 - t
    # about `pivots` members, drawn by hash; a region from which fewer than two are drawn waits a level
    draw = F.pmod(F.xxhash64("rep", "region", F.lit(d)), F.lit(1 << 30)) < F.lit(pivots << 30) / F.col("size")
    drawn = close.where(draw).groupBy("region").agg(F.sort_array(F.collect_list("s")).alias("p"))  # bounded by the draw
    apart = close.join(drawn, "region", "left").withColumn("p", F.coalesce("p", F.array(F.col("s"))))
    apart = apart.withColumn("d", F.transform("p", lambda p: _distance(F.col("s"), p))).drop("p")
    apart = cut(apart.withColumns({"near": F.array_position("d", F.array_min("d")).cast("int") - 1, "dmin": F.array_min("d"), "lone": F.size("d") < 2}))
    radius = apart.where(~F.col("lone")).groupBy("region", F.col("near").alias("q")).agg(F.max("dmin").alias("radius"))
    reach = radius.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("q", "radius"))).alias("radii"))  # one entry per pivot
    apart = apart.join(reach, "region", "left")

    def within(z: Column) -> Column:
        near = (z["x"] <= F.col("dmin") + 2 * eps + 1e-9) & F.col("radii").isNotNull() & (z["x"] <= F.element_at("radii", z["q"]) + eps + 1e-9)
        return (z["q"] == F.col("near")) | near

    z = F.explode(F.filter(F.transform("d", lambda x, i: F.struct(i.alias("q"), x.alias("x"))), within)).alias("z")
    moved = apart.select("rep", "s", "path", "region", "home", "near", "size", "lone", z)
    moved = moved.select(
        "rep", "s", "path",
        F.when(F.col("lone"), F.col("region")).otherwise(F.concat_ws("/", "region", F.col("z.q").cast("string"))).alias("region"),
        (F.col("home") & (F.col("near") == F.col("z.q"))).alias("home"), F.col("size").alias("before"), "lone",
    )
    after = moved.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
    moved = cut(moved.join(after, "region"))
    # a region that did not shrink cannot be told apart by pivots: it is joined as it is
    stuck = (F.col("size") > cap) & (F.col("size") > 0.9 * F.col("before")) & ~F.col("lone")
    columns = ["rep", "s", "path", "region", "home"]
    return moved.where(stuck).select(*columns, "size"), moved.where(~stuck).select(*columns)


def _leaf(level: DataFrame, t: float, block: int) -> DataFrame:
    """Pairs (a, b) inside regions, at least one of them at home there; regions larger than a block are compared block by block."""
    rows = level.withColumn("blocks", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    left = rows.where("home").select("region", mine.alias("block"), "path", F.col("rep").alias("a"), F.col("s").alias("sa"))
    right = rows.select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("rep").alias("b"), F.col("s").alias("sb"), F.col("home").alias("hb"))
    na, nb = F.size("sa"), F.size("sb")
    near = (F.col("a") < F.col("b")) | (~F.col("hb") & (F.col("a") > F.col("b")))  # two at home meet once
    pairs = left.join(right, ["region", "block"]).where(near & (na >= F.lit(t) * nb - 1e-9) & (nb >= F.lit(t) * na - 1e-9))
    # of the regions of values that two sets share, the one of their first shared values answers
    pairs = pairs.withColumn("both", F.array_intersect("sa", "sb")).where(_passes(F.size("both"), na, nb, t) & (F.slice("both", F.lit(1), F.size("path")) == F.col("path")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of representatives spelled out for all their members, and the pairs of equal sets."""
    m1, m2 = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    between = pairs.select("a", "b").join(m1, "a").join(m2, "b").select("x", "y")
    within = m1.join(m2, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return between.union(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(v, component): connected components by least label, with pointer jumping; the label is the smallest vertex."""
    both = cut(pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).union(pairs.select("b", "a")))
    labels = cut(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("l")))
    for _ in range(rounds):
        lu = labels.select(F.col("v").alias("u"), F.col("l").alias("lu"))
        step = both.join(lu, "u").groupBy("v").agg(F.min("lu").alias("m")).join(labels, "v").select("v", F.least("m", "l").alias("l1"), F.col("l").alias("l0"))
        step = cut(step)
        jump = step.select(F.col("v").alias("l1"), F.col("l1").alias("l2"))
        new = cut(step.join(jump, "l1", "left").select("v", F.least(F.coalesce("l2", "l1"), "l1").alias("l"), "l0"))
        labels = new.select("v", "l")
        if new.where("l <> l0").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("v", F.col("l").alias("component"))


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, links): one row per record; links counts the other records within the threshold, copies included."""
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("o")).union(pairs.select("b", "a"))
    links = both.join(size.select(F.col("rep").alias("o"), "n"), "o").groupBy("rep").agg(F.sum("n").alias("links"))
    comp = components(pairs).select(F.col("v").alias("rep"), "component")
    table = size.join(links, "rep", "left").join(comp, "rep", "left")
    table = table.select("rep", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    return members.join(table, "rep").select("id", "class_id", "links")
