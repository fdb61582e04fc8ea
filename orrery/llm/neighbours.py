"""Most similar vectors for every vector.

The vectors are spread over shards by a coarse quantiser fitted on a bounded sample; a shard that is still too large
is cut into parts by hash, and a part with very many visitors into blocks of them. Each part holds an HNSW graph (flat
neighbour arrays, `hnsw.Graph`) of its own vectors and is searched by them and by the vectors of other shards that lie near
its border, which are streamed past it. The answers of all shards are merged, both directions of a pair are used, and the similarities are computed
in double precision.

Equal vectors are one node: the k + 1 smallest of their ids stand for it in any list, and every id takes its vector's list in the
end, so that a vector that a third of the rows share neither blows up a shard nor crowds other neighbours out. Which vector
counts for an id, and which ids share one, is settled on hashes; the vectors themselves move twice, once to be made
distinct and once to their shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.hnsw import Graph
from orrery.session import cut

#: Vectors that the quantiser is fitted on: so many, or eight per shard if that is more; every vector is indexed and searched.
SAMPLE = 16_384
#: Vectors of a graph, about.
SHARD = 8_192
#: A vector also searches each shard whose centre is no less similar to it than its own shard's centre by more than this.
MARGIN = 0.15
#: Shards at most, which bounds the sample to 262,144 vectors; larger collections get larger shards, cut by hash.
CENTRES = 32_768
#: Shards up to which all centres are compared; beyond, centres are nested and only near cells are looked into.
FLAT = 512


def usable(e: Column, width: int) -> Column:
    """Whether a vector has a direction: of the given width, without null, NaN or infinite entries, not all zero."""
    top, low = F.array_max(e), F.array_min(e)
    # NaN ranks above infinity; looking for an absent value gives null if there are null entries
    whole = F.array_contains(e, F.lit(float("nan")).cast("float")).eqNullSafe(F.lit(False))
    fine = (F.size(e) == width) & (top < F.lit(float("inf"))) & (low > F.lit(float("-inf"))) & whole & ((top != 0) | (low != 0))
    return F.coalesce(fine, F.lit(False))


#: What a row is to a graph: a vector of it that also asks, one of it only, or one that only asks.
_BOTH, _HELD, _ASKS = 0, 1, 2
#: How far under the wanted similarity a node may lie and still be expanded.
_NEAR = 0.2
#: Rows searched or written at a time.
_STEP = 2048
#: Similarities held at a time where rows are compared with many others.
_CELLS = 1 << 21


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, _CELLS // len(c))
    return np.concatenate([(x[lo : lo + step] @ c.T).argmax(1) for lo in range(0, max(1, len(x)), step)])


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        at = _closest(sample, c)
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


class Quantiser:
    """Centres of shards. Above `flat` of them they are nested: cells, and the centres inside each."""

    def __init__(self, sample: np.ndarray, k: int, flat: int = FLAT, slack: float = 0.15):
        self.slack = slack
        if k <= flat:
            self.cells = None
            self.centres = fit_centres(sample, k) if len(sample) else np.zeros((1, sample.shape[1]))
            return
        self.cells = fit_centres(sample, math.isqrt(k - 1) + 1)
        at = _closest(sample, self.cells)
        inner = [fit_centres(sample[at == c], max(1, round(k * np.mean(at == c)))) if (at == c).any() else self.cells[c : c + 1] for c in range(len(self.cells))]
        self.first = np.cumsum([0] + [len(x) for x in inner])
        self.centres = np.concatenate(inner)

    @property
    def step(self) -> int:
        """Rows to ask `near` for at a time."""
        return max(64, min(_STEP, _CELLS // len(self.centres)))

    def near(self, u: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, whether it is the row's own shard) for all shards near a row's vector."""
        if self.cells is None:
            sims = u @ self.centres.T
        else:
            top = u @ self.cells.T
            look = top >= top.max(1, keepdims=True) - margin - self.slack
            sims = np.full((len(u), len(self.centres)), -np.inf, np.float32)
            for c in np.nonzero(look.any(0))[0]:
                rows, lo, hi = np.nonzero(look[:, c])[0], self.first[c], self.first[c + 1]
                sims[rows, lo:hi] = u[rows] @ self.centres[lo:hi].T
        home = sims.argmax(1)
        near = sims >= sims[np.arange(len(u)), home][:, None] - margin
        row, to = np.nonzero(near)
        return row, to, to == home[row]


def _unit(col: pa.ListArray) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1 if len(col) else 1).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _first_tied(u: np.ndarray, q: np.ndarray, most: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of `q`, row of `u`) of the `most` most similar of `u` for each of `q`, by comparing all; of equal rounded similarities the first in `u`."""
    n, most = len(u), min(most, len(u))
    block = max(1, min(256, _CELLS // n))
    r, j = [], []
    for lo in range(0, len(q), block):
        part = q[lo : lo + block]
        key = np.rint((part @ u.T) * 10.0**digits).astype(np.int64) * n + np.arange(n - 1, -1, -1)
        top = np.argpartition(key, n - most, axis=1)[:, n - most :]
        r.append(np.repeat(np.arange(lo, lo + len(part)), most))
        j.append(top.reshape(-1))
    return np.concatenate(r), np.concatenate(j)


def _each(a: pa.Array, at: np.ndarray, lists: pa.ListArray, of: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """For every i: a[at[i]] beside each of lists[of[i]], and i."""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, reps = np.cumsum(n) - n, n[of]
    name = np.repeat(begin[of], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    return a.take(pa.array(np.repeat(at, reps))), lists.flatten().take(pa.array(name)), np.repeat(np.arange(len(at)), reps)


class _Part:
    """The graph of a part, with the ids and vectors that it holds. Vectors search it a few at a time, so that memory follows the part and not its visitors."""

    def __init__(self, rows: pa.RecordBatch, k: int, keep: int, ef: int, floor: float, digits: int):
        rows = rows.take(pc.sort_indices(pc.list_element(rows["ids"], 0)))
        self.ids, self.u = rows["ids"], _unit(rows["embedding"])
        self.asks = np.nonzero(rows["role"].to_numpy() == _BOTH)[0]
        self.graph = Graph(self.u)
        self.k, self.keep, self.ef, self.floor, self.digits = k, keep, ef, floor, digits

    def own(self) -> Iterator[pa.RecordBatch]:
        """What the part's own vectors find."""
        for lo in range(0, len(self.asks), _STEP):
            at = self.asks[lo : lo + _STEP]
            yield self._found(self.ids.take(pa.array(at)), self.u[at], at)

    def visited(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """What vectors of other shards find."""
        for lo in range(0, len(rows) if len(self.u) else 0, _STEP):
            part = rows.slice(lo, _STEP)
            yield self._found(part["ids"], _unit(part["embedding"]), None)

    def _found(self, ids: pa.ListArray, q: np.ndarray, own: np.ndarray | None) -> pa.RecordBatch:
        k, keep, floor, digits = self.k, self.keep, self.floor, self.digits
        low = floor - 0.51 * 10.0**-digits - 1e-6
        at, near = self.graph.search(q, keep, self.ef, floor - _NEAR, own=own)
        fine = (at >= 0) & (near >= low - 1e-4)  # the graph's cosines are of single precision
        if own is not None:
            fine &= at != own[:, None]
        r, j = np.nonzero(fine)
        to = at[r, j]
        s = np.round(np.einsum("ij,ij->i", q[r], self.u[to]), digits)
        got = np.full(at.shape, np.inf)  # negative rounded similarities, the best first
        got[r, j] = -s
        got.sort(axis=1)
        full = np.isfinite(got).sum(1) >= keep - 1
        tied = np.nonzero(full & (got[:, keep - 2] <= got[:, k - 1]) & (-got[:, k - 1] >= low))[0]
        if len(tied):
            rest = ~np.isin(r, tied)
            more, there = _first_tied(self.u, q[tied], k + 2, digits)
            more = tied[more]
            if own is not None:
                more, there = more[own[more] != there], there[own[more] != there]
            r, to = np.concatenate([r[rest], more]), np.concatenate([to[rest], there])
            s = np.concatenate([s[rest], np.round(np.einsum("ij,ij->i", q[more], self.u[there]), digits)])
        r, to, s = r[s >= floor], to[s >= floor], s[s >= floor]
        # each way, and each id that stands for the other vector
        a, b, i = _each(pc.list_element(ids, 0), r, self.ids, to)
        a2, b2, i2 = _each(pc.list_element(self.ids, 0), to, ids, r)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, a2]), pa.concat_arrays([b, b2]), pa.array(s[np.concatenate([i, i2])])], names=["a", "b", "similarity"])


def nearest(
    vectors: DataFrame, k: int = 5, floor: float = 0.86, width: int = 64, digits: int = 4, spare: int = 19, ef: int = 32, shard: int = SHARD, margin: float = MARGIN, version: str | None = None, flat: int = FLAT
) -> DataFrame:
    """(id, neighbour, similarity): up to k most similar other ids of every id, of similarity `floor` or more.

    `vectors` is (id, embedding), and `version` names a column of which an id's highest row counts; repeated rows count
    once, and of several vectors of that version one is taken, the same in every run. Similarity is the cosine, rounded to
    `digits`; ties go to the smaller id. Ids without a usable vector take no part, an empty table gives an empty result, a
    lone vector has no neighbour. `spare` more distinct vectors than k are kept per search; where even the last of them
    ties with the k-th, the part is scanned whole, so that ties and copies are settled exactly.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    raw = vectors.select("id", (F.col(version) if version else F.lit(0)).alias("version"), "embedding").where("id IS NOT NULL")
    key = {"h1": F.xxhash64(e), "h2": F.hash(e)}
    said = raw.select("id", "version", *[F.when(usable(e, width), v).alias(h) for h, v in key.items()])
    best = F.max(F.struct("version", "h1", "h2")).alias("m")
    own = cut(said.groupBy("id").agg(best).select("id", "m.h1", "m.h2").where("h1 IS NOT NULL"))
    n = own.agg(F.approx_count_distinct("h1").alias("n")).first()["n"]

    first = Window.partitionBy("h1", "h2").orderBy("id")
    heads = own.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    keyed = raw.where(usable(e, width)).select(*[v.alias(h) for h, v in key.items()], "embedding")
    distinct = keyed.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding")).join(heads, ["h1", "h2"])

    shards = max(1, min(CENTRES, math.ceil(n / shard)))
    size = max(SAMPLE, 8 * shards)
    share = math.ceil(min(1.0, size / max(n, 1)) * (1 << 20))
    drawn = keyed.where(F.pmod(F.col("h1"), F.lit(1 << 20)) < F.lit(share)).groupBy("h1", "h2").agg(F.first("embedding").alias("embedding")).select("embedding").limit(2 * size).toArrow()
    sample = _unit(drawn["embedding"].combine_chunks()) if len(drawn) else np.zeros((0, width))
    quantiser = Quantiser(sample, shards, flat)
    # how many parts and blocks a shard takes, judged by the sample
    counts = np.zeros((2, len(quantiser.centres)), np.int64)
    for lo in range(0, len(sample), quantiser.step):
        _, to, home = quantiser.near(sample[lo : lo + quantiser.step], margin)
        counts += [np.bincount(x, minlength=len(quantiser.centres)) for x in (to[home], to)]
    scale = n / max(1, len(sample))
    parts = np.maximum(1, np.ceil(counts[0] * scale / (4 * shard))).astype(np.int64)
    blocks = np.maximum(1, np.ceil(counts[1] * scale / parts / (32 * shard))).astype(np.int64)
    shared = spark.sparkContext.broadcast((quantiser, parts, blocks))  # at most CENTRES centres

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, parts, blocks = shared.value
        for batch in batches:
            for lo in range(0, len(batch), q.step):
                part = batch.slice(lo, q.step)
                row, to, home = q.near(_unit(part["embedding"]), margin)
                # to each part of a shard; of the own part to each block, as one of the graph
                h = part["h1"].to_numpy() & 0x7FFFFFFFFFFFFFFF
                reps = parts[to]
                row, to, home, p = np.repeat(row, reps), np.repeat(to, reps), np.repeat(home, reps), np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                mine, asks = home & (h[row] % parts[to] == p), h[row] // 97 % blocks[to]
                reps = np.where(mine, blocks[to], 1)
                at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                row, to, p, mine, asks = (np.repeat(x, reps) for x in (row, to, p, mine, asks))
                block = np.where(mine, at, asks)
                role = np.where(mine, np.where(block == asks, _BOTH, _HELD), _ASKS)
                for o in range(0, len(row), 2 * _STEP):
                    x = slice(o, o + 2 * _STEP)
                    copies = part.select(["ids", "embedding"]).take(pa.array(row[x]))
                    yield pa.RecordBatch.from_arrays([*copies.columns, *(pa.array(v[x], t) for v, t in ((to, pa.int32()), (p, pa.int32()), (block, pa.int32()), (role, pa.int8())))], names=["ids", "embedding", "shard", "part", "block", "role"])

    placed = distinct.select("h1", "ids", "embedding").mapInArrow(place, "ids array<string>, embedding array<float>, shard int, part int, block int, role byte")

    keep = k + 1 + spare

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Block by block: first come the vectors that its graph holds, then those that only ask."""
        at, held, graph = None, [], None

        def built() -> _Part:
            return _Part(pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0], k, keep, ef, floor, digits)

        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("shard", "part", "block")], axis=1)
            asks = batch["role"].to_numpy() == _ASKS
            begin = np.nonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (asks[1:] != asks[:-1])])[0] if len(batch) else []
            for lo, hi in zip(begin, [*begin[1:], len(batch)]):
                rows = batch.slice(lo, hi - lo)
                if at != tuple(keys[lo]):
                    if held:
                        yield from built().own()
                    at, held, graph = tuple(keys[lo]), [], None
                if not asks[lo]:
                    held.append(rows)
                    continue
                if held:
                    graph, held = built(), []
                    yield from graph.own()
                if graph:
                    yield from graph.visited(rows)
        if held:
            yield from built().own()

    spots = ["shard", "part", "block"]
    found = placed.repartition(*spots).sortWithinPartitions(*spots, "role").mapInArrow(search, "a string, b string, similarity double")
    copies = heads.where("size(ids) > 1").select(F.col("ids")[0].alias("a"), F.explode("ids").alias("b"), F.lit(1.0).alias("similarity"))
    # a pair is found at most once from either side, so that so many rows hold the k + 1 best
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    pool = found.unionByName(copies).withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * (k + 1))
    lists = pool.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("d"), F.col("b").alias("neighbour")))), 1, k + 1).alias("list"))
    named = own.join(heads, ["h1", "h2"]).select("id", F.col("ids")[0].alias("a")).join(lists, "a")
    mine = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return named.select("id", F.explode(mine).alias("x")).select("id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.d")).alias("similarity"))


def brute_force(ids: list[str], x: np.ndarray, k: int = 5, floor: float = 0.86, digits: int = 4) -> set[tuple[str, str]]:
    """(id, neighbour) by comparing all: the reference of the tests."""
    u = x.astype(np.float64)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    out = set()
    for i in range(len(ids)):
        s = np.round(u @ u[i], digits)
        cand = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i and s[j] >= floor)
        out |= {(ids[i], b) for _, b in cand[:k]}
    return out
