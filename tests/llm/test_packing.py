import os

import numpy as np
import pytest

from orrery.llm.packing import RANKS, _count, bucket_bounds, encoder, pack, plan, token_counts


def test_bounds_are_optimal():
    rng = np.random.default_rng(1)
    h = np.zeros(13, int)
    h[1:] = rng.integers(0, 9, 12)
    h[12] = 3

    def pad(b):
        return sum(h[n] * (min(x for x in b if x >= n) - n) for n in range(1, 13))

    from itertools import combinations

    best = min(pad((*c, 12)) for c in combinations(range(1, 12), 2))
    assert pad(bucket_bounds(h, 3)) == best


def _check(rows, want, cap):
    by, total = {}, {}
    for r in rows:
        by.setdefault(r["container"], []).append((r["place"], r["length"]))
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert 0 < r["length"] <= cap
    assert total == want
    for v in by.values():
        v.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(v, v[1:])) and v[-1][0] + v[-1][1] <= cap
    assert set(by) == set(range(len(by)))
    return len(by)


def _first_fit_decreasing(sizes, cap):
    rooms = []
    for n in sizes:
        k = next((k for k, r in enumerate(rooms) if r >= n), None)
        if k is None:
            rooms.append(cap - n)
        else:
            rooms[k] -= n
    return len(rooms)


def test_whole_disjoint_and_tight(spark):
    rng = np.random.default_rng(2)
    n = np.where(rng.random(3000) < 0.33, 700, rng.integers(0, 5000, 3000))  # a third of one length
    rows = [(i, int(x), "c") for i, x in enumerate(n)]
    d = spark.createDataFrame(rows + rows[:50] + [(9000, None, "c"), (None, 5, "c")], "doc_id long, tokens long, container string")
    got = pack(d, 2048, part_rows=100).collect()
    used = _check(got, {i: x for i, x, _ in rows if x}, 2048)
    assert used <= 1.01 * _first_fit_decreasing(sorted((r["length"] for r in got), reverse=True), 2048)
    assert all(r["part"] == 0 for r in got if n[r["doc_id"]] <= 2048)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, tokens long")).count() == 0


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")
def test_counts(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a b " * 700_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in token_counts(d).collect()}
    assert 2 <= got[1] <= 4 and got[2] == 0 and 3 not in got and got[4] >= 1_400_000


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")
def test_counts_in_pieces_are_those_of_the_whole():
    enc = encoder(RANKS)
    rng = np.random.default_rng(5)
    parts = ["word", " two", "\n\n", " " * 5_000, "\t" * 4_096, "\u00a0" * 4_500, "\x1c" * 10, "don't", "123", " 45", "...", "\r\n", "日本語", "x" * 300, " "]
    for _ in range(60):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), 30))
        assert _count(enc, text, piece=int(rng.integers(1, 200))) == len(enc.encode_ordinary(text))
    # blanks beyond what the pattern's backtracking bears
    assert _count(enc, " " * 1_000_000) == len(enc._encode_single_piece(b" " * 1_000_000))
    assert _count(enc, "a" + " " * 1_000_000 + "b") == _count(enc, "a") + len(enc._encode_single_piece(b" " * 999_999)) + len(enc.encode_ordinary(" b"))


def test_batches_form_inside_buckets():
    h = np.zeros(101, np.int64)
    h[[60, 45, 40, 30, 10]] = [4, 6, 5, 7, 9]
    one, two = plan(h, 100, [60]), plan(h, 100, [30, 45, 60])
    assert not one.equals(two)
    own = two[~two.topped]
    low = {30: 0, 45: 30, 60: 45}
    assert all(low[b] < n <= b for n, b in zip(own["length"], own["bucket"]))
    assert all(n <= low[b] for n, b in zip(two[two.topped]["length"], two[two.topped]["bucket"]))
    assert (two["uses"] * two["reps"]).groupby(two["length"]).sum().to_dict() == {60: 4, 45: 6, 40: 5, 30: 7, 10: 9}


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")
def test_other_bounds_other_containers(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(1, 600, 500))], "doc_id long, tokens long")
    few, many = ({(r["doc_id"], r["container"]) for r in pack(d, 2048, buckets=b).collect()} for b in (3, 16))
    assert few != many
