import re
from pathlib import Path

import numpy as np
import psutil
import pyarrow as pa
import pytest

from orrery.llm.hnsw import Graph
from orrery.llm.neighbours import brute_force, nearest


def _clustered(n, seed=0, width=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), width))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, width))
    return (x * rng.uniform(0.3, 3, (n, 1))).astype(np.float32)


def _frame(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v], "extra") for i, v in zip(ids, x)], "id string, embedding array<float>, similarity string")


def test_graph_recall():
    x = _clustered(3000).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    at, _ = Graph(u).search(u, 10)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    true = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(set(true[i]) & set(at[i])) / 5 for i in range(len(u))]) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_small_graphs(n):
    u = np.eye(64)[:n]
    at, _ = Graph(u).search(u, 3)
    assert at.shape == (n, 3) and all(i in at[i] for i in range(n))


def test_equals_brute_force_with_hot_copies_and_unusable_rows(spark):
    x = _clustered(600, 1)
    x[200:400] = x[0]  # a third of the rows share one vector
    ids = [f"c{i:04d}" for i in range(600)]
    rows = _frame(spark, ids, x).union(_frame(spark, ["null", "zero", "short", "nan"], [None, [0.0] * 64, [1.0] * 32, [float("nan")] * 64]))
    got = {(r["id"], r["neighbour"]) for r in nearest(rows.union(rows), shard=64).collect()}
    want = brute_force(ids, x)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    hot = {b for a, b in got if a == "c0300"}
    assert hot == {"c0000", "c0200", "c0201", "c0202", "c0203"}  # ties go to the smaller id


@pytest.mark.parametrize("kind", ["scaled", "moved"])
def test_a_hot_direction_of_unequal_vectors(spark, kind):
    """A third of the rows tie by their rounded similarity although no two have the same floats."""
    rng = np.random.default_rng(3)
    x = _clustered(600, 2)
    x[200:400] = x[0] * rng.uniform(0.3, 3, (200, 1)) if kind == "scaled" else x[0] * (1 + 1e-5 * rng.normal(size=(200, 64)))
    ids = [f"c{i:04d}" for i in rng.permutation(600)]
    got = {(r["id"], r["neighbour"]) for r in nearest(_frame(spark, ids, x), shard=64).collect()}
    want = brute_force(ids, x)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    hot = {ids[0], *ids[200:400]}
    assert {p for p in got if p[0] in hot} == {p for p in want if p[0] in hot}


@pytest.mark.parametrize("shard,flat", [(32, 2), (64, 4), (16, 512)])
def test_nested_centres_and_versions(spark, shard, flat):
    x = _clustered(1500, 4)
    ids = [f"c{i:04d}" for i in range(len(x))]
    rows = [(i, 2, [float(a) for a in v]) for i, v in zip(ids, x)] + [(i, 1, [float(a) for a in v]) for i, v in zip(ids, x[::-1])] + [(i, None, [1.0] * 64) for i in ids[:9]] + [("gone", 1, [1.0] * 64), ("gone", 2, None)]
    got = {(r["id"], r["neighbour"]) for r in nearest(spark.createDataFrame(rows, "id string, v int, embedding array<float>"), shard=shard, flat=flat, version="v").collect()}
    want = brute_force(ids, x)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_empty_and_lone(spark):
    assert nearest(_frame(spark, [], [])).count() == 0
    assert nearest(_frame(spark, ["a"], [[1.0] * 64])).count() == 0


def test_memory_of_a_search_is_bounded(spark):
    """A worker holds the graph of a part and what a few of its vectors find, not what all of them find."""
    x = _clustered(24_000, 5)
    rows = spark.createDataFrame(pa.table({"id": [f"c{i:05d}" for i in range(len(x))], "embedding": pa.array(list(x), pa.list_(pa.float32()))})).repartition(4).cache()
    rows.count()
    workers = lambda: [Path(f"/proc/{p.pid}") for p in psutil.Process().children(recursive=True) if any("pyspark.daemon" in a for a in p.cmdline())]
    for p in workers():
        (p / "clear_refs").write_text("5")  # peaks begin anew
    assert nearest(rows, shard=len(x)).count() > 4 * len(x)
    peak = max(int(re.search(r"VmHWM:\s+(\d+)", (p / "status").read_text())[1]) / 1024 for p in workers())
    rows.unpersist()
    assert peak < 400


def test_groups_that_span_batches(spark):
    x = _clustered(900, 6)
    ids = [f"c{i:04d}" for i in range(len(x))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = {(r["id"], r["neighbour"]) for r in nearest(_frame(spark, ids, x), shard=100, margin=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_force(ids, x)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
