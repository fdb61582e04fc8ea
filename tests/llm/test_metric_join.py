import random

import pytest
from pyspark.sql import functions as F

from orrery.llm.metric_join import classes, components, expand, groups, pooled, similar_pairs


def _brute(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def _sets(seed, hot):
    r = random.Random(seed)
    out = {}
    for f in range(30):
        base = [f"v{r.randrange(3000)}" for _ in range(r.randrange(6, 25))]
        for m in range(r.randrange(1, 6)):
            s = set(base)
            for _ in range(r.randrange(0, 5)):
                s.discard(r.choice(base)) if r.random() < 0.5 else s.add(f"v{r.randrange(3000)}")
            out[f"f{f:02d}m{m}"] = s
    common = [f"h{i}" for i in range(14)]  # a family that shares its values, partly near
    for i in range(hot):
        out[f"hot{i:03d}"] = set(r.sample(common, 10)) | {f"o{r.randrange(40)}" for _ in range(r.randrange(0, 8))}
    out["copy1"], out["copy2"] = set(out["f00m0"]), set(out["f00m0"])
    return out


@pytest.mark.parametrize("t,cap,block,values", [(0.7, 16, 512, 1), (0.7, 16, 512, 3), (0.8, 8, 10, 2), (0.5, 20, 512, 1), (0.5, 10, 7, 2)])
def test_equals_brute_force(spark, t, cap, block, values):
    sets = _sets(3, 150)
    recs = spark.createDataFrame([(k, list(v), "x") for k, v in sets.items()], "id string, vals array<string>, rep string").select("id", F.array_sort("vals").alias("vals"))
    reps, members = classes(recs.union(recs))
    pairs = similar_pairs(reps, t, cap=cap, values=values, pivots=5, block=block)
    got = [(r["id_a"], r["id_b"]) for r in expand(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(sets, t)


def test_groups_count_links_and_components(spark):
    sets = {"a": {1, 2, 3, 4}, "b": {1, 2, 3, 4}, "c": {1, 2, 3, 4, 5}, "d": {9, 8}}
    recs = spark.createDataFrame([(k, sorted(map(str, v))) for k, v in sets.items()], "id string, vals array<string>")
    reps, members = classes(recs)
    got = {r["id"]: (r["class_id"], r["links"]) for r in groups(similar_pairs(reps, 0.7), members).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("a", 2), "d": ("d", 0)}


def test_long_chain_is_one_component(spark):
    pairs = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "a string, b string")
    assert {r["component"] for r in components(pairs).collect()} == {"000"}


def test_nulls_and_empty(spark):
    d = spark.createDataFrame([(None, ["b", None, "b"], "z")], "x array<string>, y array<string>, z string")
    assert d.select(pooled(F.col("x"), F.col("y"), F.array("z")).alias("p")).first()["p"] == ["b", "z"]
    recs = spark.createDataFrame([], "id string, vals array<string>")
    reps, members = classes(recs)
    assert expand(similar_pairs(reps, 0.7), members).count() == 0
    assert classes(spark.createDataFrame([("a", [])], "id string, vals array<string>"))[0].count() == 0


@pytest.mark.parametrize("t", [0.2, 0.34, 0.5, 0.7])
def test_small_sets_that_share_no_further_value(spark, t):
    """{x} and {x, y} in a region of more sets than the cap."""
    sets = {"a": {"x"}, "b": {"x", "z"}, "c": {"x", "z", "w"}} | {f"d{i:02d}": {"x", f"y{i}"} for i in range(30)} | {f"e{i:02d}": {"x", "z", f"w{i}"} for i in range(30)}
    recs = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, vals array<string>")
    reps, members = classes(recs)
    got = [(r["id_a"], r["id_b"]) for r in expand(similar_pairs(reps, t), members).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(sets, t)
