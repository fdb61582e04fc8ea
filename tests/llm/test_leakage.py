import random

from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm.leakage import leaks, myers, words


def _distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=30))
def test_myers_is_the_edit_distance(p, t):
    assert myers(p, t) == _distance(p, t)


def test_words():
    assert words("Don't STOP_now, ärger 4x4—été") == ["don", "t", "stop", "now", "ärger", "4x4", "été"]


def test_equals_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = {i: [r.choice(vocab) for _ in range(r.randrange(5, 60))] for i in range(40)}
    docs = {}
    for d in range(200):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(0, 3)):
            src = items[r.randrange(40)]
            n = r.randrange(6, 20)
            s = r.randrange(0, max(1, len(src) - n))
            part = list(src[s : s + n])
            if part and r.random() < 0.4:
                part[r.randrange(len(part))] = "zzz"
            at = r.randrange(0, len(w) + 1)
            w[at:at] = part
        docs[d] = w
    sep = [" ", "\n", ", ", "  -- ", "/"]
    dd = spark.createDataFrame([(d, "".join(x.upper() + r.choice(sep) for x in w), "c") for d, w in docs.items()] + [(900, None, "c"), (901, "  ", "c"), (None, "x", "c")], "doc_id long, text string, item_id string")
    ii = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None)], "item_id long, text string")
    for errors in (0, 1):
        got = {(x["doc_id"], x["item_id"]) for x in leaks(dd.union(dd), ii.union(ii), errors=errors, block=17).where("run >= 13").collect()}
        grams = {i: {tuple(w[k : k + 13]) for k in range(len(w) - 12)} for i, w in items.items()}
        want = {(d, i) for d, w in docs.items() for i in items if grams[i] & {tuple(w[k : k + 13]) for k in range(len(w) - 12)}}
        assert got == want
    near = {(x["doc_id"], x["item_id"]) for x in leaks(dd, ii, errors=1).collect()}
    brute = {(d, i) for d, w in docs.items() for i, v in items.items() if any(_distance(v[k : k + 13], w) <= 1 for k in range(len(v) - 12))}
    assert near == brute


def test_empty(spark):
    no = spark.createDataFrame([], "doc_id long, text string")
    it = spark.createDataFrame([], "item_id long, text string")
    assert leaks(no, it).count() == 0
