import re

from orrery.llm.splitting import split_items

ITEM = "scope string, id string, path string, start_line int, end_line int, limit int, overlap int, lines string"
TEXT = "scope string, path string, content string, id string"


def _letter(x):
    if re.match(r"^\s*$", x) or re.match(r"^[\])}]+[;,]?\s*$", x):
        return "A"
    if re.match(r"^\s+[\])}]+[;,]?\s*$", x):
        return "B"
    return "C" if re.search(r"[;}]\s*$|^\s*(return|pass|break|continue)\b", x) else "D"


def _cut(letters, limit, overlap):
    """Greedy by hand: the furthest strongest boundary in the upper half of the room, else the full room."""
    out, at = [], 0
    while at < len(letters):
        room = limit if at == 0 else limit - overlap
        left = len(letters) - at
        if at and left <= room:
            out.append(left)
            break
        low = max(0, room // 2 - 1, 0 if at else overlap - 1)
        n = next((k for s in "ABC" for k in range(min(room, left), low, -1) if letters[at + k - 1] == s), min(room, left))
        out.append(n)
        at += n
    return out


def test_pieces_equal_the_rule_and_cover_the_item(spark):
    src = ["fn a() {"] + [["  x;", "", "  y,", "  }", "  return 1", "}"][i % 6 if i % 7 else 2] for i in range(200)]
    for limit, overlap in ((10, 0), (10, 3), (7, 6), (1, 0), (80, 10)):
        items = spark.createDataFrame([("p", "i", "f", 3, 180, limit, overlap, "x")], ITEM)
        got = split_items(items, spark.createDataFrame([("p", "f", "\r\n".join(src), "z")], TEXT)).orderBy("piece").collect()
        body = src[2:180]
        sizes = _cut("".join(map(_letter, body)), limit, overlap)
        ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
        assert [r["last_line"] for r in got] == [2 + e for e in ends]
        for k, r in enumerate(got):
            assert r["last_line"] - r["first_line"] + 1 <= limit
            assert r["first_line"] == 3 + ends[k] - sizes[k] - (overlap if k else 0)
            assert r["text"] == "\n".join(src[r["first_line"] - 1 : r["last_line"]])


def test_edges(spark):
    items = spark.createDataFrame(
        [
            ("p", "notext", "gone", 1, 500, None, None, ""), ("p", "nopath", None, 1, 500, 5, None, ""), ("p", "fits", "f", 1, 5, 5, 2, ""), ("p", "null", "f", None, 50, 5, 0, ""),
            ("p", "clipped", "f", 4, 2_000_000_000, 10, 0, ""), ("p", "outside", "f", 90, 400, 10, 0, ""), ("p", "backwards", "f", 9, 2, 5, 0, ""), ("p", "twice", "f", 1, 8, 3, 99, ""), ("p", "twice", "f", 1, 8, 3, 99, ""),
        ],
        ITEM,
    )
    got = split_items(items, spark.createDataFrame([("p", "f", "a\nb\nc\nd\ne\nf\ng\nh", "z")], TEXT))
    by = {}
    for r in got.orderBy("piece").collect():
        by.setdefault(r["id"], []).append((r["boundary"], r["first_line"], r["last_line"]))
    assert set(by) == {"notext", "nopath", "clipped", "outside", "twice"}
    assert by["notext"] == [("unlocated", 1, 500)] and by["outside"][0][0] == "unlocated" and by["clipped"] == [("whole", 4, 8)]
    assert by["twice"][0][1:] == (1, 3) and by["twice"][1][1:] == (2, 4) and by["twice"][-1][2] == 8 and len(by["twice"]) == 6


def test_empty(spark):
    assert split_items(spark.createDataFrame([], ITEM), spark.createDataFrame([], TEXT)).count() == 0
