import pytest

from language_cases import LISTS
from language_cases import PROSE as FOREIGN
from orrery.llm.prose import KINDS, classify, divergence, quality, _NAMES, _PROSE
from orrery.llm.rhythm import reads_as_prose

import numpy as np

PROSE = [
    "The committee met on Tuesday and decided that the old bridge should be closed until it has been repaired.",
    "WE WERE TOLD THAT THE TRAIN WOULD BE LATE, BUT IT WAS NOT.",
    "we waited for an hour\nand then we went home because\nnobody had come to open the door",
    "Die Kinder spielten im Garten, während ihre Eltern das Essen auf den Tisch stellten.",
    "Il n'y avait plus de pain dans la maison, et nous sommes allés au village.",
    "Cuando llegamos a la estación, el tren ya había salido y no quedaba nadie.",
]
OTHER = [
    "| a | 12 | 0.5 |\n|---|---|---|\n| b | 13 | 0.25 |\n| c | 14 | 0.125 |", "alpha, beta, gamma, delta, epsilon, zeta, eta, theta,\niota, kappa, lambda, mu, nu, xi,",
    "2023-01-01T00:00:00Z INFO web.server took=12ms id=ff00aa11\n2023-01-01T00:00:01Z WARN web.db took=900ms id=ff00aa12",
    "    at run (app/main.ts:10:5)\n    at start (app/boot.ts:99:1)\n    at go (app/x.ts:1:1)", "<ul><li class=\"x\">one</li><li>two</li></ul>\n<p id=\"q\">three</p>",
    "for (int i = 0; i < n; i++) {\n    total += values[i] * 2;\n    if (total > 10) return total;\n}", "src/a/b.py\nsrc/a/c-d.go  +10 -2\nlib/x/y.ts",
    "Purple kettle mountain river copper stone; Window lamp garden table narrow bridge quiet.", "TWFuIGlzIGRpc3Rpbmd1aXNoZWQsIG5vdCBvbmx5IGJ5IGhpcyByZWFzb24sIGJ1dCBieSB0aGlz\nc2luZ3VsYXIgcGFzc2lvbg==",
    "k=v\nname: null\nsize = 10\na.b.c := 7\nx -> y",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert classify([text])[0][0] < _PROSE


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    assert classify([text])[0][0] >= _PROSE


def _is_prose(text):
    return KINDS[classify([text])[0][0]].startswith("prose")


@pytest.mark.parametrize("language", list(FOREIGN))
def test_prose_of_other_languages(language):
    text = FOREIGN[language]
    assert _is_prose(text) and _is_prose(text.upper()) and _is_prose(text.replace(" ", "\n", 60).replace("\n", " ", 9) if language in ("zh", "ja") else text)
    words = text.split(" ")
    if len(words) > 20:  # wrapped lines
        assert _is_prose("\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)))


@pytest.mark.parametrize("text", [x for v in LISTS.values() for x in v])
def test_lists_of_other_languages(text):
    assert not _is_prose(text) and not reads_as_prose(text)


@pytest.mark.parametrize("text", ["", "\n", "...", "Да.", "asdf jkl; ghgh sdfkj;l qwpeoir sldkfj ;alskd ghfj\nlkjh; fdsa hjkl gfds ;lkj", FOREIGN["ru"].encode().decode("cp1252", "replace"), FOREIGN["it"].replace("e", "\ufffd")])
def test_rhythm_of_what_is_no_prose(text):
    assert not reads_as_prose(text)


def test_divergence():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    d = divergence(p, p)
    assert np.allclose(np.diag(d), 0) and np.allclose(d, d.T) and 0 < d[0, 1] < 1
    assert np.isclose(divergence(np.array([[1.0, 0]]), np.array([[0, 1.0]]))[0, 0], 1)


def test_statistics(spark):
    rows = [(1, PROSE[0] + "\n\n" + OTHER[0] * 9, "x"), (2, "  \n ", "x"), (3, None, "x"), (4, "", "x"), (5, "😀 ok", "x"), (6, (PROSE[0] + "\n") * 5000, "x"), (6, "a\n\nb", "x")]
    got = quality(spark.createDataFrame(rows, "doc_id long, text string, words string")).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 6}
    assert 3 not in by and by[2]["profile"] == "blank" and by[2]["prose_share"] is None and by[4]["words"] == 0
    assert 0 < by[1]["prose_share"] < 0.5 and by[1]["blocks"] == 2
    assert sorted(r["words"] for r in got if r["doc_id"] == 6) == [2, 19 * 5000]
    assert len(got) == 6 and set(_NAMES)


def test_empty(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0
