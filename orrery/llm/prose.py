"""Per-document text quality statistics, and prose told apart from other structures.

A text is cut into blocks at blank lines. For each block two distributions are taken: of its words over classes of
function words (for each language), and of its characters over character classes. Both are compared by
Jensen-Shannon divergence with profiles: one of running prose per language, and one per kind of other structure. The
nearest profile names the block; the share of a document's characters in blocks nearest to prose is its prose share.
Blocks of letters that are nearest to no prose profile are compared once more, by rhythm, with prose of any
language (`rhythm`). Profiles are computed from exemplars with the same code. Texts stream through once; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.rhythm import reads_as_prose

#: A word begins with a letter; what follows belongs to it, so that the parts of an identifier are no words of their own.
WORD = re.compile(r"\b[^\W\d]\w*")
GAP = re.compile(r"\n[^\S\n]*\n\s*")

#: Function words by language and class.
FUNCTION_WORDS = {
    "en": {
        "article": "a an the this that these those each every any some all both another such",
        "preposition": "of in on at by to from for with without into over under behind beside before after until since about through between against during off out up down",
        "conjunction": "and or but so because although though if when while than then as nor yet whether unless",
        "pronoun": "it its itself he she they we you him her them us our your their his what which who whom whose how why where there here one nobody everyone",
        "auxiliary": "is are was were be been being am do does did has have had will would should could can may might must cannot",
        "adverb": "not no never nothing only just also still already more most much many very too now again once ago soon",
    },
    "de": {
        "article": "der die das den dem des ein eine einen einem einer eines kein keine keinen jeder jede jedes dieser diese dieses alle",
        "preposition": "in im an am auf aus bei beim mit nach von vom zu zum zur für über unter um durch ohne gegen seit bis vor hinter zwischen wegen",
        "conjunction": "und oder aber wenn weil da ob dass als wie sobald sondern denn damit während bevor nachdem",
        "pronoun": "es er sie wir ihr ich man sich uns euch ihm ihn ihnen was wer wo warum wieso welche welcher niemand seinem seiner seine ihre ihren unser",
        "auxiliary": "ist sind war waren sei wird werden wurde wurden worden hat haben hatte hatten kann können konnte muss müssen musste soll sollte darf",
        "adverb": "nicht nur noch auch schon nun jetzt sehr mehr immer nie wieder erst dann bereits bitte hier dort nichts",
    },
    "fr": {
        "article": "le la les un une des du l ce cet cette ces chaque tout toute tous toutes aucun aucune",
        "preposition": "de à au aux en dans sur sous par pour avec sans chez vers entre depuis pendant après avant contre d",
        "conjunction": "et ou mais si que qu quand car donc comme lorsque puisque parce afin ni",
        "pronoun": "il elle on ils elles nous vous je se s y qui quoi dont où son sa ses leur leurs notre votre lui personne rien c",
        "auxiliary": "est sont était étaient a ont avait avons avez être été faut peut peuvent doit doivent fait sera avoir ait",
        "adverb": "ne n pas plus jamais encore déjà très aussi bien toujours enfin ici là maintenant seulement",
    },
    "es": {
        "article": "el la los las un una unos unas este esta estos estas ese esa cada todo toda todos todas ningún ninguna",
        "preposition": "de del a al en con sin por para sobre entre hasta desde tras hacia según contra durante antes después",
        "conjunction": "y e o u pero si que cuando porque como aunque mientras sino pues ni donde",
        "pronoun": "se lo le les su sus él ella ellos nos yo me mi qué quién cuál quien cual nadie nada algo esto eso",
        "auxiliary": "es son era eran fue fueron está están estaba ha han había habían ser estar hay puede pueden debe deben hemos sido",
        "adverb": "no nunca ya más muy también solo sólo aún todavía siempre ahora aquí así bien",
    },
}

#: Short texts of each kind, from which the profiles are computed. Prose first.
EXEMPLARS = {
    "prose_en": "We were not sure why the first run failed, so we looked at the log and tried it again. The problem is that a reader can see half of a record while another process is still writing it. If you change this setting, please tell the others about it, because some of them rely on the old value. It was late, and nobody had time for a second look.",
    "prose_de": "Wir haben den Fehler erst am Abend gefunden, weil niemand mit einer so kleinen Ursache gerechnet hatte. Der Bericht wird nicht mehr jede Nacht erstellt, sondern nur noch, wenn sich die Daten ändern. Wer das anders sieht, kann es gern in der nächsten Runde sagen. Die Liste ist zu lang, und man muss sie vor dem Druck kürzen.",
    "prose_fr": "Nous avons trouvé la cause du problème dans la soirée, mais il était trop tard pour tout corriger. Le rapport n'est plus produit chaque nuit, il l'est seulement quand les données changent. Si vous n'êtes pas d'accord, dites-le à la prochaine réunion. La liste est trop longue et il faut la réduire avant de l'envoyer.",
    "prose_es": "Encontramos la causa del problema por la tarde, pero ya era tarde para corregir todo lo que faltaba. El informe no se genera cada noche, sino solo cuando los datos cambian. Si alguien no está de acuerdo, lo puede decir en la próxima reunión. La lista es demasiado larga y hay que acortarla antes de enviarla.",
    "list": "- [ ] green lamp\n- [x] table cloth\n- paper box\n* window\n* door handle\n1. river stone\n2. copper kettle\n3. garden\n",
    "comma list": "apple, pear, lamp, stone, river, kettle, window,\ngarden, copper, paper, door, handle, carpet, spoon,\n",
    "table": "| name | size | share |\n|---|---|---|\n| lamp | 120 | 0.25 |\n| 881 | stone | 0.5 |\n| kettle | 42 | 0.125 |\n",
    "columns": "lamp          120           stone\n42            kettle        881\n7             35            river         19\n",
    "records": "lamp.size=120\nriver.open=true\nstone.name: null\nkettle.state -> closed\ndoor.width := 42\ncarpet.colour = red\n",
    "log": "2024-03-01T12:30:05Z INFO lamp.kettle took=120ms id=ab12cd34ef\n2024-03-01 12:30:06,120 ERROR [river-1] stone.door code=500 user=42\n",
    "trace": "    at openWindow (house/room.ts:12:34)\n    at closeDoor (garden/gate.ts:256:7)\n  File \"lamp/switch.py\", line 88, in turn\n    at Kettle.boil(Kettle.java:120)\n",
    "markup": "<div class=\"lamp\"><p>stone 12</p></div>\n<li id=\"river\">kettle</li>\n<a href=\"/door/7\">window</a>\n<td>42</td><td>paper</td>\n",
    "code": "def open_window(room, width=None):\n    if room.width > 12:\n        items.append(make_lamp(room))\n    return width\nfunction closeDoor(gate) {\n  const lamp = gate.filter((x) => x.size > 3);\n  return lamp[0];\n}\npub fn boil(k: &str) -> u64 {\n    let t = k.len() + 3;\n    t\n}\nprivate void paint(String wall, int coats) {\n    this.coats++;\n}\n",
    "paths": "house/garden/gate.ts  +12 -3\nriver/stone/bridge-arch.py\nlamp/switch/wire_copper.go  +120 -44\n/usr/lib/kettle.so\n",
    "navigation": "house > garden > gate [edit]\nriver > bridge | next\nhome | about | contact | previous\nlamp > switch > wire\n",
    "bare words": "Copper lamp window river stone narrow kettle garden door;\nPaper carpet spoon wide handle bridge quiet table.\nStone green river gate lamp early copper window garden\n",
    "encoded": "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgcHJvc2U+/kx9QmZ0YWJsZSBvZiBieXRl\nc0FuZE1vcmVCeXRlczEyMzQ1Njc4OTBhYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5\n4f2a9c0b77de11aa90ffe3d2c1b0a9987766554433221100ffeeddccbbaa9988\n",
    "damaged": "Ã©Ã¼ â€™Ð¿ laÂ Ã¼ï¿½�Ã© stoÐ¿ â€™�� Ã¼rivÂÃ©\nâ€œÐ¿Ã¤Ã¶ kaÃ©�Â Ã¼â€™ Ð¿Ð¿Ã©\n",
    "noise": "4$k!9x&%#2@~q|7<>^*a=+\\3_?z-/8 !b$%e5^&c|~x#@9=*<6>q+2\\_/-?\n%1#a@!|7=~x$<9&^*+3q\\>_2e-/?z 5!c\n",
    "keyboard": "asdf jkl; ghgh sdfkj;l qwpeoir sldkfj ;alskd ghfj\nlkjh; fdsa hjkl gfds ;lkj trewq poiuy asdfgh\n",
}

#: Letters count alike in either case, since prose may be cased in any way; a capital inside a word is its own class.
CLASSES = ("letter", "accented", "inner capital", "digit", "blank", "break", "sentence", "quote", "joiner", "bracket", "symbol", "odd")
_LANGS = list(FUNCTION_WORDS)
_KINDS = ("article", "preposition", "conjunction", "pronoun", "auxiliary", "adverb")
_NAMES = list(EXEMPLARS)
_PROSE = sum(n.startswith("prose") for n in _NAMES)
#: What a block may be: nearest to an exemplar, or prose of a language that has none.
KINDS = [*_NAMES, "prose_other"]
_LETTERS = [CLASSES.index(c) for c in ("letter", "accented", "inner capital", "odd")]
_SPACE = [CLASSES.index(c) for c in ("blank", "break")]


def _char_table() -> np.ndarray:
    t = np.full(0x110000, CLASSES.index("odd"), np.uint8)
    for cp in range(0x2000):
        c = chr(cp)
        if cp < 128:
            if c.isalpha():
                k = "letter"
            elif c.isdigit():
                k = "digit"
            elif c in "\n\r":
                k = "break"
            elif c.isspace():
                k = "blank"
            elif c in ".,;:!?":
                k = "sentence"
            elif c in "'\"`":
                k = "quote"
            elif c in "-_":
                k = "joiner"
            elif c in "()[]{}<>":
                k = "bracket"
            elif cp >= 32:
                k = "symbol"
            else:
                k = "odd"
        elif c in "¿¡":
            k = "sentence"
        elif c in "«»\xa0":
            k = "quote"
        elif c.isalpha() and c.islower():
            k = "accented"
        elif c in "ÄÖÜÉÈÀÂÊÇÑÁÍÓÚÎÔ":
            k = "accented"
        else:
            k = "odd"
        t[cp] = CLASSES.index(k)
    for c in "‘’“”„–—…":
        t[ord(c)] = CLASSES.index("quote")
    return t


def _word_table() -> tuple[dict[str, int], np.ndarray]:
    """Each function word's number, and for each number its class in each language, one-hot."""
    number: dict[str, int] = {}
    rows = []
    for i, lang in enumerate(_LANGS):
        for j, kind in enumerate(_KINDS):
            for w in FUNCTION_WORDS[lang][kind].split():
                if w not in number:
                    number[w] = len(rows)
                    rows.append(np.zeros(len(_LANGS) * len(_KINDS)))
                if not rows[number[w]][i * len(_KINDS) : (i + 1) * len(_KINDS)].any():
                    rows[number[w]][i * len(_KINDS) + j] = 1
    return number, np.array(rows)


_CHARS: np.ndarray | None = None
_NUMBER, _CLASS = _word_table()


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log2(np.maximum(x, 1e-300)), 0.0)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p to each row of q."""
    hp, hq = _xlogx(p).sum(-1), _xlogx(q).sum(-1)
    out = np.empty((len(p), len(q)))
    for j in range(len(q)):
        out[:, j] = (hp + hq[j]) / 2 - _xlogx((p + q[j]) / 2).sum(-1)
    return np.maximum(out, 0)


def _features(blocks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: words per language and class (blocks, languages, classes + other), characters per class, words."""
    global _CHARS
    if _CHARS is None:
        _CHARS = _char_table()
    n = len(blocks)
    code = np.frombuffer("".join(blocks).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _CHARS[code]
    inner = (code[1:] >= 65) & (code[1:] <= 90) & (code[:-1] >= 97) & (code[:-1] <= 122)
    cls[1:][inner] = CLASSES.index("inner capital")
    ends = np.cumsum([len(b) for b in blocks])
    chars = np.empty((n, len(CLASSES)))
    lo = 0
    for i, hi in enumerate(ends):
        chars[i] = np.bincount(cls[lo:hi], minlength=len(CLASSES))
        lo = hi
    get = _NUMBER.get
    codes: list[int] = []
    per, total, letters = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, b in enumerate(blocks):
        w = WORD.findall(b.lower())
        total[i] = len(w)
        letters[i] = sum(map(len, w))
        got = [c for c in map(get, w) if c is not None]
        per[i] = len(got)
        codes += got
    where = np.repeat(np.arange(n), per)
    at = _CLASS[np.array(codes, np.int64)] if codes else np.zeros((0, _CLASS.shape[1]))
    words = np.stack([np.bincount(where, at[:, c], n) for c in range(_CLASS.shape[1])], 1).reshape(n, len(_LANGS), len(_KINDS))
    words = np.concatenate([words, (total[:, None] - words.sum(2))[:, :, None]], 2)
    return words, chars, np.stack([total, letters], 1)


def _shares(x: np.ndarray) -> np.ndarray:
    s = x.sum(-1, keepdims=True)
    return np.where(s > 0, x / np.maximum(s, 1), 1.0 / x.shape[-1])


def _profiles() -> tuple[np.ndarray, np.ndarray]:
    words, chars, _ = _features(list(EXEMPLARS.values()))
    by_lang = _shares(words)
    none = np.eye(words.shape[2])[-1]  # other structures have no function words to speak of, save code its keywords
    w = np.stack([by_lang[i, i] if i < _PROSE else (by_lang[i, 0] + none) / 2 if n == "code" else none for i, n in enumerate(_NAMES)])
    return w, _shares(chars)


_PROFILES: tuple[np.ndarray, np.ndarray] | None = None


def _two(share: np.ndarray) -> np.ndarray:
    """Function words against all others."""
    return np.stack([1 - share[..., -1], share[..., -1]], -1)


def classify(blocks: list[str], mix: float = 0.15) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each block, the divergence of its nearest profile, counts (words, letters, function words, characters by class), all divergences.

    A block's divergence from a profile is that of its characters, of its share of function words, and `mix` times
    that of the classes of function words, of which a short block shows only some.
    """
    global _PROFILES
    if _PROFILES is None:
        _PROFILES = _profiles()
    pw, pc = _PROFILES
    words, chars, counts = _features(blocks)
    share = _shares(words)
    share[counts[:, 0] == 0] = np.eye(words.shape[2])[-1]
    dist = divergence(_shares(chars), pc)
    best = share[np.arange(len(blocks)), share[:, :, -1].argmin(1)]
    dist[:, _PROSE:] += divergence(_two(best), _two(pw[_PROSE:])) + mix * divergence(best, pw[_PROSE:])
    for i in range(_PROSE):
        dist[:, i] += divergence(_two(share[:, i]), _two(pw[i : i + 1]))[:, 0] + mix * divergence(share[:, i], pw[i : i + 1])[:, 0]
    near = dist.argmin(1)
    worded = chars[:, _LETTERS].sum(1) >= 0.7 * (chars.sum(1) - chars[:, _SPACE].sum(1))
    for i in np.nonzero((near >= _PROSE) & worded)[0]:
        if reads_as_prose(blocks[i]):
            near[i] = len(_NAMES)
    common = words.shape[0] and counts[:, 0] - words[:, :, -1].min(1)
    return near, dist.min(1), np.column_stack([counts, common, chars]), dist


#: Columns of `quality`.
SCHEMA = (
    "doc_id long, chars long, words long, mean_word_length double, symbol_ratio double, lines long, punctuated_lines long, punctuated_share double, "
    "common_word_share double, blocks int, prose_share double, profile string, divergence double"
)


def quality(documents: DataFrame) -> DataFrame:
    """One row of statistics per document with a text (SCHEMA).

    Words begin with a letter and run on over letters, digits and underscores; symbols are characters that are neither letters, digits, blanks nor sentence
    punctuation; lines are the non-blank ones. `profile` is the structure with most characters, `divergence` its
    blocks' mean, weighted by length. A blank text has zero words, null ratios and the profile `blank`; null texts
    have no row; repeated rows repeat. Texts are taken whole.
    """
    sym = [CLASSES.index(c) for c in ("joiner", "bracket", "symbol", "odd", "quote")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: list[str] = []
        owner: list[int] = []
        lines = np.zeros(len(pdf), np.int64)
        stopped = np.zeros(len(pdf), np.int64)
        for i, t in enumerate(pdf["text"]):
            own = [b for b in GAP.split(t) if b and not b.isspace()]
            blocks += own
            owner += [i] * len(own)
            ends = [x.rstrip()[-1:] for x in t.split("\n")]
            lines[i] = len(ends) - ends.count("")
            stopped[i] = sum(e in ".!?:;…" for e in ends if e)
        n = len(pdf)
        at = np.array(owner, np.int64)
        near, dist, counts, _ = classify(blocks) if blocks else (np.zeros(0, int), np.zeros(0), np.zeros((0, 3 + len(CLASSES))), None)
        size = np.array([len(b) for b in blocks], np.float64)
        total = lambda x: np.bincount(at, x, n)
        in_blocks = total(size)
        by = np.zeros((n, len(KINDS)))
        np.add.at(by, (at, near), size)
        words, letters, common = (total(counts[:, k]) for k in range(3))
        symbols = total(counts[:, [3 + s for s in sym]].sum(1))
        some = in_blocks > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            return pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "chars": [len(t) for t in pdf["text"]], "words": words.astype(np.int64),
                "mean_word_length": letters / words, "symbol_ratio": symbols / in_blocks, "lines": lines, "punctuated_lines": stopped,
                "punctuated_share": stopped / lines, "common_word_share": common / words, "blocks": np.bincount(at, minlength=n).astype(np.int32),
                "prose_share": np.where(some, (by[:, :_PROSE].sum(1) + by[:, -1]) / in_blocks, np.nan),
                "profile": np.where(some, np.array(KINDS, object)[by.argmax(1)], "blank"), "divergence": np.where(some, total(size * dist) / in_blocks, np.nan),
            })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                yield one(pdf.iloc[lo : lo + 512])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    out = docs.mapInPandas(run, SCHEMA)
    ratios = ["mean_word_length", "symbol_ratio", "punctuated_share", "common_word_share", "prose_share", "divergence"]
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ratios})
