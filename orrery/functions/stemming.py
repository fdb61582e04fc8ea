"""The English stemmer of the Snowball project (Porter2), from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words that the description lists with their stems (fixed values).
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(w: str, start: int = 0) -> int:
    m = re.search(f"[{_V}][^{_V}]", w[start:])
    return start + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"(?:^|[^{_V}])[{_V}][^{_V}wxY]$", w) if len(w) > 2 else re.fullmatch(rf"[{_V}][^{_V}]", w))


@lru_cache(maxsize=65536)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub(rf"^y|(?<=[{_V}])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    if w.endswith(("eed", "eedly")):
        if len(re.sub(r"(eedly|eed)$", "", w)) >= r1:
            w = re.sub(r"(eedly|eed)$", "ee", w)
    else:
        m = re.search(r"(ingly|edly|ing|ed)$", w)
        if m and re.search(f"[{_V}]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for s in sorted(_STEP2, key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + _STEP2[s]
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    # 3
    for s in sorted(_STEP3, key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + _STEP3[s]
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
