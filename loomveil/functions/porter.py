"""The Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980), as a table of rules."""

from __future__ import annotations

import re

_STEP2 = "ational ate|tional tion|enci ence|anci ance|izer ize|abli able|alli al|entli ent|eli e|ousli ous|ization ize|ation ate|ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble|logi log"
_STEP3 = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _pairs(rules: str) -> list[tuple[str, str]]:
    return sorted(((r.split(" ")[0], r.split(" ")[1]) for r in rules.split("|")), key=lambda x: -len(x[0]))


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or with other than a-z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                base = w[: -len(end)]
                if "v" in _shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        w = base + "e"
                    elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                        w = base[:-1]
                    else:
                        w = base + "e" if _measure(base) == 1 and _cvc(base) else base
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_pairs(_STEP2), _pairs(_STEP3)):
        for end, new in rules:
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) else w
                break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or m == 1 and not _cvc(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w
