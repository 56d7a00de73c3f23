"""The Porter stemmer (Porter, 1980), one word at a time; applied to distinct terms only, see analyze.stemmed."""

from __future__ import annotations

_VOWELS = set("aeiou")


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(shape, shape[1:]) if not a and b)


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
_STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def _swap(w: str, rules: dict[str, str]) -> str:
    for end in sorted(rules, key=len, reverse=True):
        if w.endswith(end):
            root = w[: -len(end)]
            return root + rules[end] if _measure(root) > 0 else w
    return w


def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in _STEP4:
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root[-1:] in ("s", "t")):
                w = root
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w
