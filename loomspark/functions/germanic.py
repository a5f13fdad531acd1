"""German, Swedish, Danish and Norwegian stems by the published Snowball rules for these languages."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published rules: vowels, endings of each step, letters that a deleted s or st may follow.
_GERMAN_VOWELS = "aeiouyäöü"
_GERMAN_S, _GERMAN_ST = "bdfghklmnrt", "bdfghklmnt"
_GERMAN_1 = ("em", "ern", "er", "e", "en", "es", "s")
_GERMAN_2 = ("en", "er", "est", "st")
_GERMAN_3 = ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit")
_SWEDISH_VOWELS = "aeiouyäåö"
_SWEDISH_S = "bcdfghjklmnoprtvy"
_SWEDISH_1 = tuple(
    "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s".split()
)
_SWEDISH_2 = ("dd", "gd", "nn", "dt", "gt", "kt", "tt")
_SWEDISH_3 = {"lig": "", "ig": "", "els": "", "löst": "lös", "fullt": "full"}
_DANISH_VOWELS = "aeiouyæåø"
_DANISH_S = "abcdfghjklmnoprtvyzå"
_DANISH_1 = tuple(
    "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s".split()
)
_DANISH_2 = ("gd", "dt", "gt", "kt")
_DANISH_3 = {"ig": "", "lig": "", "elig": "", "els": "", "løst": "løs"}
_NORWEGIAN_VOWELS = "aeiouyæåø"
_NORWEGIAN_S = "bcdfghjlmnoprtvyz"
_NORWEGIAN_1 = tuple("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert".split())
_NORWEGIAN_2 = ("dt", "vt")
_NORWEGIAN_3 = ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov")


def _behind(w: str, vowels: str, start: int = 0) -> int:
    """The place after the first consonant behind a vowel, from ``start`` on; the end without one."""
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _first_region(w: str, vowels: str) -> int:
    """Where R1 begins, never before the fourth letter."""
    return max(3, _behind(w, vowels)) if len(w) >= 3 else len(w)


def _ending(w: str, endings, start: int = 0) -> str:
    """The longest of the endings that lies in w[start:], or an empty string."""
    return max((e for e in endings if w.endswith(e) and len(w) - len(e) >= start), key=len, default="")


def _cut(w: str, ending: str) -> str:
    return w[: len(w) - len(ending)]


@lru_cache(maxsize=1 << 16)
def german(word: str) -> str:
    """The German stem of a lower-case word, without umlauts."""
    v = _GERMAN_VOWELS
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{v}])[uy](?=[{v}])", lambda m: m[0].upper(), w)
    r1 = _first_region(w, v)
    r2 = _behind(w, v, _behind(w, v)) if len(w) >= 3 else len(w)

    e = _ending(w, _GERMAN_1)
    if e and len(w) - len(e) >= r1:
        if e == "s":
            w = w[:-1] if w[-2] in _GERMAN_S else w
        else:
            w = _cut(w, e)
            w = w[:-1] if e in ("e", "en", "es") and w.endswith("niss") else w
    e = _ending(w, _GERMAN_2)
    if e and len(w) - len(e) >= r1 and (e != "st" or len(w) >= 6 and w[-3] in _GERMAN_ST):
        w = _cut(w, e)
    e = _ending(w, _GERMAN_3)
    if e and len(w) - len(e) >= r2:
        bare = _cut(w, e)
        if e in ("end", "ung"):
            w = _cut(bare, "ig") if _ending(bare, ("ig",), r2) and not bare.endswith("eig") else bare
        elif e in ("ig", "ik", "isch"):
            w = w if bare.endswith("e") else bare
        elif e == "keit":
            w = _cut(bare, _ending(bare, ("lich", "ig"), r2))
        else:
            w = _cut(bare, _ending(bare, ("er", "en"), r1))
    return w.translate(str.maketrans("UYäöü", "uyaou"))


@lru_cache(maxsize=1 << 16)
def swedish(word: str) -> str:
    """The Swedish stem of a lower-case word."""
    w, r1 = word, _first_region(word, _SWEDISH_VOWELS)
    e = _ending(w, _SWEDISH_1, r1)
    if e and (e != "s" or w[-2] in _SWEDISH_S):
        w = _cut(w, e)
    if _ending(w, _SWEDISH_2, r1):
        w = w[:-1]
    e = _ending(w, _SWEDISH_3, r1)
    return _cut(w, e) + _SWEDISH_3[e] if e else w


@lru_cache(maxsize=1 << 16)
def danish(word: str) -> str:
    """The Danish stem of a lower-case word."""
    w, r1 = word, _first_region(word, _DANISH_VOWELS)

    def paired(w: str) -> str:
        return w[:-1] if _ending(w, _DANISH_2, r1) else w

    e = _ending(w, _DANISH_1, r1)
    if e and (e != "s" or w[-2] in _DANISH_S):
        w = _cut(w, e)
    w = paired(w)
    w = w[:-2] if w.endswith("igst") else w
    e = _ending(w, _DANISH_3, r1)
    if e == "løst":
        w = w[:-1]
    elif e:
        w = paired(_cut(w, e))
    doubled = len(w) > max(r1, 1) and w[-1] not in _DANISH_VOWELS and w[-1] == w[-2]
    return w[:-1] if doubled else w


@lru_cache(maxsize=1 << 16)
def norwegian(word: str) -> str:
    """The Norwegian stem of a lower-case word."""
    w, r1 = word, _first_region(word, _NORWEGIAN_VOWELS)
    e = _ending(w, _NORWEGIAN_1, r1)
    if e in ("erte", "ert"):
        w = _cut(w, e) + "er"
    elif e == "s":
        w = w[:-1] if w[-2] in _NORWEGIAN_S or w[-2] == "k" and w[-3] not in _NORWEGIAN_VOWELS else w
    elif e:
        w = _cut(w, e)
    if _ending(w, _NORWEGIAN_2, r1):
        w = w[:-1]
    return _cut(w, _ending(w, _NORWEGIAN_3, r1))
