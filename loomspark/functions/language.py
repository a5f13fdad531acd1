"""The language of a text, by its script and its most common short words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

# Common words of languages written in Latin letters.
COMMON = {
    "english": "the of and to in is that it for was on with as be at by this have from or", "french": "le la les de des et est un une que dans pour qui sur pas au avec ce par plus",
    "german": "der die das und ist nicht ein eine mit von zu den auf für dem sich als auch es an", "spanish": "el la los las de que y en un una es por con no para su al lo como más",
    "italian": "il la le di che e un una per non con del della sono si da in come anche più", "portuguese": "o a os as de que e em um uma para com não por mais do da no na se", "dutch": "de het een en van in is dat op te zijn met voor niet aan er om ook als maar",
}
_WORDS = {w: [lang for lang, words in COMMON.items() if w in words.split()] for words in COMMON.values() for w in words.split()}
_SCRIPTS = (("japanese", "぀-ヿ"), ("korean", "가-힯"), ("chinese", "㐀-鿿"), ("russian", "Ѐ-ӿ"), ("greek", "Ͱ-Ͽ"), ("arabic", "؀-ۿ"))
HEAD = 8000


def detect(text: str | None) -> str:
    """A language name from the first HEAD characters. Scripts of their own decide alone; else the language whose common words take the
    largest share, English if none is clear."""
    head = (text or "")[:HEAD]
    letters = sum(c.isalpha() for c in head)
    for name, block in _SCRIPTS:
        if letters and len(re.findall(f"[{block}]", head)) * 3 >= letters:
            return name
    votes: dict[str, float] = {}
    words = re.findall(r"[^\W\d_]+", head.lower())
    for w in words:
        for lang in _WORDS.get(w, ()):
            votes[lang] = votes.get(lang, 0.0) + 1 / len(_WORDS[w])
    if not votes:
        return "english"
    best = max(votes, key=lambda x: (votes[x], x == "english"))
    return best if votes[best] * 20 >= len(words) else "english"


def detect_udf():
    """``detect`` on a column."""

    @F.pandas_udf("string")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(detect)

    return language
