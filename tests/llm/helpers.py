"""Fixtures that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, d long, node long, kept boolean"
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode().translate(_LOWER))


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    names = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzé", k=3 + i % 6)) for i in range(vocabulary)]
    return " ".join(r.choice(names) for _ in range(n))


def docs(spark, texts: list[tuple[int | None, str | None]]):
    """Documents with columns whose names operators might use themselves."""
    rows = [(i, t, "en", "src0", len(t) if t else None, 0.5, "x", 7, 8, True) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd_texts() -> list[tuple[int | None, str | None]]:
    base, other = prose(1, 300), prose(2, 300)
    near = " ".join([*base.split()[:-2], "changed", "end"])
    long = " ".join(prose(100 + i, 2000) for i in range(20))
    return [
        (1, base), (2, base), (3, near), (4, other), (5, None), (6, ""), (7, "  \n\t "), (8, "one"), (9, "one two"), (10, "One  TWO"), (11, long), (12, long + " more"), (13, f"{other[:900]} {prose(3, 200)}"), (14, "ab " * 500),
        (15, "é" * 700), (16, "🙂 naïve \x00 text " * 30), (None, base), (None, None), (4, other), (17, "x" * 199), (18, "x" * 200), (19, "x" * 201), (-5, prose(4, 50)), (1 << 62, prose(5, 50)),
    ]
