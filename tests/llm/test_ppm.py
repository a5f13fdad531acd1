import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import ppm

from .helpers import docs, odd_texts, prose, words


class Brute:
    """Escape and exclusion, one byte at a time over whole texts; what a context gives is worked out once."""

    def __init__(self, texts):
        self.counts = [{} for _ in range(ppm.ORDER + 1)]
        for t in texts:
            b = bytes([0xFE] * ppm.ORDER) + t + b"\xff"
            for i in range(ppm.ORDER, len(b)):
                for k in range(ppm.ORDER + 1):
                    c = self.counts[k].setdefault(b[i - k : i], Counter())
                    c[b[i]] += 1
        self.known = {b"": self._over(np.full(256, 1 / 256), self.counts[0].get(b"", {}))}

    @staticmethod
    def _over(p, counted):
        if not counted:
            return p
        c = np.zeros(256)
        c[list(counted)] = list(counted.values())
        n, q = c.sum(), (c > 0).sum()
        rest = np.where(c > 0, 0, p)
        return (c + q * rest / rest.sum()) / (n + q) if rest.sum() else c / n

    def after(self, context):
        """The probabilities of all bytes after a context, from its longest part at the end that training saw."""
        while context and context not in self.counts[len(context)]:
            context = context[1:]
        if context not in self.known:
            self.known[context] = self._over(self.after(context[1:]), self.counts[len(context)][context])
        return self.known[context]

    def score(self, text):
        b = bytes([0xFE] * ppm.ORDER) + (text or "").encode() + b"\xff"
        return sum(math.log10(self.after(b[j - ppm.ORDER : j])[b[j]]) for j in range(ppm.ORDER, len(b)))


@pytest.mark.parametrize("frequent", [1 << 21, 50])
def test_scores_of_all_rows_against_brute_force(spark, monkeypatch, frequent):
    """Whole texts, all contexts, the rare ones too, broadcast and joined."""
    monkeypatch.setattr(ppm, "FREQUENT_GRAMS", frequent)
    rows = [*odd_texts(), *((400 + i, f"a passage that stands once: {prose(7000 + i, 40, 5000)}") for i in range(20)), *((200 + i, prose(i, 40)) for i in range(12))]
    train = [(t or "").encode() for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    model = Brute(train)
    assert sum(model.counts[0][b""].values()) > 4 << 16  # a context that occurs once or twice is below 1/65,536
    got = ppm.score(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r.held_out for r in got} == {True, False}
    for a, b in zip(sorted((str(r.doc_id), r.score) for r in got), sorted((str(i), model.score(t)) for i, t in rows), strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-5)


def test_probabilities_add_up_to_one():
    """Of the brute force that the tables are held against."""
    model = Brute([b"abracadabra", b"", b"aabb"])
    for context in (b"", b"a", b"abrac", b"zzzzz", b"\xfe\xfe\xfe\xfe\xfe"):
        assert math.isclose(model.after(context).sum(), 1, rel_tol=1e-9)


@pytest.mark.parametrize("frequent", [1 << 20, 50])
def test_word_model_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    rows = odd_texts() + [(300 + i, prose(i, 60)) for i in range(20)]
    c = Counter()
    for i, t in rows:
        if i is None:
            continue  # fold 0 is held out
        if zlib.crc32(str(i).encode()) % 10:
            c.update(words(t))
            c["end"] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = [*words(t), "end"]
        want.append((str(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in ppm.score(docs(spark, rows)).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = ppm.score(docs(spark, [(i, "abc def") for i in ids])).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.base_score) and math.isclose(r.score, -8 * math.log10(256), rel_tol=1e-5) for r in got)
    assert ppm.score(docs(spark, []).limit(0)).collect() == []
