from collections import Counter
from pathlib import Path

import numpy as np

from loomspark.llm import decontam

from .helpers import docs, odd_texts, prose, words


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute(rows, items, least):
    out = []
    for d, t in rows:
        w = words(t)
        for i, x in sorted(set(items), key=str):
            v = words(x)
            if i is None or not v or not w:
                continue
            n, best = min(len(v), len(w)), None
            for s in range(len(w) - n + 1):
                a, b = bag(w[s : s + n]), bag(v)
                both = sum((a & b).values())
                alike = both / (sum(a.values()) + sum(b.values()) - both)
                if alike >= least and (best is None or alike > best[0]):
                    best = alike, s
            if best:
                out.append((str(d), i, round(best[0], 9), best[1], n))
    return sorted(out)


def fixture():
    items = [(k, prose(900 + k, 15 + 3 * k)) for k in range(12)] + [(50, "three short words"), (51, "word"), (52, ""), (53, None), (None, prose(900, 15)), (3, prose(903, 24)), (60, "a b c a b c a b c a b c a b c a b c")]
    rows = odd_texts()[:10] + [(20, prose(7, 30))]
    for k, (_, t) in enumerate(items[:12]):
        w = t.split()
        rows.append((100 + k, f"{prose(k, 40)} {t} {prose(k + 1, 30)}"))
        w[len(w) // 2] = "swapped"
        rows.append((200 + k, f"{prose(k, 10)} {' '.join(w)}"))
        rows.append((300 + k, " ".join(t.upper().split()[:-1])))
        rows.append((400 + k, " ".join(t.split()[: len(w) // 2])))
    rows += [(500, "here are three short words and more"), (501, "word"), (502, "x a b c a b c a b c a b c a b c a b c a b c y"), (20, prose(7, 30))]
    return rows, items


def frame(spark, items):
    return spark.createDataFrame([(*x, 3, "y") for x in items], "item_id long, text string, doc_id long, row string")


def test_against_brute_force(spark):
    rows, items = fixture()
    got = decontam.leaks(docs(spark, rows), frame(spark, items)).collect()
    assert sorted((str(r.doc_id), r.item_id, round(r.similarity, 9), r.start_word, r.n_words) for r in got) == brute(rows, items, 0.8)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rows, items = fixture()
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)
    got = decontam.leaks(docs(spark, rows), frame(spark, items)).collect()
    assert sorted((str(r.doc_id), r.item_id, round(r.similarity, 9), r.start_word, r.n_words) for r in got) == brute(rows, items, 0.8)
    d = docs(spark, rows)
    kept = decontam.without_leaks(d, frame(spark, items))
    assert kept.columns == d.columns
    bad = {x[0] for x in brute(rows, items, 0.8)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if str(i) not in bad)


def test_index_finds_all_within_the_radius():
    r = np.random.default_rng(2)
    prints = r.integers(0, 1 << 63, 50, dtype=np.uint64)
    index = decontam.HammingIndex(prints)
    queries = []
    for p in prints:
        for n in (0, 5, decontam.RADIUS, decontam.RADIUS + 1):
            q = int(p)
            for bit in r.choice(64, n, replace=False):
                q ^= 1 << int(bit)
            queries.append(q)
    queries = np.array(queries, np.uint64)
    q, i = index.search(queries)
    want = {(a, b) for a, x in enumerate(queries) for b, y in enumerate(prints) if int(x ^ y).bit_count() <= decontam.RADIUS}
    assert set(zip(q.tolist(), i.tolist(), strict=True)) == want


def changed(w, k, seed):
    """w with k words replaced, far from each other."""
    out, step = list(w), len(w) // k
    for j in range(k):
        out[j * step + seed % step] = f"new{seed}x{j}"
    return out


def test_recall_of_the_hamming_index_at_the_limit():
    """Windows between 0.8 and 0.9 alike: the share that the search finds of those that brute force finds."""
    items = [(k, prose(3000 + k, 120 + k % 80)) for k in range(150)]
    texts = [" ".join(["before", *changed(t.split(), 1 + k % 3, k), "after", "it"]) for k, t in items]
    scanner = decontam.Scanner(decontam.Items.of(items), 0.8)
    data, offsets = pack(texts)
    got = {(i, int(scanner.items.ids[x])) for i, x, *_ in scanner.scan(data, offsets)}
    want, at_limit = set(), 0
    for k, (_, t) in enumerate(items):
        v, w = words(t), words(texts[k])
        best = max(alike(w[s : s + len(v)], v) for s in range(len(w) - len(v) + 1))
        if best >= 0.8:
            want.add((k, k))
            at_limit += best < 0.9
    assert at_limit > 40 and got <= want | {(i, x) for i, x in got if i != x}
    assert len(got & want) >= 0.99 * len(want)


def alike(a, b):
    a, b = bag(a), bag(b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def pack(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_overlaps_against_counting():
    r = np.random.default_rng(4)
    for _ in range(30):
        text, own = r.integers(0, 9, 60).astype(np.uint64), np.sort(r.integers(0, 9, 12).astype(np.uint64))
        starts = np.arange(49)
        want = [sum((Counter(text[s : s + 12].tolist()) & Counter(own.tolist())).values()) for s in starts]
        assert decontam.overlaps(np.arange(60), text, own, 12, starts).tolist() == want


def test_very_long_items_take_little_memory():
    """An item of 20,000 words, found with changes in a longer text: under 500 MB with the interpreter."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from tests.llm.helpers import prose
from tests.llm.test_decontam import changed, pack
from loomspark.llm import decontam
item = prose(1, 20000, 4000).split()
s = decontam.Scanner(decontam.Items.of([(1, " ".join(item)), (2, prose(2, 9000, 4000))]), 0.8)
data, offsets = pack([" ".join([prose(9, 300), *changed(item, 40, 3), prose(8, 5000)]), prose(2, 9000, 4000)])
found = s.scan(data, offsets)
assert [(x[0], x[1], x[3]) for x in found] == [(0, 0, 300), (1, 1, 0)], found
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 500_000
"""
    root = str(Path(__file__).resolve().parents[2])
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin"}, timeout=300)


def test_empty_tables(spark):
    rows, items = fixture()
    assert decontam.leaks(docs(spark, []).limit(0), frame(spark, items)).collect() == []
    assert decontam.leaks(docs(spark, rows), frame(spark, items).limit(0)).collect() == []
    assert decontam.without_leaks(docs(spark, rows), frame(spark, items).limit(0)).count() == len(rows)
