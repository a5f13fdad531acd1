import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from loomspark.llm import suffix_dedup as s
from loomspark.llm.scratch import Scratch

from .helpers import docs, odd_texts, prose


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + s.SPAN] for _, b in data for j in range(len(b) - s.SPAN + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - s.SPAN + 1):
            if seen[b[j : j + s.SPAN]] > 1:
                gone[j : j + s.SPAN] = b"\1" * s.SPAN
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.removal_digests(df).collect())


def test_odd_rows_against_brute_force(spark):
    rows = odd_texts()
    assert max(len(t or "") for _, t in rows) > 100_000
    assert got(docs(spark, rows)) == brute(rows)


def test_rare_runs_go_the_same_way_as_frequent_ones(spark, monkeypatch):
    passages = [prose(900 + k, 90) for k in range(3)]
    rows = [(i, f"{prose(500 + i, 30)} {passages[i % 3]} {prose(600 + i, 10)} {passages[0] if i < 12 else ''}") for i in range(30)]
    rows += [(2, rows[2][1]), (None, "null " * 60), (None, "null " * 60)]
    want = brute(rows)
    for frequent in (1, 8, 1 << 16):  # none, the passage of all, every run
        monkeypatch.setattr(s, "FREQUENT", frequent)
        assert got(docs(spark, rows)) == want


def test_equal_rows_and_hot_passages_grow_in_proportion(spark):
    """Entries of the lists that are joined to the rows: a fixed number for each copy and for each document with a hot passage."""
    hot, text = prose(77, 300), prose(78, 2000)

    def entries(n):
        rows = [(7, text)] * n + [(100 + i, f"{prose(1000 + i, 12)} {hot} {prose(5000 + i, 12)}") for i in range(n)]
        d = docs(spark, rows)
        joined = s._with_spans(d.select("doc_id", "text"), Scratch(spark)).selectExpr("coalesce(size(spans), 0) AS n")
        return joined.selectExpr("sum(n)").first()[0]

    a, b, c = entries(50), entries(100), entries(200)
    assert b < 2.3 * a and c < 2.3 * b


def test_two_hashes_decide(spark):
    """Windows whose first hashes are equal but not the second ones aren't taken for equal."""
    f, g = np.array([5, 5, 9]), np.array([1, 2, 3])
    batch = pa.RecordBatch.from_pydict({"d": [1, 1, 1, 2], "r": [0, 0, 0, 0], "s": pa.array([0, 10, 20, 0], pa.int32()), "n": pa.array([10, 10, 5, 4], pa.int32()), "f": [5, 5, 5, 9], "g": [2, 1, 7, 4]})
    out = [b.to_pydict() for b in s._stretches(f, g)(iter([batch]))][0]
    assert (out["d"], out["a"], out["b"]) == ([1], [0], [20])


def test_passages_at_all_places(spark):
    """Shared passages of 199 to 260 bytes at the start, middle and end, some next to others, some within one document."""
    passages = [prose(70 + k, 80)[: 199 + 8 * k] for k in range(8)]
    rows = []
    for i in range(40):
        parts = [prose(200 + i, 20 + i % 7)]
        for k in range(8):
            if (i * 7 + k * 3) % 5 == 0:
                parts.insert((i + k) % (len(parts) + 1), passages[k])
        rows.append((i, "|".join(parts)))
    rows += [(100, passages[3] + passages[3]), (101, "ab" * 300), (102, "ab" * 150), (103, "z" * 400)]
    assert got(docs(spark, rows)) == brute(rows)


def test_empty(spark):
    assert s.removal_digests(docs(spark, []).limit(0)).collect() == []


def test_without_repeats_keeps_rows_and_cuts_whole_characters(spark):
    passage = "é" * 150
    rows = [(1, "a " + passage + " start"), (2, "bb" + passage + " other"), (3, None), (4, "plain")]
    d = docs(spark, rows)
    out = s.without_repeats(d)
    assert out.columns == d.columns
    by = {r.doc_id: r for r in out.collect()}
    # the blank behind the passage is shared as well
    assert by[1].text == "a start" and by[2].text == "bbother" and by[3].text is None and by[4].text == "plain"
    assert by[1].n_chars == len(by[1].text) and by[1].row == "x"
