from collections import defaultdict

import numpy as np
import pytest

from loomspark.llm import minhash

from .helpers import docs, odd_texts, prose, words


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    to = {i: i for i, _ in sets if i is not None}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    named = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, a) in enumerate(named):
        for j, b in named[x + 1 :]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                u, v = sorted((root(i), root(j)))
                to[v] = u
    return sorted((str(i), len(s), str(root(i)) if i is not None else "None") for i, s in sets)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rows = odd_texts()
    for g in range(6):  # families of copies with more and more changed words
        base = prose(50 + g, 120).split()
        for c in range(8):
            changed = list(base)
            for p in range(c):
                changed[(p * 17 + c) % 120] = f"w{g}x{c}x{p}"
            rows.append((1000 + 10 * g + c, " ".join(changed)))
    got = minhash.near_duplicates(docs(spark, rows), words=k, least_percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) if r.doc_id is not None else r.kept is None for r in got)


def test_chains_reach_the_least_id(spark):
    """Each step stays within the limit, the ends don't."""
    base = prose(9, 200).split()
    rows = []
    for step in range(12):
        base = [f"s{step}" if i in (step * 16, step * 16 + 1) else w for i, w in enumerate(base)]
        rows.append((100 - step, " ".join(base)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), words=3, least_percent=85).collect()}
    assert got == {i: int(c) for i, c in ((int(a), b) for a, _, b in brute(rows, 3, 85))}
    assert set(got.values()) == {89}


def test_empty(spark):
    assert minhash.near_duplicates(docs(spark, []).limit(0)).collect() == []


def test_without_near_duplicates_keeps_columns_and_one_of_each(spark):
    rows = odd_texts()
    d = docs(spark, rows)
    kept = minhash.without_near_duplicates(d, words=5, least_percent=80)
    assert kept.columns == d.columns
    groups = defaultdict(int)
    for i, _, c in brute(rows, 5, 80):
        groups[c] += i != "None"
    assert len([r for r in kept.collect() if r.doc_id is not None]) == len([c for c in groups if c != "None"])
    assert len([r for r in kept.collect() if r.doc_id is None]) == 2


def test_sketch_bound_holds_pairs_at_the_limit(spark):
    import numpy as np
    from pyspark.sql import functions as F

    random = np.random.default_rng(0)
    rows = []
    for n in (30, 130, 600, 3000, 30000):
        for _ in range(40):
            a = np.unique(random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            k = int(np.ceil(len(a) * 2 * 0.85 / 1.85))  # the common part at similarity 0.85
            b = np.unique(np.concatenate([random.permutation(a)[:k], random.integers(0, 1 << 63, len(a) - k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            _, _, s = minhash.signatures_of([a, b])
            rows.append((len(a), len(b), int(np.bitwise_count(s[0] ^ s[1]).sum())))
    df = spark.createDataFrame(rows, "n long, m long, ones long")
    assert df.where(F.col("ones") > minhash.most_differing_bits(F.col("n"), F.col("m"), 0.85)).count() == 0
    # and the bound is tight: sketches of pairs at 0.7 are beyond it
    far = minhash.most_differing_bits(F.col("n"), F.col("m"), 0.85) / (minhash.most_differing_bits(F.col("n"), F.col("m"), 0.7) + 0.0)
    assert df.where(far >= 0.95).where("n > 100 and n < 10000").count() == 0


def made_pairs(similarity, seed):
    """Pairs of sets of random hashes of 20 to 3,000 shingles with just under and just this Jaccard similarity or more."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(400):
        union = int(r.integers(20, 3000))
        both = int(np.ceil(similarity * union))
        x = r.integers(0, 1 << 64, union, dtype=np.uint64)
        cut = both + int(r.integers(0, union - both + 1))
        out.append((np.sort(x[:cut]), np.sort(np.concatenate([x[:both], x[cut:]]))))
    return out


def passing(spark, pairs, limit):
    from pyspark.sql import functions as F

    rows = []
    for a, b in pairs:
        _, _, sketch = minhash.signatures_of([a, b])
        rows.append((len(a), len(b), int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())))
    df = spark.createDataFrame(rows, "n long, m long, ones long")
    return df.where(F.col("ones") <= minhash.most_differing_bits(F.col("n"), F.col("m"), limit)).count() / len(rows)


@pytest.mark.parametrize("limit", [0.80, 0.85])
def test_sketches_pass_pairs_at_the_limit_and_stop_others(spark, limit):
    assert passing(spark, made_pairs(limit, 5), limit) >= 0.995
    assert passing(spark, made_pairs(0.70, 6), limit) <= (0.6 if limit == 0.80 else 0.25)


@pytest.mark.parametrize("limit", [0.80, 0.85])
def test_bands_hold_pairs_at_the_limit(limit):
    """The share of pairs at the limit that share a band, of what brute force would link: all but 1 in 1,000 at least."""
    met = 0
    pairs = made_pairs(limit, 7)
    for a, b in pairs:
        _, bands, _ = minhash.signatures_of([a, b])
        met += bool((bands[0] == bands[1]).any())
    assert met >= 0.999 * len(pairs)
