import math
import random
import zlib

import numpy as np
import pytest

from loomspark.llm import quality_fm, toxicity, training

from .helpers import docs, odd_texts, prose


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = prose(i, 60 + i % 90).split()
        for _ in range(3 if bad else 0):
            w.insert(random.Random(i).randrange(len(w)), random.Random(i * 3).choice(["zzgrubble", "vexnark", "dolt"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), int(not bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_held_out(spark, toxic):
    d, labels = toxic
    model = toxicity.fit(d, labels)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all(r.held_out == held(i) for i, r in got.items())
    unseen = [(r.predicted, i % 4 == 0) for i, r in got.items() if r.held_out]
    assert sum(p == int(t) for p, t in unseen) / len(unseen) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def brute_buckets(text):
    """The hashed n-grams of one text, a character at a time."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    points = [32, *(32 if 9 <= ord(c) <= 13 else ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text or ""), 32]
    out = set()
    for n in toxicity.ORDERS:
        for i in range(len(points) - n + 1):
            h = n
            for c in points[i : i + n]:
                h = (h * 0x100000001B3 + mix(c + 1)) & mask
            out.add(mix(h) >> 44)
    return out


def test_toxicity_scores_and_selection_against_brute_force(spark, toxic):
    d, labels = toxic
    model = toxicity.fit(d, labels)
    label = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text for r in d.collect()}
    learnt = [i for i in texts if not held(i)]  # fewer than PER_CLASS of each class
    has = {i: brute_buckets(texts[i]) for i in learnt}
    ones, others = (sum(label[i] == c for i in learnt) for c in (1, 0))
    chosen = set()
    for bucket in set().union(*has.values()):
        p, q = (sum(bucket in has[i] for i in learnt if label[i] == c) for c in (1, 0))
        a, b, c, e = p + 0.5, ones - p + 0.5, q + 0.5, others - q + 0.5
        if abs(math.log(a * e / (b * c))) >= toxicity.LEAST_Z * math.sqrt(1 / a + 1 / b + 1 / c + 1 / e):
            chosen.add(bucket)
    assert chosen == set(np.flatnonzero(model.weights).tolist())
    rows = [(r.doc_id, r.text) for r in d.limit(30).collect()] + odd_texts()
    want = sorted((str(i), i is not None and held(i), 1 / (1 + math.exp(-min(50, max(-50, sum(float(model.weights[x]) for x in brute_buckets(t)) + model.bias))))) for i, t in rows)
    got = sorted((str(r.doc_id), r.held_out, r.score) for r in toxicity.score(docs(spark, rows), model).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-5, abs_tol=1e-7)


def test_the_sample_is_bounded_in_bytes_and_repeated_ids_count_once(spark, monkeypatch):
    rows = [(i % 50, prose(i % 50, 40)) for i in range(200)] + [(60, "z" * 5000)]
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(50), 60]], "doc_id long, toxic int")
    monkeypatch.setattr(training, "TEXT_BYTES", 4000)
    pick = lambda: training.labelled_sample(docs(spark, rows).select("doc_id", "text"), labels, "toxic", per_class=100, folds=3, held_out=1)[0].collect()
    every = pick()
    assert sorted(r.doc_id for r in every) == [i for i in range(50) if not held(i)]
    monkeypatch.setattr(training, "CLASS_BYTES", 2000)
    some = pick()
    assert {r.y for r in some} == {0, 1} and all(sum(len(r.text.encode()) for r in some if r.y == c) <= 2000 for c in (0, 1))


def test_toxicity_odd_rows(spark, toxic):
    d, labels = toxic
    odd = docs(spark, odd_texts())
    got = toxicity.score(odd, toxicity.fit(d, labels)).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out is False for r in got if r.doc_id is None)
    assert toxicity.score(odd.limit(0), toxicity.fit(d, labels)).collect() == []


@pytest.mark.parametrize("module", [toxicity, quality_fm])
def test_labels_of_one_class_nulls_and_conflicts(spark, toxic, module):
    d, _ = toxic
    labels = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (None, 1, 1), (3, None, None), (4, 7, 7), (99999, 1, 1)], "doc_id long, toxic int, quality int")
    scores = {r.score for r in module.score(d, module.fit(d, labels)).collect()}
    assert len(scores) == 1
    empty = module.fit(d, labels.limit(0))
    assert {r.score for r in module.score(d, empty).collect()} == {0.5}


def test_ngrams_are_distinct_characters():
    data = "abcab Abc".encode()
    with np.errstate(over="ignore"):
        bucket, row = toxicity.ngram_features(np.frombuffer(data, np.uint8), np.array([0, 5, 9]))
    text = [" abcab ", " abc".lower() + " "]
    # the second text is " Abc" with its own blank: two blanks before it
    grams = [{t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)} for t in (text[0], "  abc ")]
    assert [int((row == i).sum()) for i in (0, 1)] == [len(g) for g in grams]


@pytest.fixture(scope="module")
def quality(spark):
    rows, labels = [], []
    for i in range(300):
        text = prose(i, 80 + i % 120)
        if i % 5 == 0:
            text = text.upper().replace(" ", "!! ") if i % 2 else " | ".join(text.split())
        rows.append((i, text))
        labels.append((i, int(i % 5 != 0)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_held_out_and_filter(spark, quality):
    d, labels = quality
    model = quality_fm.fit(d, labels)
    got = {r.doc_id: r for r in quality_fm.score(d, model).collect()}
    unseen = [(r.predicted, int(i % 5 != 0)) for i, r in got.items() if r.held_out]
    assert sum(p == t for p, t in unseen) / len(unseen) >= 0.97
    kept = quality_fm.score(d, model, keep=True)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score >= 0.5}


def test_quality_odd_rows(spark, quality):
    d, labels = quality
    model = quality_fm.fit(d, labels)
    odd = docs(spark, odd_texts())
    got = quality_fm.score(odd, model).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
    assert quality_fm.score(odd.limit(0), model).collect() == []
    assert quality_fm.score(odd.drop("n_chars"), model).count() == len(odd_texts())
    assert set(quality_fm.score(odd.drop("n_chars"), model, keep=True).columns) == set(odd.columns) - {"n_chars"}


def brute_features(text, n_chars):
    """Word shares by bucket and statistics of one text, from their definitions."""
    from .helpers import words

    raw, w = (text or "").encode(), words(text)
    with np.errstate(over="ignore"):
        hashes = [int(quality_fm.word_hashes(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0][0]) for x in w]
    shares = {}
    for h in hashes:
        shares[h >> (64 - quality_fm.BITS)] = shares.get(h >> (64 - quality_fm.BITS), 0) + 1 / len(w)
    classes = quality_fm._CLASSES
    stats = [sum(bool(classes[b, k]) for b in raw) / max(1, len(raw)) for k in range(classes.shape[1])]
    n = max(1, len(w))
    pairs = list(zip(hashes, hashes[1:], strict=False))
    alpha = lambda x: any(b >= 128 or chr(b).isalnum() for b in x)
    stats += [math.log1p(len(raw)), math.log1p(len(w)), sum(map(len, w)) / n, len(shares) / n, max(shares.values(), default=0), (len(pairs) - len(set(pairs))) / n]
    stats += [sum(not alpha(x) for x in w) / n, sum(bool(classes[x[-1], 2]) and not classes[x[-1], 3] for x in w) / n, math.log1p(max(0, n_chars))]
    return shares, stats


def test_quality_scores_against_brute_force(spark, quality):
    d, labels = quality
    model = quality_fm.fit(d, labels)
    rows = [(r.doc_id, r.text) for r in d.limit(20).collect()] + [(i, t) for i, t in odd_texts() if len(t or "") < 5000]
    want = []
    for i, t in rows:
        shares, stats = brute_features(t, len(t or ""))
        x = np.concatenate([list(shares.values()), np.clip((np.array(stats) - model.mean) / model.spread, -6, 6)])
        at = [*shares, *range(quality_fm.WORDS, quality_fm.WORDS + quality_fm.STATISTICS)]
        v = model.factors[at] * x[:, None]
        gram = v @ v.T
        z = model.bias + model.linear[at] @ x + (gram.sum() - np.trace(gram)) / 2  # all pairs
        want.append((str(i), 1 / (1 + math.exp(-min(50, max(-50, z))))))
    got = sorted((str(r.doc_id), r.score) for r in quality_fm.score(docs(spark, rows), model).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-4, abs_tol=1e-6)


def test_pairs_in_linear_time_equal_all_pairs():
    r = np.random.default_rng(1)
    m = quality_fm.QualityModel(0.3, r.normal(size=quality_fm.WORDS + quality_fm.STATISTICS), r.normal(size=(quality_fm.WORDS + quality_fm.STATISTICS, quality_fm.RANK)), np.zeros(quality_fm.STATISTICS), np.ones(quality_fm.STATISTICS))
    bucket, share, stats = np.array([3, 9, 77]), np.array([0.5, 0.25, 0.25]), r.normal(size=(1, quality_fm.STATISTICS))
    z, _, _ = quality_fm._raw_scores(m, bucket, share, np.zeros(3, int), stats)
    at, x = np.concatenate([bucket, quality_fm.WORDS + np.arange(quality_fm.STATISTICS)]), np.concatenate([share, stats[0]])
    v = m.factors[at]
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i + 1, len(x)))
    assert np.isclose(z[0], m.bias + m.linear[at] @ x + pairs)
