import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.functions.names import singular, snake_id
from loomspark.operators import graph, induction, similarity
from loomspark.operators.strings import jaro_winkler
from loomspark.steps import Steps


def made_names(seed, n, letters="aeilnorst_0"):
    r = random.Random(seed)
    stems = ["".join(r.choices(letters, k=r.randint(2, 12))) for _ in range(max(4, n // 6))]
    out = set()
    while len(out) < n:
        s = list(r.choice(stems))
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(s) + 1)
            s[i : i + r.randint(0, 1)] = r.choices(letters, k=r.randint(0, 1))
        if s:
            out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("alike", [0.85, 0.88, 0.92, 0.97])
def test_similar_pairs_are_all_found(spark, alike):
    names = [*made_names(1, 350), "a", "ab", "abc", "abcd", "abcde", "abcdf", "é", "éa", "customer_0001", "customer_0002", "customer_9871", "x" * 60, "x" * 61, "xy" * 30]
    df = spark.createDataFrame([(n,) for n in [*names, None, "", "ab"]], "text string").repartition(3)
    got = {(r.a, r.b) for r in similarity.similar_pairs(df, alike=alike).collect()}
    names = sorted(set(names))
    assert got == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if jaro_winkler(a, b) >= alike - similarity.EDGE}
    ours, theirs = names[::2], names[1::3]
    got = {(r.a, r.b) for r in similarity.similar_pairs(*(spark.createDataFrame([(n,) for n in x], "text string") for x in (ours, theirs)), alike=alike).collect()}
    assert got == {(a, b) for a in ours for b in theirs if a != b and jaro_winkler(a, b) >= alike - similarity.EDGE}


def test_most_pairs_are_held_back(spark):
    names = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=9)) for i in range(3000)]
    listed = similarity.listings(spark.createDataFrame([(n,) for n in names], "text string"), "text", 0.92)
    pairs = listed.groupBy("key").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert pairs < 0.05 * 3000 * 2999 / 2
    with pytest.raises(ValueError):
        similarity.keys("abc", 0.5)


def sequential(counts, alike):
    groups = []
    for name in sorted(counts):
        form = singular(snake_id(name))
        for leader, members in groups:
            if leader == form or jaro_winkler(leader, form) >= alike - similarity.EDGE:
                members.append(name)
                break
        else:
            groups.append((form, [name]))
    out = {}
    for _, members in groups:
        best = max(members, key=lambda m: (counts[m], m))
        out |= {m: singular(snake_id(best)) for m in members}
    return out


@pytest.mark.parametrize("batch", [16, 4096])
def test_vocabulary_is_the_sequential_one(spark, monkeypatch, batch):
    monkeypatch.setattr(induction, "BATCH", batch)
    monkeypatch.setattr(induction, "GROWTH", 3)
    r = random.Random(5)
    counts = {n: r.randint(0, 9) for n in [*made_names(7, 250), "Vendors", "vendor", "Purchase Order", "purchase-orders", "Companies", "company", "1st", "", "  ", "Ünïcode", "class", "gas"]}
    rows = [(n, c) for n, c in counts.items()] + [("vendor", None), (None, 3), ("Vendors", 2)]
    counts["Vendors"] += 2
    got = {x.name: x.id for x in induction.vocabulary(spark.createDataFrame(rows, "name string, n long").repartition(3)).collect()}
    assert got == sequential(counts, 0.92)


def test_names_as_expressions(spark):
    names = [*made_names(3, 50), "Vendors", "a  b--C", "__x__", "9 lives", "", "ies", "flies", "ss", "glass", "as", "ABCs", "Été", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", induction.snake(F.col("n")).alias("s"), induction.singular_form(F.col("n")).alias("g"))
    for r in df.where("n is not null").collect():
        assert r.s == snake_id(r.n) and r.g == singular(r.n)


def test_a_hundred_thousand_names(spark, monkeypatch):
    """Against the rule on the forms, pair by pair in another engine; rounds stay few."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(induction, "BATCH", 1000)
    r = random.Random(9)
    forms = made_names(11, 5000, "abcdeilmnorstu")
    names = sorted({f"{f[:1].upper() if r.random() < 0.5 else f[:1]}{f[1:]}{r.choice(['', 's', ' ', '.', '!', '-', '?', '...', ' -'])}{r.choice(['', '/', ';', ','])}" for f in forms for _ in range(40)})[:100_000]
    assert len(names) == 100_000
    df = spark.createDataFrame([(n, len(n)) for n in names], "name string, n long")
    got = {x.name: x.id for x in induction.vocabulary(df).collect()}
    first = {}
    for n in names:
        first.setdefault(singular(snake_id(n)), n)
    con = duckdb.connect()
    con.execute("CREATE TABLE f(form VARCHAR, n BIGINT)")
    con.executemany("INSERT INTO f VALUES (?, ?)", [(f, i) for i, f in enumerate(first)])
    earlier = {}
    for a, b in con.execute("SELECT a.n, b.n FROM f a JOIN f b ON a.n < b.n AND jaro_winkler_similarity(a.form, b.form) >= 0.92 - 1e-9").fetchall():
        earlier.setdefault(b, set()).add(a)
    heads, of = set(), {}
    for i, f in enumerate(first):
        near = heads & earlier.get(i, set())
        of[f] = min(near) if near else i
        heads |= set() if near else {i}
    members = {}
    for n in names:
        members.setdefault(of[singular(snake_id(n))], []).append(n)
    want = {}
    for m in members.values():
        form = singular(snake_id(max(m, key=lambda x: (len(x), x))))
        want |= dict.fromkeys(m, form)
    assert got == want
    ranked = spark.createDataFrame([(f, i) for i, f in enumerate(first)], "text string, rank long")
    assert induction.leaders(ranked, alike=0.92, steps=Steps(spark))[1] <= 24


def test_empty(spark):
    assert induction.vocabulary(spark.createDataFrame([], "name string, n long")).collect() == []
    assert induction.hierarchy(spark.createDataFrame([], "entity string, class string")).collect() == []


def brute_hierarchy(rows, share=0.8):
    members, size = {}, Counter()
    for e, c in rows:
        if e is not None and c is not None:
            members.setdefault(c, set()).add(e)
            size[c] += 1
    out = set()
    for c, own in members.items():
        fits = [p for p in members if size[p] > size[c] and len(own & members[p]) >= share * len(own) - 1e-9]
        if fits:
            p = min(fits, key=lambda p: (-size[p], p))
            out.add((c, p, len(own & members[p]), len(own)))
    return out


def test_hierarchy_against_all_pairs(spark):
    r = random.Random(2)
    rows = [(f"e{r.randrange(300)}", f"c{i}") for i in range(30) for _ in range(r.randrange(1, 60))]
    for i in range(20):  # classes within others, by varied shares
        large = sorted({e for e, c in rows if c == f"c{i}"})
        rows += [(e, f"part{i}") for e in large[: max(1, len(large) // 2)]] + [(f"own{i}_{k}", f"part{i}") for k in range(i % 4)]
    hot = [(f"e{k}", "everything") for k in range(300)] * 2
    rows += [*hot, (None, "c1"), ("e1", None), ("lonely", "single"), ("e1", "one")]
    got = {tuple(x) for x in induction.hierarchy(spark.createDataFrame(rows, "entity string, class string").repartition(5)).select("child", "parent", "shared", "entities").collect()}
    assert got == brute_hierarchy(rows) and len(got) > 20


def sequential_admission(pairs, most):
    used, out = Counter(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        if used[a] < most and used[b] < most:
            used[a] += 1
            used[b] += 1
            out.add((a, b))
    return out


@pytest.mark.parametrize("most", [1, 2, 5])
def test_admission_in_rounds_is_the_sequential_one(spark, most):
    r = random.Random(most)
    pairs = {(a, b): r.randrange(20) / 20 for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(900)) if a < b}
    pairs |= {(1000, k): 0.5 for k in range(1001, 1400)}  # a node with very many pairs, all alike
    pairs |= {(k, k + 1): (k - 2000) / 100 for k in range(2000, 2012)}  # a chain
    rows = [(a, b, d) for (a, b), d in pairs.items()]
    got, rounds = graph.admitted(spark.createDataFrame(rows, "a long, b long, distance double"), most=most)
    assert {(x.a, x.b) for x in got.collect()} == sequential_admission(rows, most) and rounds <= 15
    assert graph.admitted(spark.createDataFrame([], "a long, b long, distance double"))[0].collect() == []
