"""Languages by trigrams, first rows and byte budgets, tables inside documents."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.operators import caps, languages
from loomspark.sources import documents, embedded
from loomspark.sources.infer import agreed


def test_language_against_a_loop(spark):
    import re

    r = random.Random(1)
    kinds = {"aa": ["tionel", "leure", "été"], "bb": ["unger", "schaft", "über"], "cc": ["ción", "mente", "año"]}
    texts = [(i, " ".join(r.choices(kinds[k], k=r.randint(1, 40))), k) for i, k in enumerate(r.choices(list(kinds), k=60))]
    texts += [(100, "LEURE! 42 ÉtÉ;tionel", None), (101, None, "aa"), (102, "", "bb"), (103, "東京 ???", None), (104, "unger", None)]
    got = languages.detect(df := spark.createDataFrame(texts, "id long, text string, lang string"), languages.profiles(df), key="id")

    def grams(text):
        flat = f" {re.sub(r'[^a-zà-ÿ東京]+', ' ', (text or '').lower()).strip()} "
        return [flat[i : i + 3] for i in range(len(flat) - 2)]

    counts = {k: Counter(g for _, t, x in texts if x == k for g in grams(t)) for k in kinds}
    every = set().union(*counts.values())
    want = {}
    for i, t, _ in texts:
        known = [g for g in grams(t) if g in every]
        sums = sorted((-sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * len(every))) for g in known), k) for k, c in counts.items())
        advantage = (sums[1][0] - sums[0][0]) / len(known) if known else None
        want[i] = (sums[0][1] if known else None, len(known), advantage and round(advantage, 9), bool(known) and len(known) >= 20 and advantage >= 0.05)
    assert {x.id: (x.language, x.n_grams, x.advantage and round(x.advantage, 9), x.reliable) for x in got.collect()} == want
    assert want[103][0] is None and want[100][0] == "aa" and not want[104][3]
    none = languages.detect(df, languages.profiles(df.where("lang = 'zz'")), key="id").collect()
    assert len(none) == len(texts) and not any(x.language or x.reliable for x in none)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Three files of different size; the order of input is theirs."""
    path = str(tmp_path_factory.mktemp("caps") / "t")
    r = random.Random(3)
    rows = [(i, r.choice([None, "short", "é" * 30, 'quo"te\n', "x" * 100, "🙂" * 12]), r.choice([None, 1.5, 2.0])) for i in range(600)]
    for n, (a, b) in enumerate(((0, 50), (50, 500), (500, 600))):
        spark.createDataFrame(rows[a:b], "id long, t string, d double").coalesce(1).write.parquet(f"{path}/part={n}")
    return spark.read.parquet(path).drop("part"), rows


@pytest.mark.parametrize("limit", [-1, 0, 1, 49, 50, 51, 499, 600, 1000])
def test_first_rows(files, limit):
    df, rows = files
    assert sorted(map(tuple, caps.first_rows(df, limit).collect())) == rows[: max(0, limit)]


@pytest.mark.parametrize("most", [0, 1, 60, 2000, 9000, 10**6])
def test_byte_budget(files, most):
    df, rows = files
    want, used = [], 0
    for i, t, d in rows:
        cut = t is not None and len(t) > 20
        t = f"{t[:20]}…(+{len(t) - 20} chars)" if cut else t
        used += len(json.dumps([i, t, d], ensure_ascii=False, separators=(",", ":")).encode())
        if want and used > most:
            break
        want.append((i, t, d, int(cut)))
    assert sorted(map(tuple, caps.byte_budget(df, most, 20).collect())) == want


def test_caps_of_rows_without_files(spark):
    assert caps.first_rows(spark.range(0, 100, 1, 5), 37).count() == 37
    assert caps.byte_budget(spark.range(0), 100, 5).count() == 0


def page(*tables):
    out = "<p>text</p>"
    for header, rows in tables:
        out += "<table><tr>" + "".join(f"<th>{h}</th>" for h in header) + "</tr>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table><p>and</p>"
    return out


def test_tables_inside_documents(spark, tmp_path):
    small = (["a", "b"], [["1", "2"]] * 3)
    plain = (["id", "", "Id", "when|x"], [[str(i), "y" if i % 2 else "", f"{i}.5" if i else "3", "2024-01-02" if i else "2024-01-02 10:00"] for i in range(25)])
    bars = (["n", "text"], [[str(i), f"left|right {i}"] for i in range(20)])
    mixed = (["v", "w", "x"], [["true", "9" * 25, ""] for _ in range(21)])
    files = spark.createDataFrame([("a b.c", page(small, plain, bars)), ("other", page(mixed, small)), ("none", "<p>no</p>"), ("", page(bars))], "stem string, html string").withColumn("name", F.lit("x.html"))
    found = embedded.find_tables(documents.sections(files, "stem", "html", "name"), "stem", F.col("stem"))
    columns = embedded.load_tables(found, str(tmp_path / "t"))
    got = {}
    for r in columns.orderBy("table_name", "position").collect():
        got.setdefault(r.table_name, []).append((r.column_name, r.data_type))
    assert got == {
        "a_b_c_table1": [("id", "BIGINT"), ("column2", "VARCHAR"), ("Id_2", "DOUBLE"), ("when|x", "TIMESTAMP")], "a_b_c_table2": [("n", "BIGINT"), ("text", "VARCHAR")],
        "other_table1": [("v", "BOOLEAN"), ("w", "DOUBLE"), ("x", "VARCHAR")], "imported_table1": [("n", "BIGINT"), ("text", "VARCHAR")],
    }
    first = embedded.read_table(spark, str(tmp_path / "t"), "a_b_c_table1").orderBy("id").collect()
    assert len(first) == 25 and first[0][:3] == (0, None, 3.0) and first[1][:3] == (1, "y", 1.5) and str(first[0][3]) == "2024-01-02 10:00:00"
    assert embedded.read_table(spark, str(tmp_path / "t"), "a_b_c_table2").orderBy("n").first().text == "left|right 0"
    with pytest.raises(ValueError):
        embedded.read_table(spark, str(tmp_path / "t"), "nope")


def test_types_agree_as_one_by_one(spark):
    import itertools

    kinds = ["BIGINT", "DOUBLE", "BOOLEAN", "DATE", "TIMESTAMP", "VARCHAR"]
    sets = [list(c) for n in (1, 2, 3) for c in itertools.combinations(kinds, n)]
    df = spark.createDataFrame([(s,) for s in sets], "k array<string>").select("k", embedded._agreed(F.col("k")).alias("a"))
    assert all(r.a == agreed(set(r.k)) for r in df.collect())


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
@pytest.mark.parametrize("keyed", [True, False])
def test_asof_join_in_ranges(spark, monkeypatch, op, keyed):
    """The same rows as by one window a key, and as by looking at all pairs."""
    from loomspark.operators import relational

    r = random.Random(7)
    left = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(40)])) for i in range(300)]
    right = [(1000 + i, r.choice(["a", "a", "c", None]), r.choice([None, *range(0, 40, 3)])) for i in range(60)]
    lefts, rights = spark.createDataFrame(left, "i long, k string, t int").repartition(3), spark.createDataFrame(right, "j long, k string, t int").repartition(2)
    fits = {">=": lambda x, y: y <= x, ">": lambda x, y: y < x, "<=": lambda x, y: y >= x, "<": lambda x, y: y > x}[op]
    want = {}
    for i, k, t in left:
        met = [(abs(t - u), -j) for j, m, u in right if t is not None and u is not None and fits(t, u) and (not keyed or (k is not None and k == m))]
        want[i] = -min(met)[1] if met else None
    for rows in (10, 4_000_000):
        monkeypatch.setattr(relational, "ASOF_ROWS", rows)
        got = relational.asof_join(lefts, rights, "a", "b", [("k", "k")] if keyed else [], "t", "t", op, "left")
        assert {x.a.i: x.b and x.b.j for x in got.collect()} == want
