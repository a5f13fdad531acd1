import io
import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from loomspark.operators import graph, labelling, ontology, relational
from loomspark.operators.ontology import Class, Mapping, Ontology, Property, Relation


def world():
    return Ontology(
        {"order": Class("order", properties=(Property("mode", "enum"),)), "vendor": Class("vendor"), "maker": Class("maker", "vendor", (Property("id"), Property("size", "number")))},
        {"has_vendor": Relation("has_vendor", "order", "vendor")}, [Mapping("shipments", "order", "po", (("mode", "mode"),), (("vendor", "has_vendor", "vendor"),))],
    )


@pytest.fixture(scope="module")
def built(spark):
    rows = spark.createDataFrame([("PO1", "Acme", "air"), ("po1 ", "Acme", "sea"), ("PO2", "acme", None), (None, "Beta", "air"), ("PO3", None, "air"), ("", "Beta", "x")], "po string, vendor string, mode string")
    return graph.build({"shipments": rows}, world())


def test_extraction(built):
    nodes, edges, seen = built
    got = {(r.class_id, r.normalized_label): (r.label, r.properties) for r in nodes.collect()}
    assert got == {("order", "po1"): ("PO1", {"mode": "air"}), ("order", "po2"): ("PO2", {}), ("order", "po3"): ("PO3", {"mode": "air"}), ("vendor", "acme"): ("Acme", {})}
    assert edges.count() == 2 and {r.row_key for r in seen.collect()} == {"PO1", "po1 ", "PO2", "PO3"}


def test_views_export_and_traversal(built):
    nodes, edges, seen = built
    view = graph.class_view(nodes, world(), "order")
    assert view.columns == ["id", "label", "class_id", "mode"] and view.count() == 3
    assert graph.class_view(nodes, world(), "maker").columns == ["id", "label", "class_id", "id_property", "size"]
    out = io.StringIO()
    graph.export_graphml(nodes, edges, out)
    assert len(list(ElementTree.fromstring(out.getvalue()).iter("{http://graphml.graphdrawing.org/xmlns}edge"))) == 2
    out = io.StringIO()
    graph.export_jsonld(nodes, edges, out)
    assert len(json.loads(out.getvalue())["@graph"]) == 4
    a, b = (graph.lookup(nodes, x).first()["id"] for x in (" PO1", "po2"))
    path = graph.shortest_path(edges, a, b)
    assert [p[1] for p in path][0] == a and path[-1][2] == b and len(path) == 2
    lone = graph.lookup(nodes, "PO3").first()["id"]
    assert graph.shortest_path(edges, a, lone) is None and graph.shortest_path(edges, a, a) == []
    near, links, full = graph.neighborhood(nodes, edges, a, hops=3, most=2)
    assert near.count() == 2 and links.count() == 1 and full
    near, links, full = graph.neighborhood(nodes, edges, [a, lone], hops=0, relations=["has_vendor"])
    assert {r.label for r in near.collect()} == {"PO1", "PO3", "Acme"} and links.count() == 1 and not full
    assert graph.neighborhood(nodes, edges, a, relations=["no_such"])[0].count() == 1
    assert [r.label for r in graph.suggestions(nodes, "acm").collect()] == ["Acme"]


def test_merge_fill_and_delete(spark, built):
    nodes, edges, seen = built
    a, b = (graph.lookup(nodes, x).first()["id"] for x in ("po1", "po2"))
    n, e, p = graph.merge_nodes(nodes, edges, seen, spark.createDataFrame([(b, a)], "gone string, kept string"))
    assert n.count() == 3 and e.count() == 1 and b not in {r.owner for r in p.collect()}
    c = graph.lookup(nodes, "po3").first()["id"]
    chain = spark.createDataFrame([(b, c), (c, a)], "gone string, kept string")
    n, e, p = graph.merge_nodes(nodes, edges, seen, chain)
    assert n.count() == 2 and {r.src for r in e.collect()} == {a} and not {b, c} & {r.owner for r in p.collect()}
    aliases = graph.merged_aliases(nodes, chain)
    assert sorted(r.alias for r in aliases.collect()) == ["PO2", "PO3"] and graph.lookup(n, "po3", aliases=aliases).first()["id"] == a
    with pytest.raises(ValueError, match="circle"):
        graph.final_merges(spark.createDataFrame([(a, b), (b, a)], "gone string, kept string"))
    more = graph.assert_node(nodes, "order", "PO1", {"mode": "rail", "extra": "1"})
    assert more.where(f"id = '{a}'").first()["properties"] == {"mode": "rail", "extra": "1"} and more.count() == 4
    n, e = graph.delete_node(nodes, edges, a)
    assert n.count() == 3 and e.count() == 1
    filled = graph.fill_gaps(nodes, more)
    assert filled.where(f"id = '{a}'").first()["properties"] == {"mode": "air", "extra": "1"}


def test_admission_is_greedy(spark):
    labels = spark.createDataFrame([(1, "alpha one"), (2, "alpha two"), (3, "beta"), (4, "alpha four")], "id long, label string")
    pairs = spark.createDataFrame([(1, 2, 0.01), (1, 3, 0.02), (1, 4, 0.03)], "a long, b long, distance double")
    assert list(map(tuple, graph.proposals(pairs, labels, most=2).collect())) == [(1, 2, 0.01)]  # the pair without a common token used up a place
    assert graph.survivor({"id": "b", "keyed": True, "evidence": 1}, {"id": "a", "keyed": False, "evidence": 9}) == ("b", "a")
    same = spark.createDataFrame([("東京都", "京都府"), ("ab", "ab"), ("Élan x", "the élan"), (None, "abc")], "a string, b string")
    assert [r[0] for r in same.select(graph.shares_token(F.col("a"), F.col("b"))).collect()] == [True, False, True, None]


def test_ontology_rules():
    o = world()
    assert o.ancestors("maker") == ["maker", "vendor", "entity"] and o.descendants("vendor") == {"vendor", "maker"}
    assert o.edge_fits("has_vendor", "order", "maker") and not o.edge_fits("has_vendor", "vendor", "order") and o.edge_fits("mentions", "x", "y")
    assert o.faults() == [] and Ontology.from_json(o.to_json()) == o
    v = ontology.Versions()
    v.save(o)
    r = o.renamed("vendor", "supplier")
    assert v.save(r) == 2 and r.relations["has_vendor"].range == "supplier" and r.classes["maker"].parent == "supplier"
    assert v.restore(1) == 3 and v.load(3) == o and o.diff(r)["added"] == ["classes supplier"]
    bad = Ontology({"a": Class("a", "b"), "b": Class("b", "a")})
    assert bad.faults()
    assert ontology.attribute_kind(["$1,000", "3%"]) == "number" and ontology.attribute_kind(["x"]) is None and ontology.attribute_kind(["2024-01-02", "Jan 3, 2024"]) == "date"


def test_labelling(spark):
    df = spark.createDataFrame([(1, "yes"), (2, " "), (3, None)], "id int, body string")
    q = [labelling.Question("ok", "choice", ("y", "n")), labelling.Question("rate", "score", ("1", "2"))]
    model = lambda texts: [{"ok": "y", "ok_p": 0.9, "ok_confidence": 0.8, "rate": 1.5, "rate_level": 2} for _ in texts]
    got = {r.id: (r.ok, r.rate_level, r.truncated) for r in labelling.label(df, "id", ["body"], q, model).collect()}
    assert got == {1: ("y", 2, False), 2: (None, None, False), 3: (None, None, False)}
    with pytest.raises(ValueError, match="clash"):
        labelling.output_columns([labelling.Question("ID", "probability")], "id")
    with pytest.raises(ValueError, match="no column"):
        labelling.pick_key(spark.createDataFrame([(1.5,), (2.5,)], "f double"))


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(relational.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(relational.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(relational.update_from(old, new, ["k"])) == [(1, "a"), (2, "c")]
    assert relational.capped(spark.range(10), rows=3, count_on=4)[1:] == (7, False) and relational.capped(spark.range(5), rows=3, count_on=4)[1:] == (5, True)
    assert relational.cut_cell("abcdef", 3) == "abc…(+3 chars)"


def test_embeddings_stand_in_for_labels(spark, built):
    nodes, _, _ = built
    ids = {r.label: r.id for r in nodes.collect()}
    vectors = spark.createDataFrame([(ids["Acme"], [1.0, 0.0]), (ids["PO1"], [0.9, 0.1]), (ids["PO2"], [0.6, 0.8]), (ids["PO3"], None)], "id string, embedding array<double>")
    ask = {"vectors": vectors, "vector_of": [1.0, 0.0]}
    assert [r.label for r in graph.lookup(nodes, "po3", **ask).collect()] == ["PO3"]
    found = graph.lookup(nodes, "a supplier", **ask)
    assert [r.label for r in found.collect()] == ["Acme", "PO1"] and found.columns == nodes.columns
    assert [r.label for r in graph.lookup(nodes, "a supplier", cls={"order"}, **ask).collect()] == ["PO1"]
    assert graph.lookup(nodes, "a supplier").isEmpty() and graph.lookup(nodes, " ", **ask).isEmpty()
    assert [(r.label, r.similarity is None) for r in graph.suggestions(nodes, "acm", **ask).collect()] == [("Acme", False), ("PO1", True), ("PO2", True)]
    assert [r.label for r in graph.suggestions(nodes, "acm", most=2, **ask).collect()] == ["Acme", "PO1"]
    assert [r.label for r in graph.suggestions(nodes, "zzz", cls={"vendor"}, **ask).collect()] == ["Acme"] and graph.suggestions(nodes, "", **ask).isEmpty()
    assert graph.lookup(nodes, "x", vectors=vectors, vector_of=[0.0, 0.0]).isEmpty() and graph.lookup(nodes, "x", vectors=vectors, vector_of=[1.0]).isEmpty()


def test_extraction_is_validated(spark):
    """Against the rules one passage at a time."""
    import random

    o = Ontology({"a": Class("a"), "b": Class("b"), "sub": Class("sub", "a")}, {"r": Relation("r", "a", "b")})
    r = random.Random(3)
    nodes, edges = [], []
    for p in range(40):
        labels = [r.choice(["One", " one ", "TWO", "three  x", "Four", " ", None]) for _ in range(r.randint(0, 6))]
        nodes += [(p, i, r.choice(["a", " B", "Sub ", "entity", "zz"]), t, {"k": str(i)}) for i, t in enumerate(labels)]
        edges += [(p, r.choice(["R", "r ", "mentions", "qq"]), r.choice(["one", "two", "three x", "none"]), r.choice(["ONE", "two ", "Four"]), None) for _ in range(r.randint(0, 5))]
    got = ontology.validate_extraction(spark.createDataFrame(nodes, "passage_id int, place int, class_id string, label string, properties map<string,string>").repartition(3), spark.createDataFrame(edges, "passage_id int, relation_id string, source string, target string, properties map<string,string>"), o)
    kept, good, drift, invalid = {}, [], {}, {}
    norm = lambda t: " ".join(t.split()).lower()
    for p, _, c, t, props in nodes:
        c = c.strip().lower()
        if not (t or "").strip():
            continue
        if c not in ("a", "b", "sub", "entity"):
            drift[("class", c)] = drift.get(("class", c), 0) + 1
        elif (p, norm(t)) not in kept:
            kept[(p, norm(t))] = (c, t.strip(), props)
    for p, rel, s, t, _ in edges:
        rel = rel.strip().lower()
        if rel not in ("r", "mentions"):
            drift[("relation", rel)] = drift.get(("relation", rel), 0) + 1
            continue
        ends = kept.get((p, norm(s))), kept.get((p, norm(t)))
        if all(ends) and o.edge_fits(rel, ends[0][0], ends[1][0]):
            good.append((p, rel, norm(s), norm(t)))
        else:
            invalid[p] = invalid.get(p, 0) + 1
    assert {(x.passage_id, x.normalized_label): (x.class_id, x.label, x.properties) for x in got.nodes.collect()} == kept
    assert sorted((x.passage_id, x.relation_id, x.source, x.target) for x in got.edges.collect()) == sorted(good) and good
    assert {(x.what, x.name): x.n for x in got.drift.collect()} == drift and {x.passage_id: x.n for x in got.invalid.collect()} == invalid


def test_relabel_swaps_whole_tables_only(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "id int, body string").repartition(3)
    q, path = [labelling.Question("ok", "choice", ("y", "n"))], str(tmp_path / "labels")
    answers = lambda a: lambda texts: [{"ok": a, "ok_p": 0.9, "ok_confidence": 0.8} for _ in texts]
    labelling.relabel(df, "id", ["body"], q, answers("y"), path)

    def failing(texts):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        labelling.relabel(df, "id", ["body"], q, failing, path)
    assert {r.ok for r in spark.read.parquet(path).collect()} == {"y"} and [p.name for p in tmp_path.iterdir()] == ["labels"]
    labelling.relabel(df.where("id < 5"), "id", ["body"], q, answers("n"), path)
    assert [(r.id, r.ok) for r in spark.read.parquet(path).orderBy("id").collect()] == [(i, "n") for i in range(5)]


def test_hops_through_the_adjacency(spark, tmp_path):
    """The same neighbourhoods and paths as over all edges, also at a hot node."""
    import random

    r = random.Random(8)
    pairs = {(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(90)} | {("hub", f"n{i}") for i in range(40)}
    edges = spark.createDataFrame([(f"e{i}", f"r{i % 3}", a, b) for i, (a, b) in enumerate(sorted(pairs))], "id string, relation_id string, src string, dst string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(60)] + [("hub",)], "id string")
    path = str(tmp_path / "adjacency")
    graph.write_adjacency(edges, path)
    for start, options in (("n1", {}), (["n1", "n2"], {"hops": 3}), ("hub", {"most": 20}), ("n3", {"relations": ["r1"]}), ("nowhere", {})):
        seen = [graph.neighborhood(nodes, edges, start, adjacency=a, **options) for a in (None, path)]
        (n, e, full), (m, f, also) = seen
        assert sorted(x.id for x in n.collect()) == sorted(x.id for x in m.collect()) and sorted(map(tuple, e.select("id", "src", "dst").collect())) == sorted(map(tuple, f.select("id", "src", "dst").collect())) and full == also
    for goal in ("n9", "n33", "hub", "nowhere"):
        assert graph.shortest_path(edges, "n1", goal) == graph.shortest_path(edges, "n1", goal, adjacency=path)


@pytest.mark.parametrize("most", [1, 5])
def test_paths_beyond_what_the_driver_lists(spark, tmp_path, most):
    """The same paths, however few nodes the driver may list, also when the goal comes last at a hot node."""
    import random

    r = random.Random(4)
    pairs = {("hub", f"n{i:02}") for i in range(40)} | {("hub", "z0"), ("z0", "z1"), ("z1", "z2"), ("n07", "n50")} | {(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(20)}
    edges = spark.createDataFrame([(f"e{i:03}", "z" if a[0] == "z" or b[0] == "z" else "r", a, b) for i, (a, b) in enumerate(sorted(pairs))], "id string, relation_id string, src string, dst string").cache()
    path = str(tmp_path / "adjacency")
    graph.write_adjacency(edges, path)
    for start, goal, hops in (("hub", "z0", 1), ("n03", "z2", 4), ("n50", "z1", 4), ("n03", "nowhere", None)):
        want = graph.shortest_path(edges, start, goal)
        assert (len(want) if want else None) == hops
        assert graph.shortest_path(edges, start, goal, most=most) == graph.shortest_path(edges, start, goal, most=most, adjacency=path) == want


def test_capped_read_counts_all_rows(spark, tmp_path):
    """As the query's SQL does, also beyond the rows that counting otherwise stops at."""
    from loomspark.queries.relational import QUERIES

    spark.range(101_005).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    assert list(map(tuple, QUERIES["capped_read"](spark, str(tmp_path)).collect())) == [(1000, 101_005, True)]
