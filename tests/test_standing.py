import io
import random

import pytest

from loomspark.operators import graph, standing
from loomspark.operators.ontology import Class, Ontology, Relation
from loomspark.operators.standing import ASSERTED, CHANGES, CLEARED, CORRECTED, DELETED, FOUND, PROPOSED, RESET


class Direct:
    """The same changes as edits in place, one by one."""

    def __init__(self):
        self.nodes, self.edges, self.stated = {}, {}, set()

    def _end(self, i):
        self.nodes.pop(i, None)
        self.edges.pop(i, None)
        self.edges = {e: x for e, x in self.edges.items() if i not in (x["src"], x["dst"])}

    def take(self, c):
        """Whether the change was possible."""
        at, action, kind, i, cls, label, src, dst, props, removed, *_ = c
        if action == CLEARED:
            self.nodes, self.edges = {}, {}
            return True
        if action == RESET:
            for n in [n for n, x in self.nodes.items() if not x["asserted"]]:
                self._end(n)
            self.edges = {e: x for e, x in self.edges.items() if x["asserted"]}
            return True
        table = self.nodes if kind == "node" else self.edges
        if action == DELETED:
            if i not in table:
                return False
            self._end(i)
            return True
        if kind == "edge" and action != CORRECTED and not {src, dst} <= set(self.nodes):
            return False
        x = table.get(i)
        given = {k: v for k, v in (props or {}).items() if v is not None}
        if action == CORRECTED:
            if x is None:
                return False
            x["class"], x["label"] = cls or x["class"], label or x["label"]
            for k in removed or []:
                x["props"].pop(k, None)
            x["props"] |= given
            x["provisional"], x["asserted"] = False, True
            return True
        if x is None:
            x = table[i] = {"class": cls, "label": label, "src": src, "dst": dst, "props": {}, "provisional": True, "asserted": False}
        x["props"] = x["props"] | given if action == ASSERTED else given | x["props"]
        x["provisional"] &= action == PROPOSED
        x["asserted"] |= action == ASSERTED
        return True


def log(seed, n=160):
    r = random.Random(seed)
    direct, out, ends = Direct(), [], {}
    for at in range(n):
        action = r.choices([PROPOSED, FOUND, ASSERTED, CORRECTED, DELETED, RESET, CLEARED], [30, 20, 12, 14, 8, 3, 1])[0]
        kind = r.choice(["node", "edge"])
        i = f"{kind[0]}{r.randrange(8)}"
        src, dst = ends.setdefault(i, (f"n{r.randrange(8)}", f"n{r.randrange(8)}")) if kind == "edge" else (None, None)
        props = {k: r.choice(["1", "2", "3", None]) for k in r.sample("pqrs", r.randrange(3))}
        removed = [k for k in r.sample("pqrs", r.randrange(3)) if k not in props] if action == CORRECTED else None
        fixed = action == CORRECTED and r.random() < 0.5
        cls, label = (None, None) if action == CORRECTED and not fixed else (f"c{r.randrange(3)}", f"Label {r.randrange(5)}" if kind == "node" else None)
        c = (at, action, kind, i, cls, label, src, dst, props, removed, "me", f"note {at}")
        if action in (RESET, CLEARED):
            c = (at, action, *[None] * 8, "me", None)
        if direct.take(c):
            out.append(c)
    return direct, out


@pytest.mark.parametrize("seed", range(5))
def test_folding_equals_direct_edits(spark, seed):
    direct, rows = log(seed)
    random.Random(seed).shuffle(rows)
    g = standing.fold(spark.createDataFrame(rows + rows[:20], CHANGES).repartition(3))
    nodes = {r.id: (r.class_id, r.label, r.properties, r.provisional, r.asserted) for r in g.nodes.collect()}
    edges = {r.id: (r.relation_id, r.src, r.dst, r.properties, r.provisional, r.asserted) for r in g.edges.collect()}
    assert nodes == {i: (x["class"], x["label"], x["props"], x["provisional"], x["asserted"]) for i, x in direct.nodes.items()}
    assert edges == {i: (x["class"], x["src"], x["dst"], x["props"], x["provisional"], x["asserted"]) for i, x in direct.edges.items()}
    assert {r.id for r in g.statements.collect()} == {i for t in (direct.nodes, direct.edges) for i, x in t.items() if x["asserted"]}
    kept, links = graph.reviewed(g.nodes, g.edges)
    firm = {i for i, x in direct.nodes.items() if not x["provisional"]}
    assert {r.id for r in kept.collect()} == firm
    assert {r.id for r in links.collect()} == {i for i, x in direct.edges.items() if not x["provisional"] and {x["src"], x["dst"]} <= firm}


def test_empty(spark):
    g = standing.fold(spark.createDataFrame([], CHANGES))
    assert g.nodes.count() == g.edges.count() == g.statements.count() == 0


def test_faults(spark):
    o = Ontology({"a": Class("a"), "b": Class("b"), "sub": Class("sub", "a")}, {"r": Relation("r", "a", "b")})
    now = [(0, FOUND, "node", "n1", "a", "One"), (1, FOUND, "node", "n2", "b", "Two"), (2, FOUND, "node", "n3", "a", "Three"), (3, FOUND, "edge", "e1", "r", None, "n1", "n2")]
    g = standing.fold(spark.createDataFrame([(*c, *[None] * (12 - len(c))) for c in now], CHANGES))
    new = [
        (10, ASSERTED, "node", "n4", "zz", "Four"), (11, ASSERTED, "node", "n5", "a", "  "), (12, CORRECTED, "node", "nope", None, "x"), (13, DELETED, "edge", "nope"), (14, CORRECTED, "node", "n3", None, " one "),
        (15, ASSERTED, "edge", "e2", "r", None, "n2", "n1"), (16, ASSERTED, "edge", "e3", "r", None, "n1", "gone"), (17, ASSERTED, "edge", "e4", "q", None, "n1", "n2"), (18, CORRECTED, "node", "n1", "b", None), (19, CORRECTED, "node", "n1", "sub", "Uno"),
        (20, ASSERTED, "node", "n6", "a", "Six"), (21, ASSERTED, "edge", "e5", "r", None, "n3", "n2"), (22, DELETED, "node", "n3"), (23, FOUND, "node", "n9", "anything", ""), (24, CORRECTED, "node", "n3", "b", "TWO"),
    ]
    found = standing.faults(spark.createDataFrame([(*c, *[None] * (12 - len(c))) for c in new], CHANGES), g, o)
    assert sorted(map(tuple, found.collect())) == sorted([
        (10, "no such class"), (11, "blank label"), (12, "no such subject"), (13, "no such subject"), (14, "another node has the label"), (15, "edge doesn't fit"), (16, "no such end"), (17, "edge doesn't fit"), (18, "edge doesn't fit"),
        (24, "another node has the label"),
    ])


def test_exports_leave_provisional_parts_out(spark, tmp_path):
    rows = [(0, FOUND, "node", "n1", "a", "One"), (1, PROPOSED, "node", "n2", "b", "Two"), (2, ASSERTED, "node", "n3", "b", "Three"), (3, FOUND, "edge", "e1", "r", None, "n1", "n2"), (4, FOUND, "edge", "e2", "r", None, "n1", "n3"), (5, PROPOSED, "edge", "e3", "q", None, "n1", "n3")]
    g = standing.fold(spark.createDataFrame([(*c, *[None] * (12 - len(c))) for c in rows], CHANGES))
    for write in (graph.export_graphml, graph.export_jsonld):
        whole, firm = io.StringIO(), io.StringIO()
        write(g.nodes, g.edges, whole)
        write(g.nodes, g.edges, firm, provisional=False)
        assert all(x in whole.getvalue() for x in ("One", "Two", "Three")) and "Two" not in firm.getvalue() and "Three" in firm.getvalue()
    seen = spark.createDataFrame([("n1", "t", "1"), ("n2", "t", "2"), ("e2", "t", "1"), ("e3", "t", "1")], "owner string, table_name string, row_key string")
    graph.export_csv(g.nodes, g.edges, seen, str(tmp_path), provisional=False)
    read = lambda part: {r[0] for r in spark.read.csv(f"{tmp_path}/{part}", header=True).collect()}
    assert read("nodes") == {"n1", "n3"} and read("edges") == {"e2"} and read("provenance") == {"n1", "e2"}
