"""What a graph holds, folded from an append-only table of changes: found by machines, stated and corrected by people, deleted, reset.

Nothing is edited in place. A change has a place in time (``at``), and the fold takes places into account, not the order rows are stored or read in,
so replaying all changes, in any order, any number of times, gives the graph that making them one by one would.

Precedence: what people state or correct wins over what is found; of several statements the last wins, of several findings the first. A subject is provisional as
long as nothing but proposals speak for it. A deletion ends what came before it; a reset ends all that nobody had asserted by then; edges end with either end.

The fold is a few aggregates by subject, which combine before they shuffle; no subject's changes are gathered. Resets are the only changes that
concern all subjects; their times, one for each reset that a person made, go to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import Steps
from .graph import normalized
from .ontology import Ontology

#: kind: node or edge; class_id: an edge's relation; removed: properties that a correction takes away.
CHANGES = "at long, action string, kind string, id string, class_id string, label string, src string, dst string, properties map<string,string>, removed array<string>, author string, note string"
#: proposed: found by a model and not reviewed; found: by a table, or reviewed; cleared: a reset that keeps nothing.
PROPOSED, FOUND, ASSERTED, CORRECTED, DELETED, RESET, CLEARED = "proposed", "found", "asserted", "corrected", "deleted", "reset", "cleared"
_MACHINE, _PERSON = (PROPOSED, FOUND), (ASSERTED, CORRECTED)


@dataclass
class Graph:
    """nodes: id, class_id, label, normalized_label, properties, provisional, asserted; edges: id, relation_id, src, dst, properties, provisional, asserted;
    statements: id, author, note, at of what people said of subjects that are there."""

    nodes: DataFrame
    edges: DataFrame
    statements: DataFrame


def _is(*actions: str) -> Column:
    return F.col("action").isin(*actions)


def _ends(changes: DataFrame, resets: list[int], cleared: int, before: DataFrame | None) -> DataFrame:
    """(id, ended): the last time at which each subject ceased to be; what is later is live. before: (id, ended) that is known from elsewhere."""
    own = changes.groupBy("id").agg(F.max(F.when(_is(DELETED), F.col("at"))).alias("deleted"))
    if before is not None:
        own = own.join(before, "id", "left").withColumn("deleted", F.greatest("deleted", "ended")).drop("ended")
    own = own.withColumn("deleted", F.greatest("deleted", F.lit(cleared)))
    stated = changes.where(_is(*_PERSON)).select("id", "at").join(own, "id").where("at > deleted").groupBy("id").agg(F.min("at").alias("stated"))
    times = F.array(*map(F.lit, resets)).cast("array<bigint>")
    # A reset before the first statement ends the subject; later ones find it asserted.
    last = F.array_max(F.filter(times, lambda r: F.col("stated").isNull() | (r < F.col("stated"))))
    return own.join(stated, "id", "left").select("id", F.greatest("deleted", last).alias("ended"))


def _properties(live: DataFrame) -> DataFrame:
    """(id, properties) of live changes: statements before findings, the last of those, the first of these, after the last removal."""
    given = live.select("id", "at", "action", F.explode("properties").alias("key", "value")).where("value is not null")
    gone = live.select("id", "at", F.explode("removed").alias("key")).groupBy("id", "key").agg(F.max("at").alias("gone"))
    given = given.join(gone, ["id", "key"], "left").where(F.col("gone").isNull() | (F.col("at") >= F.col("gone")))
    stated = F.max_by("value", F.when(_is(*_PERSON), F.col("at")))
    found = F.min_by("value", F.when(_is(*_MACHINE), F.col("at")))
    settled = given.groupBy("id", "key").agg(F.coalesce(stated, found).alias("value"))
    return settled.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("properties"))


def _settled(name: str) -> Column:
    """The last correction of a field, else what the subject began with."""
    corrected = F.max_by(name, F.when(_is(CORRECTED) & F.col(name).isNotNull(), F.col("at")))
    return F.coalesce(corrected, F.min_by(name, F.when(~_is(CORRECTED), F.col("at")))).alias(name)


def fold(changes: DataFrame) -> Graph:
    """The graph that changes make.

    changes: CHANGES; ``at`` orders them and isn't repeated within a subject. Corrections and deletions concern subjects that were there, as ``faults`` sees to.
    Defined cases: a repeated row counts once; null ids and null property values count for nothing; edges without both ends aren't there; an id
    stays when a label or class is corrected; an empty table gives an empty graph.
    """
    steps = Steps(changes.sparkSession)
    times = changes.where(_is(RESET, CLEARED)).groupBy("action").agg(F.array_sort(F.collect_set("at")).alias("times")).collect()
    by = {r["action"]: r["times"] for r in times}
    resets, cleared = by.get(RESET, []), max(by.get(CLEARED, []), default=-1)
    said = changes.where(F.col("id").isNotNull() & ~_is(RESET, CLEARED))

    def of(kind: str, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        mine = said.where(F.col("kind") == kind)
        ended = steps.write(_ends(mine, resets, cleared, before))
        live = mine.join(ended, "id").where((F.col("at") > F.col("ended")) & ~_is(DELETED)).drop("ended")
        fields = ("class_id", "label") if kind == "node" else ("class_id", "src", "dst")
        one = live.groupBy("id").agg(*map(_settled, fields), F.every(_is(PROPOSED)).alias("provisional"), F.some(_is(*_PERSON)).alias("asserted"), F.count(F.when(~_is(CORRECTED), 1)).alias("begun"))
        empty = F.create_map().cast("map<string,string>")
        full = one.where("begun > 0").drop("begun").join(_properties(live), "id", "left").withColumn("properties", F.coalesce("properties", empty))
        return full, ended

    nodes, gone = of("node", None)
    nodes = steps.write(nodes.select("id", "class_id", F.trim("label").alias("label"), normalized(F.col("label")).alias("normalized_label"), "properties", "provisional", "asserted"))
    ends = said.where("kind = 'edge'").select("id", F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    with_ends = ends.join(gone.withColumnRenamed("id", "node"), "node").groupBy("id").agg(F.max("ended").alias("ended"))
    edges, gone_edges = of("edge", with_ends)
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    edges = steps.write(edges.select("id", F.col("class_id").alias("relation_id"), "src", "dst", "properties", "provisional", "asserted"))
    there = nodes.select("id").unionByName(edges.select("id"))
    statements = said.where(_is(*_PERSON)).join(gone.unionByName(gone_edges), "id").where("at > ended")
    return Graph(nodes, edges, statements.join(there, "id", "left_semi").select("id", "author", "note", "at").distinct())


def faults(new: DataFrame, now: Graph, o: Ontology) -> DataFrame:
    """(at, fault) of new changes that can't be taken: classes and relations that the ontology doesn't have, blank labels, corrections and deletions of what
    isn't there, labels that another node of the class has, edges that don't fit their ends, and class corrections that an edge at the node rules out."""
    stated, spark = new.where(_is(*_PERSON, DELETED)), new.sparkSession
    nodes, edges = stated.where("kind = 'node'"), stated.where("kind = 'edge'")
    label = lambda text: F.lit(text).alias("fault")
    found = [nodes.where(F.col("class_id").isNotNull() & ~F.col("class_id").isin(*o.classes) | _is(ASSERTED) & F.col("class_id").isNull()).select("at", label("no such class"))]
    found.append(nodes.where(F.trim("label") == "").select("at", label("blank label")))
    found.append(nodes.where(_is(ASSERTED) & F.col("label").isNull()).select("at", label("blank label")))
    there = now.nodes.select("id").unionByName(now.edges.select("id"))
    found.append(stated.where(_is(CORRECTED, DELETED)).join(there, "id", "left_anti").select("at", label("no such subject")))
    was = now.nodes.select("id", F.col("class_id").alias("was_class"), F.col("label").alias("was_label"))
    moved = nodes.where(_is(CORRECTED)).join(was, "id").select("at", "id", F.coalesce("class_id", "was_class").alias("class_id"), "was_class", normalized(F.coalesce("label", "was_label")).alias("normalized_label"))
    others = now.nodes.select(F.col("id").alias("other"), "class_id", "normalized_label")
    found.append(moved.join(others, ["class_id", "normalized_label"]).where("id != other").select("at", label("another node has the label")))
    classes = now.nodes.select("id", "class_id")
    ended = edges.where(_is(ASSERTED)).select("at", F.col("class_id").alias("relation_id"), "src", "dst")
    for end in ("src", "dst"):
        ended = ended.join(classes.toDF(end, f"{end}_class"), end, "left")
    found.append(ended.where("src_class is null or dst_class is null").select("at", label("no such end")))
    at_moved = moved.where("class_id != was_class").select("at", "id", "class_id")
    links = [ended.where("src_class is not null and dst_class is not null").select("at", "relation_id", "src_class", "dst_class")]
    for end, other in (("src", "dst"), ("dst", "src")):
        touching = now.edges.select("relation_id", F.col(end).alias("id"), F.col(other).alias("far")).join(at_moved, "id").join(classes.toDF("far", "far_class"), "far")
        sides = {end: F.when(F.lit(True), F.col("class_id")), other: F.when(F.col("far") == F.col("id"), F.col("class_id")).otherwise(F.col("far_class"))}
        links.append(touching.select("at", "relation_id", sides["src"].alias("src_class"), sides["dst"].alias("dst_class")))
    asked = links[0].unionByName(links[1]).unionByName(links[2])
    # Kinds of edges, not edges: as many as the ontology has relations and pairs of classes.
    kinds = [tuple(r) for r in asked.select("relation_id", "src_class", "dst_class").distinct().collect()]
    bad = spark.createDataFrame([k for k in kinds if not o.edge_fits(*k)], "relation_id string, src_class string, dst_class string")
    found.append(asked.join(bad, ["relation_id", "src_class", "dst_class"], "left_semi").select("at", label("edge doesn't fit")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()
