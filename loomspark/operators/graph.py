"""A graph from mapped tables: extraction, lookup, traversal, merging, revalidation, views and export.

Nodes: id, class_id, label, normalized_label, properties map<string,string>, keyed. Edges: id, relation_id, src, dst. Provenance: owner
(a node or edge id), table_name, row_key. Ids are hashes of what makes a row unique, so building twice gives the same graph.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Sequence
from typing import TextIO
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import normalized_label
from ..steps import Steps, buckets_of
from .grams import SUGGEST, candidates, scored
from .ontology import MENTIONS, Mapping, Ontology
from .strings import jaro_winkler_udf
from .vectors import cosine

MOST_NODES, MOST_HOPS, MOST_PATH = 200, 3, 6
#: Folders of the adjacency.
ADJACENT = 64
PROPOSE, AUTO, MOST_PROPOSALS = 0.08, 0.02, 5
#: Pairs of the first band of admission, and how many times larger the next one is.
BAND, BAND_GROWTH = 1 << 20, 8
#: Pairs a node of the first band where bands are compared one by one, and vectors by which its end is guessed.
PER_NODE, SAMPLED = 16, 256
#: Vectors of a block, and rows of a task, of the comparison.
BLOCK, BLOCK_ROWS = 2048, 50_000
#: Cosine distances within which a node's embedding stands for a text, and is worth suggesting.
ENTRY_DISTANCE, SUGGEST_DISTANCE = 0.25, 0.5


def normalized(text: Column) -> Column:
    """White space of any kind collapsed, then lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def node_id(cls: Column, label: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", cls, label), 256)


def edge_id(src: Column, relation: Column, dst: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", src, relation, dst), 256)


def extract(df: DataFrame, m: Mapping) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, provenance) of a table's rows. A row without a key gives nothing; a null property isn't one; of rows with one
    normalised key the first by key text and row hash gives each property it has. Targets of edges are nodes too, without properties."""
    key = F.col(m.key).cast("string")
    props = F.map_filter(F.map_from_arrays(F.array(*(F.lit(p) for _, p in m.properties)).cast("array<string>"), F.array(*(F.col(c).cast("string") for c, _ in m.properties)).cast("array<string>")), lambda k, v: v.isNotNull())
    rows = df.where(key.isNotNull() & (F.trim(key) != "")).select(key.alias("label"), normalized(key).alias("normalized_label"), props.alias("properties"), F.array(*(F.struct(F.lit(r).alias("relation_id"), F.lit(t).alias("target"), F.col(c).cast("string").alias("value")) for c, r, t in m.edges)).alias("links") if m.edges else F.array().cast("array<struct<relation_id:string,target:string,value:string>>").alias("links"))
    rows = rows.withColumn("id", node_id(F.lit(m.cls), F.col("normalized_label")))
    own = rows.groupBy("id", "normalized_label").agg(F.min(F.struct("label", F.xxhash64(F.to_json("properties")).alias("h"), F.to_json("properties").alias("p"))).alias("x"))
    own = own.select("id", F.lit(m.cls).alias("class_id"), F.col("x.label").alias("label"), "normalized_label", F.from_json("x.p", "map<string,string>").alias("properties"), F.lit(True).alias("keyed"))
    links = rows.select(F.col("id").alias("src"), F.col("label").alias("row_key"), F.explode("links").alias("l")).select("src", "row_key", "l.relation_id", "l.target", F.col("l.value").alias("label")).where("label is not null and trim(label) != ''")
    links = links.withColumn("normalized_label", normalized(F.col("label"))).withColumn("dst", node_id(F.col("target"), F.col("normalized_label")))
    far = links.groupBy(F.col("dst").alias("id"), F.col("target").alias("class_id"), "normalized_label").agg(F.min("label").alias("label")).select("id", "class_id", "label", "normalized_label", F.create_map().cast("map<string,string>").alias("properties"), F.lit(True).alias("keyed"))
    edges = links.select("relation_id", "src", "dst", "row_key").withColumn("id", edge_id(F.col("src"), F.col("relation_id"), F.col("dst")))
    seen = rows.select(F.col("id").alias("owner"), F.lit(m.table).alias("table_name"), F.col("label").alias("row_key")).unionByName(edges.select(F.col("id").alias("owner"), F.lit(m.table).alias("table_name"), "row_key")).distinct()
    return own.unionByName(far), edges.select("id", "relation_id", "src", "dst").dropDuplicates(["id"]), seen


def merged_properties(old: Column, new: Column) -> Column:
    """Properties of new over those of old."""
    return F.map_zip_with(F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))


def union_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of both, new properties over old ones; labels stay."""
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    keyed = F.coalesce(F.col("a.keyed"), F.lit(False)) | F.coalesce(F.col("b.keyed"), F.lit(False))
    return a.join(b, F.col("a.id") == F.col("b.id"), "full").select(pick("id"), pick("class_id"), pick("label"), pick("normalized_label"), merged_properties(F.col("a.properties"), F.col("b.properties")).alias("properties"), keyed.alias("keyed"))


def fill_gaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """As union_nodes, but old properties win: what a document adds to a reviewed node."""
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    keyed = F.coalesce(F.col("a.keyed"), F.lit(False)) | F.coalesce(F.col("b.keyed"), F.lit(False))
    return a.join(b, F.col("a.id") == F.col("b.id"), "full").select(pick("id"), pick("class_id"), pick("label"), pick("normalized_label"), merged_properties(F.col("b.properties"), F.col("a.properties")).alias("properties"), keyed.alias("keyed"))


def build(tables: dict[str, DataFrame], o: Ontology) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of all mapped tables. A node that several tables give has the properties of all, a later mapping's over an earlier's."""
    nodes = edges = seen = None
    for n, m in enumerate(m for m in o.mappings if m.table in tables):
        a, b, c = extract(tables[m.table], m)
        a = a.withColumn("turn", F.lit(n))
        nodes, edges, seen = (a, b, c) if nodes is None else (nodes.unionByName(a), edges.unionByName(b), seen.unionByName(c))
    # One aggregate: the first label, and each property from the latest mapping that has it.
    flat = nodes.groupBy("id", "class_id", "normalized_label").agg(F.min(F.struct("turn", "label")).alias("l"), F.max("keyed").alias("keyed"), F.sort_array(F.collect_list(F.struct("turn", F.map_entries("properties").alias("e")))).alias("p"))
    entries = F.flatten(F.transform("p", lambda x: x["e"]))
    merged = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_zip_with(acc, F.map_from_entries(F.array(e)), lambda k, a, b: F.coalesce(b, a)))
    nodes = flat.select("id", "class_id", F.col("l.label").alias("label"), "normalized_label", merged.alias("properties"), "keyed")
    return nodes, edges.dropDuplicates(["id"]), seen.distinct()


def fingerprint(df: DataFrame, owner: str) -> DataFrame:
    """(owner, n_rows, hash) of a table; equal while no row changes, in whatever order."""
    return df.agg(F.lit(owner).alias("owner"), F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


# Traversal


def nearest(nodes: DataFrame, vectors: DataFrame, vector_of: Sequence[float], *, cls: set[str] | None = None, most: int = 3, within: float = ENTRY_DISTANCE) -> DataFrame:
    """The nodes whose embeddings (vectors: id, embedding) have the least cosine distance from a vector, none beyond ``within``; with that distance, ties by id."""
    near = vectors.select("id", (1 - cosine(vector_of)("embedding")).alias("distance")).where(F.col("distance") <= within)
    return _of(nodes.join(near, "id"), cls).orderBy("distance", "id").limit(most)


def _of(nodes: DataFrame, cls: set[str] | None) -> DataFrame:
    return nodes.where(F.col("class_id").isin(sorted(cls))) if cls else nodes


def lookup(nodes: DataFrame, text: str, *, cls: set[str] | None = None, aliases: DataFrame | None = None, vectors: DataFrame | None = None, vector_of: Sequence[float] | None = None) -> DataFrame:
    """Nodes with this normalised label, or an alias (node_id, alias) of it; of some classes only. A blank text finds nothing.

    Where none has it, and the text's vector and those of the nodes (id, embedding) are given, the 3 nearest within ENTRY_DISTANCE.
    """
    want = normalized_label(text)
    if not want:
        return nodes.limit(0)
    found = nodes.where(F.col("normalized_label") == want)
    if aliases is not None:
        by = aliases.where(normalized(F.col("alias")) == want).select(F.col("node_id").alias("id"))
        found = found.unionByName(nodes.join(by, "id", "left_semi")).dropDuplicates(["id"])
    found = _of(found, cls)
    if vectors is None or vector_of is None or not found.isEmpty():
        return found
    return nearest(nodes, vectors, vector_of, cls=cls).select(*nodes.columns)


def suggestions(nodes: DataFrame, text: str, *, most: int = 5, alike: float = 0.88, cls: set[str] | None = None, vectors: DataFrame | None = None, vector_of: Sequence[float] | None = None) -> DataFrame:
    """Nodes whose label holds the text, is held by it, or is as similar; best first, then shorter, then by label. A blank text has none.

    With the text's vector and those of the nodes (id, embedding), the nearest within SUGGEST_DISTANCE follow, with a null similarity,
    unless one of that label and class is there already.
    """
    want = F.lit(normalized_label(text))
    if not normalized_label(text):
        return nodes.limit(0).withColumn("similarity", F.lit(None).cast("double"))
    label = F.col("normalized_label")
    scored = _of(nodes, cls).withColumn("similarity", jaro_winkler_udf()(label, want))
    like = label.contains(want) | want.contains(label) | (F.col("similarity") >= alike)
    best = scored.where(like).orderBy(F.desc("similarity"), F.length("label"), "label").limit(most)
    if vectors is None or vector_of is None:
        return best
    near = nearest(nodes, vectors, vector_of, cls=cls, most=most, within=SUGGEST_DISTANCE).withColumn("place", F.lit(1))
    both = best.withColumn("place", F.lit(0)).unionByName(near, allowMissingColumns=True)
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("label", "class_id").orderBy("place", "distance", "id")))
    both = both.where("place = 0 or nth = 1").orderBy("place", F.desc("similarity"), "distance", F.length("label"), "label").limit(most)
    return both.select(*nodes.columns, "similarity")


def indexed_suggestions(spark: SparkSession, index: str, text: str, *, most: int = 5, alike: float = SUGGEST, cls: set[str] | None = None) -> DataFrame:
    """``suggestions`` by labels, through what ``grams.write_label_index`` wrote to ``index``: id, class_id, label, normalized_label and similarity. Only labels
    that may fit are read and scored. alike is SUGGEST or more."""
    wanted = normalized_label(text)
    if not wanted:
        return spark.createDataFrame([], "id string, class_id string, label string, normalized_label string, similarity double")
    label = F.col("normalized_label")
    found = scored(_of(candidates(spark, index, wanted, alike=alike), cls), wanted, alike=alike)
    like = label.contains(wanted) | F.lit(wanted).contains(label) | (F.col("similarity") >= alike)
    return found.where(like).orderBy(F.desc("similarity"), F.length("label"), "label").limit(most)


def _ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: here, there, relation_id, id, src, dst."""
    way = lambda here, there: edges.select(F.col(here).alias("here"), F.col(there).alias("there"), "relation_id", "id", "src", "dst")
    return way("src", "dst").unionByName(way("dst", "src"))


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Write edges from either end, in ADJACENT folders by hash of the node they start from and sorted by it, so that a hop reads row groups of its nodes only. A bucket
    with a hot node is dealt over several files."""
    dealt = _ways(edges).withColumn("bucket", F.pmod(F.xxhash64("here"), F.lit(ADJACENT)).cast("int"))
    dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "here").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _from(edges: DataFrame, adjacency: str | None, frontier: Sequence[str]) -> DataFrame:
    """The ways that start from nodes."""
    if adjacency is None:
        return _ways(edges).where(F.col("here").isin(list(frontier)))
    spark = edges.sparkSession
    return spark.read.parquet(adjacency).where(F.col("bucket").isin(buckets_of(spark, list(frontier), ADJACENT)) & F.col("here").isin(list(frontier)))


def neighborhood(nodes: DataFrame, edges: DataFrame, start: str | Sequence[str], *, hops: int = 2, most: int = MOST_NODES, relations: Sequence[str] | None = None, adjacency: str | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges among them, whether the cap was filled) within some hops of one node or several, edges taken either way, those of some
    relations only if ``relations`` names any. 0 hops count as 1; of more roots than the cap the first ones are taken.

    The frontier is a few hundred ids at most, so each hop is one filter by a short list, on what ``write_adjacency`` wrote to ``adjacency`` or else on all edges, and only as many
    ids as the cap allows come back, in the order of (relation_id, id) of their edges.
    """
    roots = list(dict.fromkeys([start] if isinstance(start, str) else start))[:most]
    visited, frontier = list(roots), list(roots)
    related = F.col("relation_id").isin(list(relations)) if relations else F.lit(True)
    for _ in range(min(max(1, hops), MOST_HOPS)):
        if not frontier or len(visited) >= most:
            break
        other = _from(edges, adjacency, frontier).where(related).select("relation_id", "id", F.col("there").alias("node")).where(~F.col("node").isin(visited))
        order = other.groupBy("node").agg(F.min(F.struct("relation_id", "id", "node")).alias("o")).orderBy("o").limit(most - len(visited))
        frontier = [r["node"] for r in order.collect()]
        visited += frontier
    among = edges.where(F.col("src").isin(visited) & F.col("dst").isin(visited))
    if adjacency is not None and visited:
        among = _from(edges, adjacency, visited).where((F.col("here") == F.col("src")) & F.col("there").isin(visited)).select("id", "relation_id", "src", "dst").distinct()
    return nodes.where(F.col("id").isin(visited)), among.where(related), len(visited) >= most


def shortest_path(edges: DataFrame, start: str, goal: str, *, most_hops: int = MOST_PATH, most: int = 10_000, adjacency: str | None = None) -> list[tuple[str, str, str]] | None:
    """The shortest chain of edges (id, from, to) between two nodes, either way, the first by (relation_id, id) of equal ones; None beyond ``most_hops``.

    Each hop reads the edges at its frontier, from ``adjacency`` (``write_adjacency``) if given. Up to ``most`` reached nodes are a list on the driver; from the hop that
    reaches more, hops are tables, joined with the edges, and the driver gets the path's own nodes only.
    """
    parents: dict[str, tuple[str, str] | None] = {start: None}
    frontier, hop, hops = [start], 0, min(most_hops, MOST_PATH)
    steps, levels = Steps(edges.sparkSession), []
    first = F.min(F.struct("relation_id", "id", "here")).alias("p")
    while hop < hops and goal not in parents and frontier and not levels:
        hop += 1
        step = _from(edges, adjacency, frontier).where(~F.col("there").isin(list(parents))).groupBy("there").agg(first).select("there", "p.id", "p.here", "p.relation_id")
        got = step.orderBy(F.col("there") != goal, "relation_id", "id", "there").limit(most - len(parents) + 1).collect()
        if len(parents) + len(got) > most and not any(r["there"] == goal for r in got):
            levels = [steps.write(step)]
        else:
            frontier = [r["there"] for r in got]
            parents |= {r["there"]: (r["id"], r["here"]) for r in got}
    if levels:
        ways = _ways(edges) if adjacency is None else edges.sparkSession.read.parquet(adjacency)
        reached = steps.write(edges.sparkSession.createDataFrame([(n,) for n in parents], "there string").unionByName(levels[0].select("there")))
        while hop < hops and levels[-1].where(F.col("there") == goal).isEmpty():
            hop += 1
            level = steps.write(ways.join(levels[-1].select(F.col("there").alias("here")), "here").join(reached, "there", "left_anti").groupBy("there").agg(first).select("there", "p.id", "p.here", "p.relation_id"))
            if level.isEmpty():
                break
            levels.append(level)
            reached = reached.unionByName(level.select("there"))
    path, at = [], goal
    for level in reversed(levels):
        if r := level.where(F.col("there") == at).first():
            path.append((r["id"], r["here"], at))
            at = r["here"]
    steps.drop(*levels)
    if at not in parents:
        return None
    while parents[at]:
        edge, before = parents[at]
        path.append((edge, before, at))
        at = before
    return path[::-1]


def class_listing(nodes: DataFrame, o: Ontology, cls: str, *, limit: int = 100) -> tuple[DataFrame, int]:
    """(nodes of a class and its subclasses by label, how many there are)."""
    of = nodes.where(F.col("class_id").isin(sorted(o.descendants(cls))))
    return of.orderBy("label", "id").limit(limit), of.count()


# Merging


def merge_candidates(vectors: DataFrame, *, distance: float = PROPOSE, above: float | None = None) -> DataFrame:
    """(a, b, distance) of pairs of one class, not both keyed, whose embeddings are so near, and farther than ``above``; a < b. vectors: id, class_id, embedding, keyed.

    Pairs are compared as blocks: a class's vectors are dealt into blocks of bounded size, and each pair of blocks is a
    group of its own, so no task holds a whole class. Tasks are as many as their rows ask for, by number.
    """
    counts = vectors.groupBy("class_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"), F.count("*").alias("n"))
    groups, rows = counts.agg(F.coalesce(F.sum(F.expr("g * (g + 1L) / 2")), F.lit(0)).cast("long"), F.coalesce(F.sum(F.col("g") * F.col("n")), F.lit(0))).first()
    dealt = vectors.where("embedding is not null").join(counts.drop("n"), "class_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("i", F.least("part", "x")).withColumn("j", F.greatest("part", "x"))
    kind = dict(vectors.dtypes)["id"]

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id")
        x = np.array([np.asarray(v, np.float64) for v in pdf["embedding"]])
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        x = x / np.where(norm > 0, norm, np.nan)
        ids, keyed, part = pdf["id"].to_numpy(), pdf["keyed"].to_numpy(bool), pdf["part"].to_numpy()
        left, right = (np.flatnonzero(part == k) for k in key[1:3])
        found = []
        for start in range(0, len(left), 256):
            rows = left[start : start + 256]
            d = 1 - x[rows] @ x[right].T
            a, b = np.nonzero(d <= distance if above is None else (d <= distance) & (d > above))
            d, a, b = d[a, b], rows[a], right[b]
            ok = ~(keyed[a] & keyed[b]) & ((ids[a] < ids[b]) if key[1] == key[2] else (ids[a] != ids[b]))
            d, a, b = d[ok], ids[a[ok]], ids[b[ok]]
            found.append(pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "distance": d}))
        return pd.concat(found) if found else pd.DataFrame({"a": ids[:0], "b": ids[:0], "distance": np.zeros(0)})

    tasks = max(1, min(groups, 64), rows // BLOCK_ROWS)
    return dealt.select("id", "class_id", "embedding", "keyed", "part", "i", "j").repartition(tasks, "class_id", "i", "j").groupBy("class_id", "i", "j").applyInPandas(pairs, f"a {kind}, b {kind}, distance double")


_UNSPACED = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"


def token_parts(label: Column) -> Column:
    """What labels share a token by: words of 3 characters or more, and pairs of neighbouring characters of unspaced scripts."""
    words = F.filter(F.regexp_extract_all(F.lower(label), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) >= 3)
    runs = F.regexp_extract_all(label, F.lit(f"[{_UNSPACED}]{{2,}}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_union(words, pairs)


def shares_token(a: Column, b: Column) -> Column:
    return F.arrays_overlap(token_parts(a), token_parts(b))


def admitted(pairs: DataFrame, *, most: int = MOST_PROPOSALS) -> tuple[DataFrame, int]:
    """(pairs that are admitted, rounds taken). pairs: a, b, distance.

    The rule is sequential: nearest first, then by a and b, a pair is admitted if neither node is in ``most`` admitted ones yet. It is
    worked out in rounds: a pair that is among the first open ones of both its nodes, as many as each has places left, is admitted, since even all
    earlier ones would leave it a place; pairs of nodes without places go. Pairs are taken up in bands of growing distance, so that most are gone
    before they are looked at; of a pair with several rows the nearest counts. Each round admits the nearest open pair at least. Spark
    keeps ``most`` pairs of a node in each task before it shuffles, so a node with very many pairs is no large group.
    """
    steps = Steps(pairs.sparkSession)
    whole = steps.write(pairs.select("a", "b", "distance").where("a is not null and b is not null"))
    bands = iter(_bands(whole))

    def next_band(full: DataFrame | None) -> DataFrame | None:
        band = next(bands, None)
        near = None if band is None else whole.where(band)
        return near if near is None or full is None else _without(near, full)

    taken, rounds = _admit(steps, next_band, most)
    return (functools.reduce(DataFrame.unionByName, taken) if taken else whole.limit(0)), rounds


def admitted_near(vectors: DataFrame, *, distance: float, most: int = MOST_PROPOSALS, digits: int = 6) -> tuple[DataFrame, int]:
    """What ``admitted`` admits of all ``merge_candidates`` with distances in so many digits, without a table of them. vectors: id, class_id, embedding, keyed.

    Each band of growing distance is compared for itself and only between nodes with places left; the nearest pairs, PER_NODE a node, fill the
    places of most. Where a band ends is guessed from the distances of some vectors to all: it decides how many pairs are there at once, not which.
    """
    steps = Steps(vectors.sparkSession)
    low, size, margin = None, PER_NODE, 10.0**-digits

    def next_band(full: DataFrame | None) -> DataFrame | None:
        nonlocal low, size
        if low is not None and low >= distance:
            return None
        open_ = steps.write(vectors if full is None else vectors.join(full.withColumnRenamed("node", "id"), "id", "left_anti"))
        high = _cut(open_, low, distance, size, digits)
        near = merge_candidates(open_, distance=min(distance, high + margin), above=None if low is None else low - margin).withColumn("distance", F.round("distance", digits))
        # Where a band begins and ends is decided on the rounded distances, which are the order.
        near = near.where((F.lit(True) if low is None else F.col("distance") > low) & (F.lit(True) if high >= distance else F.col("distance") <= high))
        low, size = high, size * BAND_GROWTH
        return near

    taken, rounds = _admit(steps, next_band, most)
    kind = dict(vectors.dtypes)["id"]
    return (functools.reduce(DataFrame.unionByName, taken) if taken else vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, distance double")), rounds


def _cut(vectors: DataFrame, low: float | None, distance: float, size: int, digits: int) -> float:
    """A distance up to which there are about ``size`` pairs a node beyond low, BAND at least; ``distance`` if there are fewer in all."""
    some = vectors.where("embedding is not null").orderBy(F.xxhash64("id")).limit(SAMPLED).collect()
    classes = {c: np.array([np.asarray(r["embedding"], np.float64) for r in some if r["class_id"] == c]) for c in {r["class_id"] for r in some}}
    edges = np.linspace(low or 0.0, distance, 2001)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda x: x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) > 0, n, np.nan)
        for pdf in batches:
            for c, of in pdf[pdf["class_id"].isin(list(classes))].groupby("class_id"):
                d = 1 - unit(np.array([np.asarray(v, np.float64) for v in of["embedding"]])) @ unit(classes[c]).T
                bins = np.searchsorted(edges, d[(d <= distance) & (d > (-1 if low is None else low))])
                n = np.bincount(bins, minlength=len(edges))
                yield pd.DataFrame({"bin": np.flatnonzero(n), "n": n[n > 0]})

    seen = vectors.where("embedding is not null").select("class_id", "embedding").mapInPandas(look, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    m = vectors.count()
    n = np.zeros(len(edges))
    for r in seen:
        n[r["bin"]] = r["n"]
    pairs = np.cumsum(n) * m / (2 * max(len(some), 1))
    enough = max(BAND, size * m)
    if pairs[-1] <= enough:
        return distance
    high = round(float(edges[max(np.searchsorted(pairs, enough, "right") - 1, 1)]), digits)
    return high if (low is None or high > low) and high < distance else distance


def _admit(steps: Steps, next_band, most: int) -> tuple[list[DataFrame], int]:
    """(tables of admitted pairs, rounds). next_band: (nodes without places, or None at first) -> the pairs of the next band that have none of them; None after the last."""
    order = Window.partitionBy("node").orderBy("distance", "a", "b")
    taken, rounds = [], 0
    places: DataFrame | None = None
    while (near := next_band(None if places is None else places.where(F.col("used") >= most).select("node"))) is not None:
        # What earlier bands took, and the pairs of nodes without places, are gone before anything is grouped or sorted.
        if taken:
            near = near.join(functools.reduce(DataFrame.unionByName, taken).select("a", "b"), ["a", "b"], "left_anti")
        open_ = steps.write(near.groupBy("a", "b").agg(F.min("distance").alias("distance")))
        while not open_.isEmpty():
            rounds += 1
            ends = open_.withColumn("node", F.explode(F.array("a", "b")))
            first = ends.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
            if places is not None:
                first = first.join(places, "node", "left").where(F.col("nth") <= most - F.coalesce("used", F.lit(0)))
            now = steps.write(first.groupBy("a", "b").agg(F.first("distance").alias("distance"), F.count("*").alias("ends")).where("ends = 2").drop("ends"))
            taken.append(now)
            used = now.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("used"))
            if places is not None:
                used = used.unionByName(places).groupBy("node").agg(F.sum("used").alias("used"))
            places = steps.write(used)
            left = _without(open_.join(now.select("a", "b"), ["a", "b"], "left_anti"), places.where(F.col("used") >= most).select("node"))
            before, open_ = open_, steps.write(left.select("a", "b", "distance"))
            steps.drop(before)
    return taken, rounds


def _without(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(nodes.withColumnRenamed("node", "a"), "a", "left_anti").join(nodes.withColumnRenamed("node", "b"), "b", "left_anti")


def _bands(pairs: DataFrame) -> list[Column]:
    """Conditions that cut pairs into bands of growing distance, BAND in the first and BAND_GROWTH times as many in each next one: the nearest pairs fill most nodes' places."""
    total, shares, size = pairs.count(), [], BAND
    while size < total:
        shares.append(size / total)
        size += size * BAND_GROWTH
    cuts = sorted({c for c in pairs.agg(F.percentile_approx("distance", shares, 100_000)).first()[0] or []}) if shares else []
    d, over = F.col("distance"), [F.lit(True), *(F.col("distance") > c for c in cuts)]
    # Null distances come first in the order.
    return [(low if i else F.lit(True)) & (d <= c if i else d.isNull() | (d <= c)) for i, (low, c) in enumerate(zip(over, cuts))] + [over[-1]]


def proposals(pairs: DataFrame, nodes: DataFrame, *, most: int = MOST_PROPOSALS) -> DataFrame:
    """(a, b, distance) of admitted pairs whose labels share a token; others use up their places, but aren't proposed. nodes: id, label."""
    return _sharing(admitted(pairs, most=most)[0], nodes)


def near_proposals(vectors: DataFrame, nodes: DataFrame, *, distance: float = PROPOSE, most: int = MOST_PROPOSALS, digits: int = 6) -> DataFrame:
    """``proposals`` of the ``merge_candidates`` of vectors, with distances in so many digits."""
    return _sharing(admitted_near(vectors, distance=distance, most=most, digits=digits)[0], nodes)


def _sharing(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    label = nodes.select("id", "label")
    named = chosen.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b")
    return named.where(shares_token(F.col("la"), F.col("lb"))).select("a", "b", "distance")


def survivor(a: dict, b: dict) -> tuple[str, str]:
    """(kept, merged away): the keyed one, else the one with more provenance, else the lesser id."""
    rank = lambda n: (not n["keyed"], -n["evidence"], n["id"])
    keep, gone = sorted((a, b), key=rank)
    return keep["id"], gone["id"]


def final_merges(merges: DataFrame) -> DataFrame:
    """(gone, kept) with chains followed to their end, by doubling: a chain of n merges takes log2(n) joins. Merges in a circle are an error."""
    now = merges.select("gone", "kept").where("gone != kept").dropDuplicates(["gone"])
    for _ in range(40):
        step = now.select(F.col("gone").alias("kept"), F.col("kept").alias("loom_next"))
        open_ = now.join(step, "kept", "left_semi")
        if open_.isEmpty():
            return now
        if not open_.where("gone = kept").isEmpty():
            break
        now = now.join(step, "kept", "left").select("gone", F.coalesce("loom_next", "kept").alias("kept"))
    raise ValueError("nodes are merged in a circle")


def merged_aliases(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """(node_id, alias): the labels of merged nodes, as other names of those that they became; ``lookup`` takes them."""
    gone = nodes.join(final_merges(merges).withColumnRenamed("gone", "id"), "id").select(F.col("kept").alias("node_id"), F.col("label").alias("alias"))
    own = nodes.select(F.col("id").alias("node_id"), F.col("label").alias("alias"))
    return gone.distinct().join(own, ["node_id", "alias"], "left_anti")


def merge_nodes(nodes: DataFrame, edges: DataFrame, seen: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with nodes merged (gone, kept): edges point to the kept one, repeated edges and loops go, provenance moves along, kept nodes' own
    properties win. A node that is merged into one which goes as well ends where that one does."""
    to = final_merges(merges).select(F.col("gone").alias("id"), "kept")
    moved = lambda df, c: df.join(to.withColumnRenamed("id", c).withColumnRenamed("kept", f"{c}_to"), c, "left").withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_to")
    new = moved(moved(edges, "src"), "dst").where("src != dst").withColumn("old", F.col("id")).withColumn("id", edge_id(F.col("src"), F.col("relation_id"), F.col("dst")))
    renamed = new.select(F.col("old").alias("id"), F.col("id").alias("kept")).where("id != kept")
    gone = nodes.join(to, "id").select(F.col("kept").alias("id"), "properties").groupBy("id").agg(F.collect_list("properties").alias("more"))
    extra = F.aggregate("more", F.col("properties"), lambda acc, p: F.map_zip_with(acc, p, lambda k, a, b: F.coalesce(a, b)))
    kept = nodes.join(to, "id", "left_anti").join(gone, "id", "left").withColumn("properties", F.when(F.col("more").isNull(), F.col("properties")).otherwise(extra)).drop("more")
    owners = to.unionByName(renamed).withColumnRenamed("id", "owner")
    evidence = seen.join(owners, "owner", "left").withColumn("owner", F.coalesce("kept", "owner")).drop("kept").distinct()
    return kept, new.drop("old").dropDuplicates(["id"]), evidence


# Upkeep


def misfits(nodes: DataFrame, edges: DataFrame, o: Ontology) -> tuple[DataFrame, DataFrame]:
    """(nodes of unknown classes, edges that their relation's domain or range doesn't allow, or whose ends are missing or misfits)."""
    spark = nodes.sparkSession
    closure = spark.createDataFrame(o.closure(), "class_id string, ancestor string")
    rules = spark.createDataFrame([(r.id, r.domain, r.range) for r in o.relations.values()], "relation_id string, domain string, range string")
    bad_nodes = nodes.join(F.broadcast(closure.select("class_id").distinct()), "class_id", "left_anti")
    good = nodes.join(F.broadcast(closure.select("class_id").distinct()), "class_id", "left_semi").select("id", "class_id")
    ends = edges.join(good.select(F.col("id").alias("src"), F.col("class_id").alias("src_class")), "src", "left").join(good.select(F.col("id").alias("dst"), F.col("class_id").alias("dst_class")), "dst", "left")
    down, up = closure.select(F.col("class_id").alias("src_class"), F.col("ancestor").alias("domain")), closure.select(F.col("class_id").alias("dst_class"), F.col("ancestor").alias("range"))
    fits = ends.join(F.broadcast(rules), "relation_id").join(F.broadcast(down), ["src_class", "domain"], "left_semi").join(F.broadcast(up), ["dst_class", "range"], "left_semi").select("id")
    mentions = ends.where((F.col("relation_id") == MENTIONS) & F.col("src_class").isNotNull() & F.col("dst_class").isNotNull()).select("id")
    return bad_nodes, edges.join(fits.unionByName(mentions), "id", "left_anti")


def revalidate(nodes: DataFrame, edges: DataFrame, o: Ontology) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes and edges without misfits, and a preview (what, name, n) of what goes)."""
    bad_nodes, bad_edges = misfits(nodes, edges, o)
    preview = bad_nodes.groupBy(F.lit("node").alias("what"), F.col("class_id").alias("name")).agg(F.count("*").alias("n")).unionByName(bad_edges.groupBy(F.lit("edge").alias("what"), F.col("relation_id").alias("name")).agg(F.count("*").alias("n")))
    return nodes.join(bad_nodes.select("id"), "id", "left_anti"), edges.join(bad_edges.select("id"), "id", "left_anti"), preview


_SQL_TYPE = {"string": "string", "number": "double", "date": "date", "enum": "string", "boolean": "boolean"}


def class_view(nodes: DataFrame, o: Ontology, cls: str) -> DataFrame:
    """id, label, class_id and typed properties of a class and its subclasses; a property that has one of these names is name_property, one that
    doesn't read as its type is null."""
    own = ("id", "label", "class_id")
    typed = [F.col("properties")[p.name].try_cast(_SQL_TYPE[p.kind]).alias(p.name if p.name not in own else f"{p.name}_property") for p in o.properties(cls).values()]
    return nodes.where(F.col("class_id").isin(sorted(o.descendants(cls)))).select(*own, *typed)


def edge_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"), F.col("class_id").alias(f"{side}_class"))
    return edges.join(end("src"), "src").join(end("dst"), "dst")


def create_views(nodes: DataFrame, edges: DataFrame, o: Ontology) -> list[str]:
    """graph_<class> for every class, and graph_edges, as temporary views."""
    for c in o.classes:
        class_view(nodes, o, c).createOrReplaceTempView(f"graph_{c}")
    edge_view(nodes, edges).createOrReplaceTempView("graph_edges")
    return [*(f"graph_{c}" for c in o.classes), "graph_edges"]


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes by class, edges by relation."""
    return nodes.groupBy(F.lit("class").alias("what"), F.col("class_id").alias("name")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("relation").alias("what"), F.col("relation_id").alias("name")).agg(F.count("*").alias("n")))


def provenance(seen: DataFrame, nodes: DataFrame) -> DataFrame:
    """(table_name, row_key, node_id, label): which rows, or chunks, speak of which nodes."""
    return seen.join(nodes.select(F.col("id").alias("owner"), "label"), "owner").select("table_name", "row_key", F.col("owner").alias("node_id"), "label")


def assert_node(nodes: DataFrame, cls: str, label: str, properties: dict[str, str]) -> DataFrame:
    """The nodes with one stated by hand; its properties win."""
    spark: SparkSession = nodes.sparkSession
    one = spark.createDataFrame([(cls, label, properties)], "class_id string, label string, properties map<string,string>").withColumn("normalized_label", normalized(F.col("label")))
    one = one.select(node_id(F.col("class_id"), F.col("normalized_label")).alias("id"), "class_id", "label", "normalized_label", "properties", F.lit(False).alias("keyed"))
    return union_nodes(nodes, one)


def delete_node(nodes: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("id") != node), edges.where((F.col("src") != node) & (F.col("dst") != node))


# Export


def reviewed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an export without provisional parts holds: reviewed nodes, and reviewed edges between them. Tables without the column hold nothing provisional."""
    firm = lambda df: df.where("not coalesce(provisional, false)") if "provisional" in df.columns else df
    kept, links = firm(nodes), firm(edges)
    for end in ("src", "dst"):
        links = links.join(kept.select(F.col("id").alias(end)), end, "left_semi")
    return kept, links.select(*edges.columns)


def export_csv(nodes: DataFrame, edges: DataFrame, seen: DataFrame, path: str, *, provisional: bool = True) -> None:
    """Three folders of CSV: nodes, edges, provenance. Without provisional, only what ``reviewed`` holds and its provenance; so in the other exports."""
    if not provisional:
        nodes, edges = reviewed(nodes, edges)
        seen = seen.join(nodes.select("id").unionByName(edges.select("id")).toDF("owner"), "owner", "left_semi")
    nodes.withColumn("properties", F.to_json("properties")).write.mode("overwrite").csv(f"{path}/nodes", header=True)
    links = edges.withColumn("properties", F.to_json("properties")) if "properties" in edges.columns else edges
    links.write.mode("overwrite").csv(f"{path}/edges", header=True)
    seen.write.mode("overwrite").csv(f"{path}/provenance", header=True)


def export_graphml(nodes: DataFrame, edges: DataFrame, out: TextIO, *, provisional: bool = True) -> None:
    nodes, edges = (nodes, edges) if provisional else reviewed(nodes, edges)
    out.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
    for k, of in (("class", "node"), ("label", "node"), ("properties", "node"), ("relation", "edge")):
        out.write(f'  <key id="{k}" for="{of}" attr.name="{k}" attr.type="string"/>\n')
    out.write('  <graph edgedefault="directed">\n')
    for n in nodes.orderBy("id").toLocalIterator():
        out.write(f"    <node id={quoteattr(n['id'])}><data key=\"class\">{escape(n['class_id'])}</data><data key=\"label\">{escape(n['label'])}</data><data key=\"properties\">{escape(json.dumps(n['properties'] or {}, sort_keys=True))}</data></node>\n")
    for e in edges.orderBy("id").toLocalIterator():
        out.write(f"    <edge id={quoteattr(e['id'])} source={quoteattr(e['src'])} target={quoteattr(e['dst'])}><data key=\"relation\">{escape(e['relation_id'])}</data></edge>\n")
    out.write("  </graph>\n</graphml>\n")


def export_jsonld(nodes: DataFrame, edges: DataFrame, out: TextIO, base: str = "urn:loom:", *, provisional: bool = True) -> None:
    nodes, edges = (nodes, edges) if provisional else reviewed(nodes, edges)
    out.write(json.dumps({"@context": {"@vocab": base, "label": "http://www.w3.org/2000/01/rdf-schema#label"}})[:-1] + ', "@graph": [')
    links = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("relation_id", "dst"))).alias("links"))
    first = True
    for n in nodes.join(links, "id", "left").orderBy("id").toLocalIterator():
        item = {"@id": base + n["id"], "@type": n["class_id"], "label": n["label"], **(n["properties"] or {})}
        for e in n["links"] or []:
            item.setdefault(e["relation_id"], []).append({"@id": base + e["dst"]})
        out.write(("" if first else ",") + "\n" + json.dumps(item, sort_keys=True))
        first = False
    out.write("\n]}\n")


