"""Classes induced from what documents mention: one vocabulary of names, and the hierarchy of classes.

Both are defined by sequential rules and computed as rounds of joins that give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import Steps
from .similarity import similar_pairs

#: Names of the first batch, and how many times larger the next one is.
BATCH, GROWTH = 4096, 8
#: Classes of an entity up to which they are one list.
LISTED = 128


def snake(name: Column) -> Column:
    """``functions.names.snake_id`` as an expression."""
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "unnamed").when(out.rlike("^[0-9]"), F.concat(F.lit("t_"), out)).otherwise(out)


def singular_form(name: Column) -> Column:
    """``functions.names.singular`` as an expression."""
    short = F.substring(name, F.lit(1), F.greatest(F.length(name) - 3, F.lit(0)))
    one_less = F.substring(name, F.lit(1), F.greatest(F.length(name) - 1, F.lit(0)))
    return F.when(name.endswith("ies"), F.concat(short, F.lit("y"))).when(name.endswith("ss") | (F.length(name) < 4) | ~name.endswith("s"), name).otherwise(one_less)


def leaders(ranked: DataFrame, *, alike: float, steps: Steps) -> tuple[DataFrame, int]:
    """((text, leader) of every text, rounds taken). ranked: text (each once), rank (long, each once).

    The rule is sequential: in order of rank a text joins the first leader as similar as ``alike``, else it becomes one. The order is cut into
    batches that grow; in a batch, all texts without an open earlier neighbour become leaders at once, which is right whatever the others become, and
    their neighbours join; texts after the batch are compared with its leaders only, so a family of similar texts is gone before its pairs are made.
    """
    total = ranked.count()
    shares, size = [], BATCH
    while size < total:
        shares.append(size / total)
        size += size * GROWTH
    cuts = ranked.agg(F.percentile_approx("rank", shares, 100_000)).first()[0] if shares else []
    rest, found, rounds = ranked, [], 0
    for cut in [*cuts, None]:
        batch = steps.write(rest if cut is None else rest.where(F.col("rank") <= cut))
        pairs = similar_pairs(batch.select("text"), alike=alike)
        rank_of = batch.select("text", "rank")
        pairs = pairs.join(rank_of.toDF("a", "ra"), "a").join(rank_of.toDF("b", "rb"), "b")
        first = F.col("ra") < F.col("rb")
        edges = all_edges = steps.write(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("later"), F.least("ra", "rb").alias("rank")))
        nodes, heads = batch, []
        while not nodes.isEmpty():
            rounds += 1
            head = steps.write(nodes.join(edges.select(F.col("later").alias("text")), "text", "left_anti"))
            heads.append(head)
            gone = edges.join(head.select(F.col("text").alias("first")), "first", "left_semi").select(F.col("later").alias("text")).distinct()
            nodes = steps.write(nodes.join(head.select("text"), "text", "left_anti").join(gone, "text", "left_anti"))
            edges = steps.write(edges.join(nodes.select(F.col("text").alias("first")), "first", "left_semi").join(nodes.select(F.col("text").alias("later")), "later", "left_semi"))
        new = _union(heads or [nodes])
        found.append(new.select("text", F.col("text").alias("leader"), "rank"))
        # A text may have left in an earlier round than its first leader was found in, so all pairs are looked at again.
        found.append(all_edges.join(new.select(F.col("text").alias("first")), "first", "left_semi").select(F.col("later").alias("text"), F.col("first").alias("leader"), "rank"))
        if cut is not None:
            rest = rest.where(F.col("rank") > cut)
            links = similar_pairs(rest.select("text"), new.select("text"), alike=alike).join(new.select(F.col("text").alias("b"), "rank"), "b")
            links = steps.write(links.select(F.col("a").alias("text"), F.col("b").alias("leader"), "rank"))
            found.append(links)
            rest = steps.write(rest.join(links.select("text").distinct(), "text", "left_anti"))
    return _union(found).groupBy("text").agg(F.min_by("leader", "rank").alias("leader")), rounds


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vocabulary(names: DataFrame, *, alike: float = 0.92) -> DataFrame:
    """(name, id): one identifier for each raw name. names: name, n (how often it was seen).

    In order of names, a name joins the first group whose first member has the same singular snake form or one as similar as ``alike`` under
    Jaro-Winkler. The form of the most frequent name of a group, of several the last in order, is the id of all of it.

    Defined cases: a null name has no row; a name with several rows counts their sum, a null n as 0; an empty table gives an empty one.
    """
    steps = Steps(names.sparkSession)
    counted = names.where("name is not null").groupBy("name").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    formed = steps.write(counted.withColumn("form", singular_form(snake(F.col("name")))))
    forms = formed.groupBy(F.col("form").alias("text")).agg(F.min("name").alias("first"))
    # Partitions are ranges in order, so ids that grow within and across partitions are ranks.
    ranked = steps.write(forms.repartitionByRange("first").sortWithinPartitions("first").select("text", F.monotonically_increasing_id().alias("rank")))
    groups, _ = leaders(ranked, alike=alike, steps=steps)
    placed = steps.write(formed.join(groups.withColumnRenamed("text", "form"), "form"))
    ids = placed.groupBy("leader").agg(F.max_by("form", F.struct("n", "name")).alias("id"))
    return placed.join(ids, "leader").select("name", "id")


def hierarchy(observed: DataFrame, *, share: float = 0.8) -> DataFrame:
    """(child, parent, shared, entities): classes most of whose entities are also of a larger class. observed: entity, class; a row for each mention.

    A class is as large as it has mentions. child has ``entities`` entities, of which ``shared`` (``share`` or more) are of parent too; of several the largest
    is the parent, then the first by name.

    To share so many of n entities, a class must hold one of any n - share * n + 1 of them. So each class looks for partners by its rarest entities only, as
    many as that, and only what is found is counted over all entities. Rarity is cut by counts of how many entities of a class are in how many
    classes, so the entities of a class are never ordered or held in one place.

    Defined cases: null entities and classes count for nothing; a class alone has no row; an empty table gives an empty one.
    """
    steps = Steps(observed.sparkSession)
    seen = observed.where("entity is not null and class is not null")
    members = steps.write(seen.groupBy("class", "entity").agg(F.count("*").alias("mentions")))
    sizes = steps.write(members.groupBy("class").agg(F.sum("mentions").alias("size"), F.count("*").alias("entities")))
    # Order of entities: in few classes first, then by a hash that makes fine steps of equal ones.
    common = members.groupBy("entity").agg(F.count("*").alias("classes"))
    placed = members.select("class", "entity").join(common, "entity").withColumn("place", F.col("classes") * 256 + F.pmod(F.xxhash64("entity"), F.lit(256)))
    placed = steps.write(placed)
    needed = F.col("entities") - F.ceil(F.col("entities") * F.lit(share) - F.lit(1e-9)) + 1
    upto = Window.partitionBy("class").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    steps_of = placed.groupBy("class", "place").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    last = steps_of.join(sizes, "class").where(F.col("before") < needed).groupBy("class").agg(F.max("place").alias("last"))
    probing = placed.where("classes > 1").join(last, "class").where("place <= last").select(F.col("class").alias("child"), "entity")
    met = probing.join(members.select(F.col("class").alias("parent"), "entity"), "entity").where("child != parent").select("child", "parent").distinct()
    small = sizes.select(F.col("class").alias("child"), F.col("size").alias("own"), "entities")
    large = sizes.select(F.col("class").alias("parent"), "size")
    candidates = steps.write(met.join(small, "child").join(large, "parent").where("own < size"))
    # Candidates are counted where the classes of an entity are together, so what is shuffled is the members once, and not each of them for each candidate of its class.
    pair = candidates.select("child", "parent")
    lists = placed.where((F.col("classes") > 1) & (F.col("classes") <= LISTED)).groupBy("entity").agg(F.collect_list("class").alias("held"))
    few = lists.select(F.explode("held").alias("child"), "held").join(pair, "child").where(F.array_contains("held", F.col("parent"))).groupBy("child", "parent").agg(F.count("*").alias("shared"))
    # Entities of more classes would make long lists: theirs are looked up one by one.
    wide = pair.join(placed.where(F.col("classes") > LISTED).select(F.col("class").alias("child"), "entity"), "child")
    many = wide.join(members.select(F.col("class").alias("parent"), "entity"), ["parent", "entity"], "left_semi").groupBy("child", "parent").agg(F.count("*").alias("shared"))
    both = few.unionByName(many).groupBy("child", "parent").agg(F.sum("shared").alias("shared"))
    fit = candidates.join(both, ["child", "parent"]).where(F.col("shared") >= F.col("entities") * F.lit(share) - F.lit(1e-9))
    best = fit.groupBy("child").agg(F.min_by(F.struct("parent", "shared", "entities"), F.struct(-F.col("size"), F.col("parent"))).alias("x"))
    return best.select("child", "x.parent", "x.shared", "x.entities")
