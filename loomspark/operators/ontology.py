"""Classes, relations and properties; induced from tables and from documents."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import relation_name, singular, snake_id
from .strings import jaro_winkler

ROOT = "entity"
MENTIONS = "mentions"
KINDS = ("string", "number", "date", "enum", "boolean")
OVERLAP, ENUM_ROWS, ENUM_VALUES, DATE_SHARE = 0.8, 20, range(2, 13), 0.9


@dataclass(frozen=True)
class Property:
    name: str
    kind: str = "string"
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Class:
    id: str
    parent: str = ROOT
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class Relation:
    id: str
    domain: str = ROOT
    range: str = ROOT


@dataclass(frozen=True)
class Mapping:
    """Rows of a table as nodes: the class, its key column, columns as properties, and columns whose value is the key of another class."""

    table: str
    cls: str
    key: str
    properties: tuple[tuple[str, str], ...] = ()  # (column, property)
    edges: tuple[tuple[str, str, str], ...] = ()  # (column, relation, target class)


@dataclass
class Ontology:
    classes: dict[str, Class] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    mappings: list[Mapping] = field(default_factory=list)
    measures: dict[str, tuple[str, str]] = field(default_factory=dict)  # name: (table, expression)

    def ancestors(self, cls: str) -> list[str]:
        """The class and what it is a kind of, up to the root."""
        out = [cls]
        while cls != ROOT:
            cls = self.classes[cls].parent if cls in self.classes else ROOT
            if cls in out:
                raise ValueError(f"{cls} is its own ancestor")
            out.append(cls)
        return out

    def descendants(self, cls: str) -> set[str]:
        return {c for c in [*self.classes, ROOT] if cls in self.ancestors(c)}

    def properties(self, cls: str) -> dict[str, Property]:
        """Own and inherited; the nearest wins."""
        out: dict[str, Property] = {}
        for c in reversed(self.ancestors(cls)):
            out |= {p.name: p for p in self.classes[c].properties} if c in self.classes else {}
        return out

    def edge_fits(self, relation: str, source: str, target: str) -> bool:
        if relation == MENTIONS:
            return True
        r = self.relations.get(relation)
        return r is not None and r.domain in self.ancestors(source) and r.range in self.ancestors(target)

    def closure(self) -> list[tuple[str, str]]:
        """(class, ancestor) pairs; as many as classes times their depth."""
        return [(c, a) for c in [*self.classes, ROOT] for a in self.ancestors(c)]

    def faults(self) -> list[str]:
        out = [f"class {c.id}: no parent {c.parent}" for c in self.classes.values() if c.parent not in self.classes and c.parent != ROOT]
        for c in self.classes:
            try:
                self.ancestors(c)
            except ValueError as e:
                out.append(str(e))
        out += [f"class {c.id}: property {p.name} has no kind {p.kind}" for c in self.classes.values() for p in c.properties if p.kind not in KINDS]
        out += [f"relation {r.id}: no class {x}" for r in self.relations.values() for x in (r.domain, r.range) if x not in self.classes and x != ROOT]
        out += [f"mapping of {m.table}: no class {m.cls}" for m in self.mappings if m.cls not in self.classes]
        return out + [f"mapping of {m.table}: no relation {r}" for m in self.mappings for _, r, _ in m.edges if r not in self.relations]

    def diff(self, other: Ontology) -> dict[str, list[str]]:
        """What other adds, drops and changes."""
        mine, theirs = ({f"{kind} {k}": v for kind in ("classes", "relations", "measures") for k, v in getattr(o, kind).items()} for o in (self, other))
        return {"added": sorted(theirs.keys() - mine.keys()), "dropped": sorted(mine.keys() - theirs.keys()), "changed": sorted(k for k in mine.keys() & theirs.keys() if mine[k] != theirs[k])}

    def renamed(self, old: str, new: str) -> Ontology:
        """A class or relation under another name, everywhere it is used."""
        n = lambda x: new if x == old else x
        return Ontology(
            {n(k): replace(c, id=n(c.id), parent=n(c.parent)) for k, c in self.classes.items()}, {n(k): replace(r, id=n(r.id), domain=n(r.domain), range=n(r.range)) for k, r in self.relations.items()},
            [replace(m, cls=n(m.cls), edges=tuple((c, n(r), n(t)) for c, r, t in m.edges)) for m in self.mappings], dict(self.measures),
        )

    def implied_joins(self) -> list[str]:
        """Join predicates that the mappings imply."""
        keys = {m.cls: (m.table, m.key) for m in self.mappings}
        return [f"{m.table}.{c} = {keys[t][0]}.{keys[t][1]}" for m in self.mappings for c, _, t in m.edges if t in keys]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Ontology:
        d = json.loads(text)
        tuples = lambda x: tuple(tuple(y) for y in x)
        return cls(
            {k: Class(c["id"], c["parent"], tuple(Property(p["name"], p["kind"], tuple(p["values"])) for p in c["properties"])) for k, c in d["classes"].items()}, {k: Relation(**r) for k, r in d["relations"].items()},
            [Mapping(m["table"], m["cls"], m["key"], tuples(m["properties"]), tuples(m["edges"])) for m in d["mappings"]], {k: tuple(v) for k, v in d["measures"].items()},
        )


class Versions:
    """Numbered snapshots; saving, renaming and restoring each make a new one."""

    def __init__(self) -> None:
        self.saved: list[str] = []

    def save(self, o: Ontology) -> int:
        if faults := o.faults():
            raise ValueError("; ".join(faults))
        self.saved.append(o.to_json())
        return len(self.saved)

    def load(self, number: int) -> Ontology:
        return Ontology.from_json(self.saved[number - 1])

    def restore(self, number: int) -> int:
        return self.save(self.load(number))


# Tables


@dataclass(frozen=True)
class Candidate:
    kind: str  # class, property or relation
    name: str
    owner: str = ""  # of a property its class, of a relation its domain
    detail: str = ""  # of a property its kind, of a relation its range
    confidence: float = 1.0
    table: str = ""
    column: str = ""


def property_kind(row) -> str:
    """The kind of a profiled column: few values in 20 rows or more make an enum, text with dates in nine tenths a date."""
    if row["kind"] in ("boolean",):
        return "boolean"
    if row["kind"] in ("temporal",):
        return "date"
    if row["kind"] == "numeric":
        return "number"
    if (row["date_share"] or 0) >= DATE_SHARE:
        return "date"
    return "enum" if row["n_rows"] >= ENUM_ROWS and row["distinct_values"] in ENUM_VALUES else "string"


def induce_classes(profiles: dict[str, list], keys: dict[str, str | None]) -> list[Candidate]:
    """A class for each table, and its columns as properties."""
    out = []
    for table, rows in profiles.items():
        cls = singular(snake_id(table))
        out.append(Candidate("class", cls, table=table))
        for r in rows:
            kind = property_kind(r)
            sure = 1.0 if r["column_name"] == keys.get(table) else 0.8 if kind == "enum" else 0.9
            out.append(Candidate("property", snake_id(r["column_name"]), cls, kind, sure, table, r["column_name"]))
    return out


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _as_whole(value: Column, kind: str) -> Column:
    """A value as the integer whose text it is; null if it is no such text."""
    if kind in _WHOLE:
        return value.cast("bigint")
    return F.when(value.rlike(r"^(0|-?[1-9]\d{0,18})$"), value.try_cast("bigint"))


def _ranges(df: DataFrame, columns: Iterable[str]) -> dict[str, tuple[int, int] | None]:
    """The least and greatest integer in columns, as text or not, in one pass; None without any."""
    kinds, columns = dict(df.dtypes), list(columns)
    if not columns:
        return {}
    whole = {c: _as_whole(F.col(f"`{c}`"), kinds[c]) for c in columns}
    got = df.agg(*(f(whole[c]) for c in columns for f in (F.min, F.max))).first()
    return {c: (got[2 * i], got[2 * i + 1]) if got[2 * i] is not None else None for i, c in enumerate(columns)}


def key_overlaps(tables: dict[str, DataFrame], keys: dict[str, str | None], mapped: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """(table_name, column_name, key_table, overlap): columns of which at least OVERLAP of the distinct values, as text, are keys of another table.

    Whole-number keys can be met by whole numbers and texts of them only, and by columns only whose range meets the key's: what can't is left out
    by its type and one pass of ranges, before any value is shuffled. The rest meets the keys by value, numbers as numbers, in one job: distinct
    (column, value) pairs against the keys. Keys that are texts take all columns, as text.
    """
    known, spark = set(mapped), next(iter(tables.values())).sparkSession
    plain = {n: {c: t for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))} for n, df in tables.items()}
    is_whole = {n: plain[n].get(keys[n]) in _WHOLE for n in tables if keys.get(n)}
    others = {n: [c for c in plain[n] if c != keys.get(n) and (n, c) not in known] for n in tables}
    asked = {n: {c for c in others[n] if plain[n][c] in (*_WHOLE, "string")} if any(is_whole.values()) else set() for n in tables}
    ranges = {n: _ranges(df, asked[n] | ({keys[n]} if is_whole.get(n) else set())) for n, df in tables.items()}
    key_ranges = {n: ranges[n][keys[n]] for n, w in is_whole.items() if w}
    out = spark.createDataFrame([], "table_name string, column_name string, key_table string, overlap double")
    for whole in (True, False):
        to = [n for n, w in is_whole.items() if w == whole]
        meets = lambda n, c: any(k != n and (not whole or (r := ranges[n].get(c)) and (z := key_ranges[k]) and r[0] <= z[1] and z[0] <= r[1]) for k in to)  # noqa: B023, E731
        values = []
        for n, df in tables.items():
            if met := [c for c in (sorted(asked[n]) if whole else others[n]) if meets(n, c)]:
                value = lambda n, c: _as_whole(F.col(f"`{c}`"), plain[n][c]) if whole else F.col(f"`{c}`").cast("string")  # noqa: B023, E731
                # Texts that are no numbers only count as values without a key.
                rest = lambda n, c: F.col(f"`{c}`") if plain[n][c] == "string" else F.lit(None).cast("string")  # noqa: B023, E731
                listed = F.array(*(F.struct(F.lit(n).alias("table_name"), F.lit(c).alias("column_name"), value(n, c).alias("value"), F.when(value(n, c).isNull() & F.col(f"`{c}`").isNotNull(), rest(n, c)).alias("rest")) for c in met))
                values.append(df.select(F.explode(listed).alias("p")).select("p.*"))
        if not values:
            continue
        every = reduce(DataFrame.unionByName, values).where("value is not null or rest is not null").distinct()
        hit_by = reduce(DataFrame.unionByName, (tables[n].select(F.lit(n).alias("key_table"), F.col(f"`{keys[n]}`").cast("bigint" if whole else "string").alias("value")) for n in to))
        totals = every.groupBy("table_name", "column_name").agg(F.count("*").alias("n"))
        hits = every.join(hit_by, "value").where("table_name != key_table").groupBy("table_name", "column_name", "key_table").agg(F.count("*").alias("hit"))
        share = hits.join(totals, ["table_name", "column_name"]).withColumn("overlap", F.col("hit") / F.col("n"))
        out = out.unionByName(share.where(F.col("overlap") >= OVERLAP).select("table_name", "column_name", "key_table", "overlap"))
    return out


def induce_relations(overlaps: Iterable, *, name_alike: float = 0.0) -> list[Candidate]:
    """A relation for each overlap: has_x, or domain_has_x where another domain or range has that name. name_alike > 0 asks for that similarity of
    the column's and the key table's names as well; by default the values alone decide."""
    out: list[Candidate] = []
    taken: dict[str, tuple[str, str]] = {}
    for r in sorted(overlaps, key=lambda r: (r["table_name"], r["column_name"], r["key_table"])):
        domain, range_ = singular(snake_id(r["table_name"])), singular(snake_id(r["key_table"]))
        if name_alike and jaro_winkler(snake_id(r["column_name"]), range_) < name_alike:
            continue
        name = relation_name(r["column_name"])
        if taken.setdefault(name, (domain, range_)) != (domain, range_):
            name = f"{domain}_{name}"
            taken[name] = (domain, range_)
        out.append(Candidate("relation", name, domain, range_, r["overlap"], r["table_name"], r["column_name"]))
    return out


def apply_candidates(o: Ontology, accepted: Iterable[Candidate], keys: dict[str, str | None], renames: dict[str, str] | None = None) -> Ontology:
    """The ontology with candidates in dependency order, names followed through renames and merges; properties and relations
    of classes that aren't there are dropped. A table without a key column gets a class but no mapping."""
    to = lambda n: (renames or {}).get(n, n)
    accepted = list(accepted)
    classes, relations = dict(o.classes), dict(o.relations)
    mapped = {m.table: m for m in o.mappings}
    for c in (c for c in accepted if c.kind == "class"):
        classes.setdefault(to(c.name), Class(to(c.name)))
        if keys.get(c.table):
            mapped.setdefault(c.table, Mapping(c.table, to(c.name), keys[c.table]))
    for c in (c for c in accepted if c.kind == "property" and to(c.owner) in classes):
        k = classes[to(c.owner)]
        if to(c.name) not in {p.name for p in k.properties}:
            classes[k.id] = replace(k, properties=(*k.properties, Property(to(c.name), c.detail)))
        if c.table in mapped and c.column not in {x for x, _ in mapped[c.table].properties}:
            mapped[c.table] = replace(mapped[c.table], properties=(*mapped[c.table].properties, (c.column, to(c.name))))
    for c in (c for c in accepted if c.kind == "relation" and to(c.owner) in classes and to(c.detail) in classes):
        relations.setdefault(to(c.name), Relation(to(c.name), to(c.owner), to(c.detail)))
        if c.table in mapped:
            mapped[c.table] = replace(mapped[c.table], edges=(*mapped[c.table].edges, (c.column, to(c.name), to(c.detail))))
    return Ontology(classes, relations, list(mapped.values()), dict(o.measures))


# Documents


def support(occurrences: int, documents: int, enough: int = 3) -> tuple[float, bool]:
    """(confidence, whether it is low) of a name seen so often in so many documents."""
    return 0.5 * min(occurrences, 10) / 10 + 0.5 * min(documents, enough) / enough, documents < enough


def endpoint(o: Ontology, classes: Counter, share: float = 0.8) -> str:
    """The class of a relation's end: one that has ``share`` of the cases, else the nearest common ancestor, else the root."""
    total = sum(classes.values())
    if not total:
        return ROOT
    top, n = min(classes.items(), key=lambda x: (-x[1], x[0]))
    if n / total >= share:
        return top
    lines = [o.ancestors(c) for c in classes]
    return next((a for a in lines[0] if all(a in line for line in lines)), ROOT)


def attribute_kind(values: list[str]) -> str | None:
    """boolean, number (signs of money and per cent aside), date or string of two values or more; None under two."""
    if len(values) < 2:
        return None
    fits = lambda pattern, clean=lambda v: v: all(re.fullmatch(pattern, clean(v.strip()), re.I) for v in values)
    if fits(r"true|false|yes|no"):
        return "boolean"
    if fits(r"[+-]?(\d+\.?\d*|\.\d+)", lambda v: re.sub(r"[,$%\s]", "", v)):
        return "number"
    if fits(r"\d{4}-\d{1,2}-\d{1,2}([ T].*)?|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}|[A-Za-z]{3,9}\.? \d{1,2},? \d{4}|\d{1,2}\.? [A-Za-z]{3,9}\.? \d{4}"):
        return "date"
    return "string"


def drift(extracted: DataFrame, o: Ontology) -> DataFrame:
    """(what, name, n) of classes and relations in extracted (kind, name) that the ontology doesn't have."""
    known = [("class", c) for c in [*o.classes, ROOT]] + [("relation", r) for r in [*o.relations, MENTIONS]]
    there = extracted.sparkSession.createDataFrame(known, "kind string, name string")
    return extracted.join(F.broadcast(there), ["kind", "name"], "left_anti").groupBy(F.col("kind").alias("what"), "name").agg(F.count("*").alias("n"))


@dataclass
class Validated:
    """nodes: passage_id, class_id, label, normalized_label, properties; edges: passage_id, relation_id, source, target (normalised labels), properties; drift: what, name, n;
    invalid: passage_id, n of edges without listed ends or that don't fit them."""

    nodes: DataFrame
    edges: DataFrame
    drift: DataFrame
    invalid: DataFrame


def validate_extraction(nodes: DataFrame, edges: DataFrame, o: Ontology) -> Validated:
    """What extracted passages hold that the ontology has a place for.

    nodes: passage_id, place (in the passage), class_id, label, properties; edges: passage_id, relation_id, source, target, properties. Classes and relations are taken in
    lower case without blanks at the ends. Of nodes of one passage with one normalised label the first counts; blank labels don't. Unknown classes and relations are drift, and so never
    reach the rest; an edge must join two kept nodes of its passage whose classes fit the relation. Passages are joined by id and label, the
    ontology's kinds of edges are a small table, so a passage or label with very many edges is no group of its own.
    """
    spark, plain = nodes.sparkSession, lambda c: F.lower(F.trim(c))
    named = nodes.where(F.col("label").isNotNull() & (F.trim("label") != "")).withColumn("class_id", plain("class_id"))
    known = F.col("class_id").isin(ROOT, *o.classes)
    normal = F.lower(F.trim(F.regexp_replace(F.col("label"), r"(?U)\s+", " ")))
    kept = named.where(known).withColumn("normalized_label", normal).groupBy("passage_id", "normalized_label").agg(F.min_by(F.struct("class_id", F.trim("label").alias("label"), "properties"), "place").alias("x"))
    kept = kept.select("passage_id", "x.class_id", "x.label", "normalized_label", "x.properties")
    related = edges.withColumn("relation_id", plain("relation_id"))
    fits = F.col("relation_id").isin(MENTIONS, *o.relations)
    ends = lambda side: kept.select("passage_id", F.col("normalized_label").alias(side), F.col("class_id").alias(f"{side}_class"))
    joined = related.where(fits)
    for side in ("source", "target"):
        joined = joined.withColumn(side, F.lower(F.trim(F.regexp_replace(F.col(side), r"(?U)\s+", " ")))).join(ends(side), ["passage_id", side], "left")
    # Kinds of edges that passages speak of: as many as the ontology has relations and pairs of classes at most.
    met = joined.where("source_class is not null and target_class is not null").select("relation_id", "source_class", "target_class").distinct().collect()
    allowed = spark.createDataFrame([tuple(k) for k in met if o.edge_fits(*k)], "relation_id string, source_class string, target_class string")
    judged = joined.join(F.broadcast(allowed.withColumn("ok", F.lit(True))), ["relation_id", "source_class", "target_class"], "left")
    good = judged.where("ok").select("passage_id", "relation_id", "source", "target", "properties")
    invalid = judged.where("ok is null").groupBy("passage_id").agg(F.count("*").alias("n"))
    missed = named.where(~known).select(F.lit("class").alias("what"), F.col("class_id").alias("name")).unionByName(related.where(~fits).select(F.lit("relation").alias("what"), F.col("relation_id").alias("name")))
    return Validated(kept, good, missed.groupBy("what", "name").agg(F.count("*").alias("n")), invalid)


def counted_by(pairs: Iterable[tuple[str, str]]) -> dict[str, Counter]:
    out: dict[str, Counter] = defaultdict(Counter)
    for a, b in pairs:
        out[a][b] += 1
    return out
