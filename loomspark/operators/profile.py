"""Column profiles, what they warn of, key columns, strict retyping, and which tables a question is about."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_COLUMNS = 200
TOP = 50
LISTED_LENGTH = 60
_BOOL, _TIME, _NUMBER, _TEXT, _OTHER = "boolean", "temporal", "numeric", "text", "other"
RETYPE_TARGETS = {"VARCHAR": "string", "BIGINT": "bigint", "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}


def column_kind(spark_type: str) -> str:
    if spark_type == "boolean":
        return _BOOL
    if spark_type.startswith(("date", "timestamp")):
        return _TIME
    if spark_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or spark_type.startswith("decimal"):
        return _NUMBER
    return _TEXT if spark_type.startswith(("string", "varchar", "char")) else _OTHER


def as_number(x):
    """A text as a double if it reads as a number, else null. Java's suffixes (1d, 1f) and hexadecimal aren't numbers."""
    return F.when(F.trim(x).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(x).try_cast("double"))


def as_date(x):
    """A text as a date if it is a full ISO date, else null."""
    return F.when(F.trim(x).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.trim(x).try_cast("date"))


def profile(df: DataFrame) -> DataFrame:
    """One row for each of the first MOST_COLUMNS columns: column_name, kind, n_rows, non_null, distinct_values, number_share, date_share (of text,
    among non-null), min, max (of numbers and times, as text) and top, the TOP most frequent values of text with their counts.

    One aggregate without distinct for counts, shares and ranges; distinct values of other columns are counted in their own types, each column by
    a narrow aggregate that reads it alone; only texts are listed as (column, value) pairs, summed before the shuffle, for their top values. Nothing is
    gathered but TOP values a column.
    """
    columns = df.dtypes[:MOST_COLUMNS]
    x = {c: F.col(f"`{c}`") for c, _ in columns}
    aggs = [F.count("*").alias("n")]
    for i, (c, t) in enumerate(columns):
        kind = column_kind(t)
        aggs.append(F.count(x[c]).alias(f"c{i}"))
        if kind == _TEXT:
            aggs += [F.count(as_number(x[c])).alias(f"f{i}"), F.count(as_date(x[c])).alias(f"d{i}")]
        if kind in (_NUMBER, _TIME):
            aggs += [F.min(x[c]).cast("string").alias(f"lo{i}"), F.max(x[c]).cast("string").alias(f"hi{i}")]
    got = df.agg(*aggs).first()
    rows = []
    for i, (c, t) in enumerate(columns):
        kind, n = column_kind(t), got[f"c{i}"]
        share = lambda k, i=i, n=n, kind=kind: got[f"{k}{i}"] / n if kind == _TEXT and n else None
        ranged = kind in (_NUMBER, _TIME)
        rows.append((c, kind, got["n"], n, share("f"), share("d"), got[f"lo{i}"] if ranged else None, got[f"hi{i}"] if ranged else None))
    spark = df.sparkSession
    base = spark.createDataFrame(rows, "column_name string, kind string, n_rows long, non_null long, number_share double, date_share double, min string, max string")
    texts = [c for c, t in columns if column_kind(t) == _TEXT]
    listed = F.array(*(F.struct(F.lit(c).alias("column_name"), x[c].cast("string").alias("value")) for c in texts)) if texts else F.array().cast("array<struct<column_name:string,value:string>>")
    pairs = df.select(F.explode(listed).alias("p")).select("p.*").where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    distinct = pairs.groupBy("column_name").agg(F.count("*").alias("distinct_values"))
    for c, t in columns:
        if column_kind(t) != _TEXT:
            value = F.to_json(F.struct(x[c])) if t.startswith(("array", "struct", "map")) else x[c]
            distinct = distinct.unionByName(df.where(x[c].isNotNull()).agg(F.lit(c).alias("column_name"), F.countDistinct(value).alias("distinct_values")))
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))).where(F.col("r") <= TOP)
    top = ranked.groupBy("column_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "value", "n"))), lambda v: F.struct(v["value"].alias("value"), v["n"].alias("n"))).alias("top"))
    out = base.join(distinct, "column_name", "left").join(top, "column_name", "left")
    return out.select("column_name", "kind", "n_rows", "non_null", F.coalesce("distinct_values", F.lit(0)).cast("long").alias("distinct_values"), "number_share", "date_share", "min", "max", "top")


@dataclass(frozen=True)
class Warning_:
    column: str
    what: str
    fix: str | None = None


def listed_values(row) -> list[str]:
    """The values of a text column if its top list is all of them and each is short; else none."""
    top = row["top"] or []
    values = sorted(v["value"] for v in top)
    return values if len(top) == row["distinct_values"] and all(len(v) <= LISTED_LENGTH for v in values) else []


def value_form(value: str) -> str:
    """The form of a value: upper-case letters as A, lower-case as a, digits as 9, 24 characters at most."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isnumeric() else c for c in value)
    return out if len(out) <= 24 else out[:24] + "…"


def is_id_name(name: str) -> bool:
    """id, something_id, or somethingId."""
    return name.lower() == "id" or name.lower().endswith("_id") or (len(name) > 2 and name.endswith("Id") and name[-3].islower())


def key_column(rows) -> str | None:
    """A column whose values are all there and all different: id before names that end in id before the first."""
    keys = [r["column_name"] for r in rows if r["n_rows"] and r["non_null"] == r["distinct_values"] == r["n_rows"]]
    return next((k for k in keys if k.lower() == "id"), None) or next((k for k in keys if k.lower().endswith("id")), None) or next(iter(keys), None)


def warnings(rows) -> list[Warning_]:
    """What is odd about columns: no value, half or more null, numbers or dates kept as text (with a fix if all are), repeated ids."""
    out = []
    for r in rows:
        c, n, have = r["column_name"], r["n_rows"], r["non_null"]
        if n and not have:
            out.append(Warning_(c, "all null"))
            continue
        if n and (n - have) * 2 >= n:
            out.append(Warning_(c, "half or more null"))
        if r["number_share"] is not None and r["number_share"] >= 0.9:
            out.append(Warning_(c, "numbers as text", "DOUBLE" if r["number_share"] == 1 else None))
        elif r["date_share"] is not None and r["date_share"] >= 0.9:
            out.append(Warning_(c, "dates as text", "DATE" if r["date_share"] == 1 else None))
        if is_id_name(c) and have and r["distinct_values"] < have:
            out.append(Warning_(c, "repeated key"))
    return out


def text_candidates(rows) -> list[str]:
    """Text columns worth labelling: half present, two values or more, neither numbers nor dates, no key and not named as one."""
    key = key_column(rows)
    fits = lambda r: r["kind"] == _TEXT and r["non_null"] * 2 >= r["n_rows"] and r["distinct_values"] >= 2 and (r["number_share"] or 0) < 0.9 and (r["date_share"] or 0) < 0.9
    return [r["column_name"] for r in rows if fits(r) and r["column_name"] != key and not is_id_name(r["column_name"])]


def parse_retypes(text: str) -> list[tuple[str, str]]:
    """``col=TYPE,col=TYPE`` as pairs."""
    out = []
    for part in text.split(","):
        name, eq, kind = part.partition("=")
        if not eq or not name.strip() or kind.strip().upper() not in RETYPE_TARGETS:
            raise ValueError(f"not column=TYPE with one of {', '.join(RETYPE_TARGETS)}: {part.strip()!r}")
        out.append((name.strip(), kind.strip().upper()))
    return out


def retype(df: DataFrame, changes: list[tuple[str, str]]) -> DataFrame:
    """Columns cast strictly: one bad value fails the whole change when it is written."""
    names = {c.lower(): c for c in df.columns}
    for name, _ in changes:
        if name.lower() not in names:
            raise ValueError(f"no column {name}")
    to = {names[n.lower()]: RETYPE_TARGETS[k] for n, k in changes}
    strict = lambda c: F.when(F.col(c).isNotNull() & F.col(c).try_cast(to[c]).isNull(), F.raise_error(F.concat(F.lit(f"{c}: not {to[c]}: "), F.col(c).cast("string"))).cast(to[c])).otherwise(F.col(c).try_cast(to[c])).alias(c)
    return df.select(*(strict(c) if c in to else F.col(f"`{c}`") for c in df.columns))


def retype_tables(tables: dict[str, DataFrame], changes: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """The changes over several tables; each column must be in one of them at least."""
    for name, _ in changes:
        if not any(name.lower() in map(str.lower, df.columns) for df in tables.values()):
            raise ValueError(f"no table has a column {name}")
    return {t: retype(df, [(n, k) for n, k in changes if n.lower() in map(str.lower, df.columns)]) for t, df in tables.items()}


def stale(profiled: dict[str, int], counts: dict[str, int]) -> tuple[list[str], list[str]]:
    """(tables to profile again: new, or with another number of rows; tables to forget: gone)."""
    return sorted(t for t, n in counts.items() if profiled.get(t) != n), sorted(set(profiled) - set(counts))


def card(name: str, columns: list[str], note: str = "", values: list[str] = ()) -> str:
    """What a table's search text holds."""
    return " ".join([name, *columns, note, *values])


def rank_tables(question: str, cards: dict[str, str], *, k: int = 25, k1: float = 1.2, b: float = 0.75, similarity: dict[str, float] | None = None, rrf_k: int = 60) -> list[str]:
    """The tables a question is likely about, best first. Up to k tables aren't ranked. BM25 over the cards, a query word as often as it
    occurs, the mean length 1 at least; fused by reciprocal rank with the cosine similarities where those are given."""
    if len(cards) <= k:
        return sorted(cards)
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    docs = {n: words(t) for n, t in cards.items()}
    mean = max(1.0, sum(map(len, docs.values())) / len(docs))
    scores: dict[str, float] = {}
    for term in words(question):
        df = sum(term in d for d in docs.values())
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for n, d in docs.items():
            if tf := d.count(term):
                scores[n] = scores.get(n, 0.0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean))
    legs = [sorted(scores, key=lambda n: (-scores[n], n))]
    if similarity:
        legs.append(sorted(similarity, key=lambda n: (-similarity[n], n)))
    fused: dict[str, float] = {}
    for leg in legs:
        for r, n in enumerate(leg[:k]):
            fused[n] = fused.get(n, 0.0) + 1 / (rrf_k + r + 1)
    return sorted(fused, key=lambda n: (-fused[n], n))[:k]


def describe(df: DataFrame, note: str = "") -> dict:
    """Columns with types, three sample rows, the exact count and the note (2,000 characters at most)."""
    if len(note) > 2000:
        raise ValueError("a note has 2,000 characters at most")
    return {"columns": df.dtypes, "sample": [r.asDict() for r in df.limit(3).collect()], "rows": df.count(), "note": note}
