"""Labels of a table's rows from a decision model: questions, output columns, key choice, incremental runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import replace_table
from .profile import is_id_name

MOST_QUESTIONS, OPTIONS, KEY_LENGTH = 64, range(2, 27), 64


@dataclass(frozen=True)
class Question:
    """kind choice (options to choose from), score (levels to rate on), or probability (that the question is true)."""

    name: str
    kind: str
    options: tuple[str, ...] = ()


def check_questions(questions: list[Question]) -> None:
    if not 1 <= len(questions) <= MOST_QUESTIONS:
        raise ValueError(f"1 to {MOST_QUESTIONS} questions")
    if len({q.name.lower() for q in questions}) < len(questions):
        raise ValueError("two questions have one name")
    for q in questions:
        if q.kind not in ("choice", "score", "probability"):
            raise ValueError(f"{q.name}: no kind {q.kind}")
        if q.kind != "probability" and len(q.options) not in OPTIONS:
            raise ValueError(f"{q.name}: 2 to 26 options")


def output_columns(questions: list[Question], key: str) -> list[tuple[str, str]]:
    """(name, type) after the key: choice gives its option, probability and confidence; score its value and level; then whether the text was cut."""
    out: list[tuple[str, str]] = []
    for q in questions:
        out += {"choice": [(q.name, "string"), (f"{q.name}_p", "double"), (f"{q.name}_confidence", "double")], "score": [(q.name, "double"), (f"{q.name}_level", "int")], "probability": [(q.name, "double")]}[q.kind]
    out.append(("truncated", "boolean"))
    names = [key, *(n for n, _ in out)]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"output columns clash: {names}")
    return out


def pick_key(df: DataFrame, name: str | None = None) -> str:
    """The column that names rows: id or an id-like name, else an integer, else text of 64 characters on average or less. It must be there in
    every row, differ in all and be the same after a trip through text. The refusal names near misses."""
    kinds = dict(df.dtypes)
    fits = {c: t for c, t in kinds.items() if t in ("tinyint", "smallint", "int", "bigint", "string", "date") or t.startswith("decimal")}
    order = [name] if name else [*(c for c in fits if c.lower() == "id"), *(c for c in fits if is_id_name(c) and c.lower() != "id"), *(c for c, t in fits.items() if t.endswith("int") and not is_id_name(c)), *(c for c, t in fits.items() if t == "string" and not is_id_name(c))]
    if name and name not in fits:
        raise ValueError(f"{name} can't be a key")
    missed = []
    for c in order:
        x = F.col(f"`{c}`")
        n, have, differ, same, length = df.agg(F.count("*"), F.count(x), F.countDistinct(x), F.count(F.when(x.cast("string").try_cast(fits[c]) == x, 1)), F.avg(F.length(x.cast("string")))).first()
        if n and n == have == differ == same and (fits[c] != "string" or length <= KEY_LENGTH or is_id_name(c)):
            return c
        missed.append(f"{c} ({n - have} null, {have - differ} repeated)")
    raise ValueError(f"no column names the rows: {', '.join(missed) or 'none fits'}")


def label(df: DataFrame, key: str, text: list[str], questions: list[Question], model: Callable[[list[str]], list[dict]], *, most_characters: int = 20_000) -> DataFrame:
    """key, the output columns and truncated of every row. model: texts -> a dict of output columns each, called with a batch at a time on executors.
    Rows with a blank text aren't shown to the model; their labels are null."""
    check_questions(questions)
    columns = output_columns(questions, key)
    names = [n for n, _ in columns[:-1]]
    schema = f"`{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"`{n}` {t}" for n, t in columns)
    joined = F.concat_ws("\n", *(F.col(f"`{c}`").cast("string") for c in text))
    rows = df.select(key, F.substring(joined, 1, most_characters).alias("t"), (F.length(joined) > most_characters).alias("truncated"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            full = pdf["t"].str.strip() != ""
            got = iter(model(pdf.loc[full, "t"].tolist()) if full.any() else [])
            made = [next(got) if f else {} for f in full]
            out = pd.DataFrame({key: pdf[key], **{n: [m.get(n) for m in made] for n in names}, "truncated": pdf["truncated"]})
            yield out.astype({n: "Int32" for n, t in columns if t == "int"})

    return rows.mapInPandas(run, schema)


def pending(df: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """Rows that have no label yet."""
    return df.join(labels.select(key), key, "left_anti")


def incremental(df: DataFrame, key: str, text: list[str], questions: list[Question], model: Callable[[list[str]], list[dict]], labels: DataFrame) -> DataFrame:
    """The labels with those of the rows that had none; labels that are there stay."""
    return labels.unionByName(label(pending(df, key, labels), key, text, questions, model))


def relabel(df: DataFrame, key: str, text: list[str], questions: list[Question], model: Callable[[list[str]], list[dict]], path: str) -> None:
    """Label every row again into a table beside the one at path, and swap it in when it is whole. A run that fails leaves the old labels, and nothing of its own."""
    replace_table(label(df, key, text, questions, model), path)
