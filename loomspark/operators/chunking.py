"""Texts to chunks: token windows, code lines, table pieces, continuous pages, caption runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import tokens

SIZE, OVERLAP = 512, 64
#: A caption run ends at a gap of more than so many seconds, or when it holds so many bytes.
CAPTION_GAP, CAPTION_BYTES = 10.0, 600


def window_step(size: int, overlap: int) -> int:
    return max(1, size - min(overlap, size - 1))


def token_windows(listed: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of an array of tokens: one if it has ``size`` or fewer, else one at every step, the last cut at the end. A last window that
    lies wholly in the overlap of the one before is still there."""
    n, step = F.size(listed), window_step(size, overlap)
    starts = F.when(n <= size, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), n, F.lit(step)))
    return F.transform(starts, lambda i: F.slice(listed, i, F.lit(size)))


def chunks(docs: DataFrame, key: str, text: str, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index (from 0), content (tokens joined by blanks) and token_count of every window; texts without letters or digits give none."""
    rows = docs.select(key, F.posexplode(token_windows(tokens(F.col(text)), size, overlap)).alias("chunk_index", "w"))
    out = rows.select(key, "chunk_index", F.array_join("w", " ").alias("content"), F.size("w").alias("token_count"))
    return out.where(F.col("content").rlike(r"[\p{IsAlphabetic}\p{N}]"))


@dataclass
class Piece:
    content: str
    locator: str = ""
    heading: str = ""
    page: int | None = None


def code_pieces(text: str, count, size: int = SIZE) -> Iterator[Piece]:
    """Whole lines packed to ``size`` tokens, each piece with the number of its first line; a longer line is alone, blank pieces go."""
    held: list[str] = []
    used, first = 0, 1
    for number, line in enumerate(text.splitlines(keepends=True), 1):
        n = count(line)
        if held and used + n > size:
            if "".join(held).strip():
                yield Piece("".join(held), f"line {first}")
            held, used, first = [], 0, number
        held.append(line)
        used += n
    if "".join(held).strip():
        yield Piece("".join(held), f"line {first}")


def table_pieces(header: str, separator: str, rows: Iterable[str], count, size: int = SIZE) -> Iterator[Piece]:
    """A table split by rows, with its header and separator on each piece."""
    top = f"{header}\n{separator}\n"
    base, held, used = count(top), [], 0
    for row in rows:
        n = count(row)
        if held and base + used + n > size:
            yield Piece(top + "\n".join(held))
            held, used = [], 0
        held.append(row)
        used += n
    if held:
        yield Piece(top + "\n".join(held))


def page_pieces(pages: list[tuple[int, str]], split, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[Piece]:
    """Pages joined by a blank line and windowed across their borders; a piece has the page of its first token, and says
    through which page it runs."""
    listed = [(t, number) for number, text in pages for t in split(text)]
    if not listed:
        return
    step = window_step(size, overlap)
    starts = [0] if len(listed) <= size else range(0, len(listed), step)
    for s in starts:
        part = listed[s : s + size]
        first, last = part[0][1], part[-1][1]
        lines, now = [], None
        for t, number in part:
            lines.append(("\n\n" if now not in (None, number) else " " if lines else "") + t)
            now = number
        yield Piece("".join(lines), f"through page {last}" if last != first else "", page=first)


def clock(seconds: float) -> str:
    """m:ss, or h:mm:ss from an hour on."""
    s = int(seconds)
    return f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60}:{s % 60:02d}"


def caption_runs(cues: Iterable[tuple[float, float, str]]) -> Iterator[Piece]:
    """Cues (start, end, text) merged: a new run where a cue begins more than CAPTION_GAP seconds after the last one ended, or the run
    already holds CAPTION_BYTES bytes. Texts are joined by line ends; empty runs go."""
    held: list[str] = []
    begin = last = 0.0
    for start, end, text in cues:
        if held and (start - last > CAPTION_GAP or len("\n".join(held).encode()) >= CAPTION_BYTES):
            yield Piece("\n".join(held), clock(begin))
            held = []
        if text.strip():
            if not held:
                begin = start
            held.append(text)
        last = end
    if held:
        yield Piece("\n".join(held), clock(begin))


def merged_captions(cues: DataFrame, key: str) -> DataFrame:
    """key, locator, content of the runs of each file's cues (key, start, end, text). The byte limit is sequential, so a file's cues are one
    group; a file is the bound."""

    def runs(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        got = list(caption_runs(pdf[["start", "end", "text"]].itertuples(index=False, name=None)))
        return pd.DataFrame({key: [name[0]] * len(got), "locator": [p.locator for p in got], "content": [p.content for p in got]})

    kind = dict(cues.dtypes)[key]
    return cues.groupBy(key).applyInPandas(runs, f"{key} {kind}, locator string, content string")
