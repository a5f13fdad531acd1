"""Naming rules of tables, columns, classes and relations."""

from __future__ import annotations

import re
from pathlib import PurePath

INTERNAL_PREFIX = "_loom_"
RESERVED_PREFIXES = (INTERNAL_PREFIX, "graph_")


def table_name(path: str) -> str:
    """A file's table: its stem, every character but letters, digits and ``_`` as ``_``; ``imported`` without a stem."""
    stem = PurePath(path).stem
    return "".join(c if c.isalnum() or c == "_" else "_" for c in stem) or "imported"


def sheet_names(stem: str, sheets: list[str]) -> list[str]:
    """Tables of a workbook: the stem for a single sheet, else stem_sheet. Two sheets with one name are refused."""
    base = table_name(stem)
    if len(sheets) == 1:
        return [base]
    names = [f"{base}_{table_name(s + '.x')}" for s in sheets]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"two sheets would be one table: {names}")
    return names


def check_reserved(name: str) -> None:
    if name.lower().startswith(RESERVED_PREFIXES):
        raise ValueError(f"table names can't begin with {' or '.join(RESERVED_PREFIXES)}: {name}")


def header_names(cells: list[str | None]) -> list[str]:
    """Column names: a blank one is columnN, one that is there already (in any case) gets _2, _3 ..."""
    out: list[str] = []
    seen: set[str] = set()
    for i, cell in enumerate(cells, 1):
        base = (cell or "").strip() or f"column{i}"
        name, k = base, 1
        while name.lower() in seen:
            k += 1
            name = f"{base}_{k}"
        seen.add(name.lower())
        out.append(name)
    return out


def snake_id(name: str) -> str:
    """Lower-case ASCII letters and digits, runs of anything else as one ``_``, none at the end; ``t_`` before a digit; ``unnamed`` if empty."""
    out = re.sub(r"[^a-z0-9]+", "_", name.lower()).rstrip("_")
    out = out.lstrip("_") if out.startswith("_") else out
    if not out:
        return "unnamed"
    return f"t_{out}" if out[0].isdigit() else out


def singular(name: str) -> str:
    """A plain English singular: ies -> y; names that end in ss or have fewer than 4 letters stay; else one s goes."""
    if name.endswith("ies"):
        return name[:-3] + "y"
    if name.endswith("ss") or len(name) < 4:
        return name
    return name.removesuffix("s")


def normalized_label(text: str) -> str:
    """White space collapsed, then lower case."""
    return " ".join(text.split()).lower()


def relation_name(column: str) -> str:
    """``policy_id`` names the relation has_policy."""
    base = snake_id(column)
    return f"has_{base.removesuffix('_id') if base != '_id' else base}"
