"""SQL in the reference dialect on Spark.

Spark SQL rejects or, worse, misreads some spellings of the dialect. ``translate`` rewrites those that need only the text, on a
tree of tokens and brackets; ``run`` also handles those that need the columns or rows of tables: COLUMNS, aliases in WHERE,
ASOF and POSITIONAL joins, SUMMARIZE and dynamic PIVOT. The result is one Spark plan, so Catalyst sees all of it.

Rewritten: FROM first, ``* EXCLUDE``, ``* REPLACE`` (replaced columns go last), double-quoted names, ``//``, ``::``, ``count()``, list and struct literals,
1-based and negative indexes, string slices, list comprehensions, ``lambda x:``, dot-chained functions, QUALIFY, NULLS LAST as
the default order, and functions of another name.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import relational

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<tick>`[^`]*`)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d]\w*)|(?P<op>//|::|->>|->|\|\||<=>|<=|>=|<>|!=|==|\|>|[^\s\w])""",
    re.X | re.S,
)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_CLAUSES = {"WHERE", "GROUP", "HAVING", "QUALIFY", "WINDOW", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "USING"}


@dataclass
class Group:
    open: str
    items: list = field(default_factory=list)


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable SQL at {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup == "quoted":
            out.append("`" + m[0][1:-1].replace('""', '"').replace("`", "``") + "`")
        elif m.lastgroup != "space":
            out.append(m[0])
    return out


def tree(flat: list[str]) -> list:
    stack = [Group("")]
    for t in flat:
        if t in _CLOSE:
            stack.append(Group(t))
        elif t in _CLOSE.values():
            g = stack.pop()
            if not stack or _CLOSE.get(g.open) != t:
                raise ValueError(f"unbalanced {t!r}")
            stack[-1].items.append(g)
        else:
            stack[-1].items.append(t)
    if len(stack) != 1:
        raise ValueError(f"unbalanced {stack[-1].open!r}")
    return stack[0].items


def text_of(items: list) -> str:
    return " ".join(f"{x.open}{text_of(x.items)}{_CLOSE[x.open]}" if isinstance(x, Group) else x for x in items)


def _is(x, *words: str) -> bool:
    return isinstance(x, str) and x.upper() in words


def _name(x) -> bool:
    return isinstance(x, str) and bool(re.match(r"[^\W\d]\w*$|`", x))


def _split(items: list, *seps: str) -> list[list]:
    out: list[list] = [[]]
    for x in items:
        if _is(x, *seps):
            out.append([])
        else:
            out[-1].append(x)
    return out


def _call(name: str, *args: list) -> list:
    inside: list = []
    for i, a in enumerate(args):
        inside += [",", *a] if i else a
    return [name, Group("(", inside)]


_KEYWORDS = {"SELECT", "FROM", "WHERE", "AND", "OR", "NOT", "IN", "ON", "BY", "AS", "THEN", "WHEN", "ELSE", "CASE", "IS", "LIKE", "ILIKE", "BETWEEN", "HAVING", "QUALIFY", "LIMIT", "DISTINCT", "VALUES", "JOIN", "USING", "UNION", "ALL", "EXCEPT", "INTERSECT", "WITH", "RETURN", "FILTER", "OVER", "END", "ASC", "DESC", "INTERVAL"}

#: strftime letters and Spark's patterns for them.
_DATE_LETTERS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%%": "%"}

#: Functions that only have another name.
_RENAMED = {
    "list_transform": "transform", "array_transform": "transform", "apply": "transform", "list_filter": "filter", "array_filter": "filter", "list_contains": "array_contains", "list_has": "array_contains",
    "list_has_any": "arrays_overlap", "list_has_all": "loom_has_all", "list": "collect_list", "array_agg": "collect_list", "len": "size", "array_length": "size", "strlen": "octet_length", "regexp_matches": "regexp_like", "arg_max": "max_by",
    "argmax": "max_by", "arg_min": "min_by", "argmin": "min_by", "string_agg": "listagg", "group_concat": "listagg", "json_extract_string": "get_json_object", "json_extract": "get_json_object", "strpos": "instr", "position": "instr",
    "starts_with": "startswith", "ends_with": "endswith", "prefix": "startswith", "suffix": "endswith", "unnest": "explode", "list_distinct": "array_distinct", "list_sort": "array_sort", "list_concat": "concat", "list_sum": "loom_sum", "list_extract": "try_element_at",
    "list_reverse": "reverse", "list_position": "array_position", "string_split": "split", "str_split": "split", "quantile_cont": "percentile", "sha256": "loom_sha256", "today": "current_date", "epoch": "unix_timestamp", "gen_random_uuid": "uuid", "bool_and": "every",
    "bool_or": "some", "to_base64": "base64", "from_base64": "unbase64", "month": "month", "datediff": "loom_datediff", "array_to_string": "array_join", "regexp_extract_all": "regexp_extract_all", "row": "struct", "struct_pack": "struct", "printf": "format_string",
}


def _pattern(literal: str) -> str:
    """A strftime literal as a Spark pattern; other letters are quoted."""
    out, text = [], literal[1:-1].replace("''", "'")
    for m in re.finditer(r"%.|[A-Za-z]+|.", text, re.S):
        x = m[0]
        out.append(_DATE_LETTERS.get(x, "''" + x + "''" if x[0].isalpha() else x))
        if x[0] == "%" and x not in _DATE_LETTERS:
            raise ValueError(f"date format {x} isn't supported")
    return "'" + "".join(out) + "'"


def _function(name: str, args: list[list]) -> list | None:
    """What replaces a call, or None if it stays."""
    n = name.lower()
    if n in ("cast", "try_cast") and len(args) == 1:
        at = max((i for i, x in enumerate(args[0]) if _is(x, "AS")), default=None)
        return None if at is None else _call(name, [*args[0][: at + 1], *_type(args[0][at + 1 :])])
    if n == "count" and args == [[]]:
        return _call(name, ["*"])
    if n == "strftime" and len(args) == 2:
        value, fmt = (args[1], args[0]) if len(args[0]) == 1 and str(args[0][0]).startswith("'") else args
        return _call("date_format", value, [_pattern(fmt[0])])
    if n == "strptime":
        return _call("to_timestamp_ntz", args[0], [_pattern(args[1][0])])
    if n == "dayofweek":
        return [Group("(", [*_call("dayofweek", *args), "-", "1"])]
    if n == "range" and args and args != [[]]:
        low, high = ([["0"], args[0]] if len(args) == 1 else args[:2])
        return _call("filter", _call("sequence", _call("cast", [*low, "AS", "bigint"]), _call("greatest", low, [Group("(", high), "-", "1"])), ["x", "->", "x", "<", Group("(", high)])
    if n == "regexp_replace" and len(args) == 4:
        if args[3][0].lower() != "'g'":
            raise ValueError("only the option 'g' is supported")
        return _call(name, *args[:3])
    if n == "regexp_replace" and len(args) == 3:
        # Without the option g only the first match is replaced.
        first = _call("concat", ["'(?s)^(.*?)(?:'"], args[1], ["')'"])
        return _call(name, args[0], first, _call("concat", ["'$1'"], args[2]))
    if n in ("string_split", "str_split"):
        return _call("split", args[0], _call("concat", ["'\\\\Q'"], args[1], ["'\\\\E'"]))
    if n == "string_agg" and len(args) == 2:
        value, sep = args
        if any(_is(x, "ORDER") for x in sep):
            at = next(i for i, x in enumerate(sep) if _is(x, "ORDER"))
            return [*_call("listagg", value, sep[:at]), "WITHIN", "GROUP", Group("(", sep[at:])]
    if n in ("arg_max", "max_by", "argmax") and len(args) == 3:
        x, m, k = args
        return _call("transform", _call("slice", _call("sort_array", _call("collect_list", _call("struct", [*m, "AS", "m"], [*x, "AS", "x"])), ["false"]), ["1"], k), ["t", "->", "t", ".", "x"])
    if n == "sha256":
        return _call("sha2", *args, ["256"])
    if n == "len" or n == "array_length":
        return _call("size", args[0])
    if n == "list_has_all":
        return [Group("(", [*_call("size", _call("array_except", args[1], args[0])), "=", "0"])]
    if n == "list_sum":
        return _call("aggregate", args[0], _call("cast", ["0", "AS", "double"]), ["a", ",", "b"])[:0] + _call("aggregate", args[0], _call("cast", ["0", "AS", "double"]), [Group("(", ["a", ",", "b"]), "->", "a", "+", "b"])
    if n == "datediff" and len(args) == 3 and str(args[0][0]).startswith("'"):
        return _call("datediff", [args[0][0][1:-1].upper()], *args[1:])
    if n in _RENAMED and not _RENAMED[n].startswith("loom_"):
        return _call(_RENAMED[n], *args)
    return None


#: Types that Spark names otherwise.
_TYPES = {
    "VARCHAR": "STRING", "TEXT": "STRING", "BPCHAR": "STRING", "UUID": "STRING", "JSON": "STRING", "HUGEINT": "DECIMAL(38,0)", "UHUGEINT": "DECIMAL(38,0)", "UBIGINT": "DECIMAL(20,0)", "UINTEGER": "BIGINT", "USMALLINT": "INT", "UTINYINT": "SMALLINT", "INT8": "BIGINT", "INT4": "INT", "INT2": "SMALLINT",
    "INTEGER": "INT", "FLOAT8": "DOUBLE", "FLOAT4": "FLOAT", "REAL": "FLOAT", "BLOB": "BINARY", "BYTEA": "BINARY", "BOOL": "BOOLEAN", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP_LTZ", "NUMERIC": "DECIMAL",
}


def _type(items: list) -> list:
    """A type in Spark's spelling; T[] and T[n] are arrays."""
    if items and isinstance(items[-1], Group) and items[-1].open == "[":
        return ["ARRAY", "<", *_type(items[:-1]), ">"]
    if len(items) == 1 and isinstance(items[0], str):
        return [_TYPES.get(items[0].upper(), items[0])]
    return items


def _lambda(items: list) -> list:
    """``lambda x, y: body`` as ``(x, y) -> body``."""
    if items and _is(items[0], "LAMBDA") and ":" in items:
        at = items.index(":")
        names = [x for x in items[1:at] if x != ","]
        return [*(names if len(names) == 1 else [Group("(", items[1:at])]), "->", *items[at + 1 :]]
    return items


def _listed(items: list) -> list:
    """A list literal or comprehension."""
    at = next((i for i, x in enumerate(items) if _is(x, "FOR")), None)
    if at is None:
        return _call("array", *([] if not items else _split(items, ",")))
    inside = next(i for i, x in enumerate(items) if i > at and _is(x, "IN"))
    test = next((i for i, x in enumerate(items) if i > inside and _is(x, "IF")), len(items))
    var, source = items[at + 1], items[inside + 1 : test]
    if test < len(items):
        source = _call("filter", source, [var, "->", *items[test + 1 :]])
    return _call("transform", source, [var, "->", *items[:at]])


def _primary_start(out: list) -> int:
    """Where the operand that ends ``out`` begins."""
    i = len(out) - 1
    if isinstance(out[i], Group) and out[i].open == "(" and i and _name(out[i - 1]) and not _is(out[i - 1], *_KEYWORDS):
        i -= 1
    while i >= 2 and out[i - 1] == ".":
        i -= 2
        if isinstance(out[i], Group) and i and _name(out[i - 1]):
            i -= 1
    return i


def _expressions(items: list) -> list:
    """Rewrites inside one level, innermost first."""
    items = _lambda(items)
    out: list = []
    for x in items:
        follows = bool(out) and (isinstance(out[-1], Group) or (_name(out[-1]) and not _is(out[-1], *_KEYWORDS)) or (isinstance(out[-1], str) and out[-1].startswith("'")))
        if isinstance(x, Group):
            if x.open == "[" and len(out) >= 2 and (out[-2] == "::" or (_is(out[-2], "AS") and not x.items)):
                out.append(x)
                continue
            if x.open == "[":
                if not follows:
                    out += _expressions_in(_listed(x.items))
                    continue
                start = _primary_start(out)
                operand = out[start:]
                del out[start:]
                if ":" in x.items:
                    low, high = _split(x.items, ":")
                    low = _expressions(low) or ["1"]
                    args = [operand, low] + ([[Group("(", _expressions(high)), "-", Group("(", low), "+", "1"]] if high else [])
                    out += _call("substring", *args)
                else:
                    out += _call("try_element_at", operand, _expressions(x.items))
                continue
            if x.open == "{":
                args = []
                for pair in _split(x.items, ","):
                    key, value = pair[0], pair[2:]
                    args += [[key if key.startswith("'") else f"'{key.strip('`')}'"], _expressions(value)]
                out += _call("named_struct", *args)
                continue
            if x.items and (_is(x.items[0], "SELECT", "FROM", "WITH")):
                out.append(Group("(", _statement(x.items)))
                continue
            args = [_expressions(a) for a in _split(x.items, ",")] if x.items else [[]]
            if out and _name(out[-1]) and not _is(out[-1], *_KEYWORDS):
                name = out[-1]
                if len(out) >= 3 and out[-2] == "." and (name.lower() in _RENAMED or name.lower() in ("upper", "lower", "trim", "length", "substr", "replace", "round", "abs", "contains", "left", "right")):
                    del out[-2:]
                    start = _primary_start(out)
                    args = [out[start:], *([] if args == [[]] else args)]
                    del out[start:]
                    out += _function(name, args) or _call(name, *args)
                    continue
                new = _function(name, args)
                if new is not None:
                    out.pop()
                    out += new
                    continue
            inside: list = []
            for i, a in enumerate(args):
                inside += [",", *a] if i else a
            out.append(Group("(", _ordered(inside)))
        elif x == "//":
            out.append("div")
        elif x == "::":
            out.append(x)
        else:
            out.append(x)
    return _casts(out)


def _expressions_in(call: list) -> list:
    """The arguments of a call made here still hold the source's tokens."""
    return _expressions(call)


def _casts(items: list) -> list:
    """``x::type`` as a cast."""
    while "::" in items:
        at = items.index("::")
        start = _primary_start(items[:at])
        end = at + 2
        while end < len(items) and isinstance(items[end], Group) and items[end].open in "([":
            end += 1
        kind = _type(items[at + 1 : end])
        items = items[:start] + _call("CAST", [*items[start:at], "AS", *kind]) + items[end:]
    return items


def _ordered(items: list) -> list:
    """NULLS LAST where an ORDER BY says nothing."""
    out: list = []
    i = 0
    while i < len(items):
        out.append(items[i])
        if _is(items[i], "ORDER") and i + 1 < len(items) and _is(items[i + 1], "BY"):
            end = next((j for j in range(i + 2, len(items)) if _is(items[j], "LIMIT", "OFFSET", "ROWS", "RANGE", "GROUPS", "UNION", "INTERSECT", "EXCEPT")), len(items))
            out.append(items[i + 1])
            for n, item in enumerate(_split(items[i + 2 : end], ",")):
                out += [","] if n else []
                out += item
                if item and not any(_is(x, "NULLS") for x in item) and not (len(item) == 1 and _is(item[0], "ALL")):
                    out += ["NULLS", "LAST"]
            i = end
            continue
        i += 1
    return out


def _clause(items: list, *words: str, start: int = 0) -> int:
    return next((i for i in range(start, len(items)) if _is(items[i], *words)), len(items))


def _stars(items: list) -> list:
    """``* EXCLUDE`` and ``* REPLACE`` of a select list."""
    out: list = []
    i = 0
    while i < len(items):
        x = items[i]
        if _is(x, "EXCLUDE") and out and out[-1] == "*":
            what = items[i + 1]
            out += ["EXCEPT", what if isinstance(what, Group) else Group("(", [what])]
            i += 2
        elif _is(x, "REPLACE") and out and out[-1] == "*" and isinstance(items[i + 1], Group):
            new = _split(items[i + 1].items, ",")
            joined: list = []
            for n, item in enumerate(new):
                joined += [",", item[-1]] if n else [item[-1]]
            out += ["EXCEPT", Group("(", joined)]
            for item in new:
                out += [",", *item]
            i += 2
        else:
            out.append(x)
            i += 1
    return out


def _statement(items: list) -> list:
    """One query: clause-level rewrites, then expressions."""
    if items and _is(items[0], "WITH"):
        out = [items[0]]
        for x in items[1:]:
            if _is(x, "SELECT", "FROM"):
                break
            out.append(Group("(", _statement(x.items)) if isinstance(x, Group) and x.items and _is(x.items[0], "SELECT", "FROM", "WITH") else x)
        return out + _statement(items[len(out) :])
    for i, x in enumerate(items):
        if _is(x, "UNION", "INTERSECT", "EXCEPT") and i and items[i - 1] != "*" and not (i >= 1 and isinstance(items[i + 1], Group) and _is(items[i - 1], "*")):
            tail = 2 if _is(items[i + 1], "ALL", "DISTINCT") else 1
            return _statement(items[:i]) + items[i : i + tail] + _statement(items[i + tail :])
    if items and _is(items[0], "FROM"):
        at = _clause(items, "SELECT")
        if at < len(items):
            end = _clause(items, *_CLAUSES, start=at)
            items = items[at:end] + items[:at] + items[end:]
        else:
            items = ["SELECT", "*", *items]
    if items and _is(items[0], "SELECT"):
        at = _clause(items, "FROM")
        items = ["SELECT", *_stars(items[1:at]), *items[at:]]
        q = _clause(items, "QUALIFY")
        if q < len(items):
            at, end = _clause(items, "FROM"), _clause(items, "ORDER", "LIMIT", "OFFSET", start=q)
            inner = items[:at] + [",", Group("(", items[q + 1 : end]), "AS", "loom_qualify"] + items[at:q]
            items = ["SELECT", "*", "EXCEPT", Group("(", ["loom_qualify"]), "FROM", Group("(", inner), "WHERE", "loom_qualify", *items[end:]]
    return _ordered(_expressions(items))


def _command(items: list) -> list:
    """Writes with a query in them, and ALTER's SET DATA TYPE."""
    if items and _is(items[0], "CREATE", "INSERT"):
        at = _clause(items, "SELECT", "FROM", "WITH")
        return items[:at] + _statement(items[at:]) if at < len(items) else items
    if items and _is(items[0], "ALTER"):
        at = _clause(items, "SET")
        if at + 3 < len(items) and _is(items[at + 1], "DATA") and _is(items[at + 2], "TYPE"):
            return [*items[:at], "TYPE", *_type(items[at + 3 :])]
        return items
    return _statement(items)


def translate(text: str) -> str:
    """Spark SQL for a statement, as far as its text alone tells."""
    return text_of(_command(tree(tokens(text.strip().rstrip(";")))))


def _view(df: DataFrame) -> str:
    name = f"loom_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(name)
    return name


def _relation(spark: SparkSession, items: list) -> tuple[DataFrame, str]:
    """(rows, alias) of a table, subquery or alias of one."""
    items = [x for x in items if not _is(x, "AS")]
    alias = items[1] if len(items) > 1 else items[0]
    source = text_of(items[:1]) if isinstance(items[0], Group) else items[0]
    return run(spark, f"SELECT * FROM {source}"), alias.strip("`")


def _paired(spark: SparkSession, items: list) -> list:
    """ASOF and POSITIONAL joins of the FROM clause, as a view with one struct for each side."""
    at = _clause(items, "ASOF", "POSITIONAL")
    if at == len(items):
        return items
    begin = _clause(items, "FROM") + 1
    join = _clause(items, "JOIN", start=at)
    end = _clause(items, *(_CLAUSES - {"USING"}), start=join)
    left, a = _relation(spark, items[begin:at])
    on = _clause(items, "ON", start=join)
    right, b = _relation(spark, items[join + 1 : min(on, end)])
    if _is(items[at], "POSITIONAL"):
        both = relational.positional_join(left, right, a, b)
    else:
        keys, bound = [], None
        for part in _split(items[on + 1 : end], "AND"):
            op = next(x for x in part if x in ("=", "==", ">=", ">", "<=", "<"))
            x, y = part[: part.index(op)], part[part.index(op) + 1 :]
            if x[0].strip("`") == b:
                x, y, op = y, x, {">=": "<=", ">": "<", "<=": ">=", "<": ">"}.get(op, op)
            pair = x[-1].strip("`"), y[-1].strip("`")
            if op in ("=", "=="):
                keys.append(pair)
            else:
                bound = (*pair, op)
        if bound is None:
            raise ValueError("an ASOF join needs an inequality")
        both = relational.asof_join(left, right, a, b, keys, *bound, how="left" if any(_is(x, "LEFT") for x in items[at:join]) else "inner")
    return items[:begin] + [_view(both)] + items[end:]


def _expanded(spark: SparkSession, items: list) -> list:
    """COLUMNS(...) and aliases used in WHERE, which need the columns of the FROM clause."""
    if not items or not _is(items[0], "SELECT"):
        return items
    at = _clause(items, "FROM")
    flat = text_of(items[1:at]).upper()
    where = _clause(items, "WHERE")
    aliases = {i[-1].strip("`"): i[:-2] for i in _split(items[1:at], ",") if len(i) > 2 and _is(i[-2], "AS")}
    used = [x for x in items[where:] if _name(x) and x.strip("`") in aliases] if where < len(items) else []
    if "COLUMNS" not in flat and not used:
        return items
    columns = spark.sql(translate("SELECT * " + text_of(items[at : _clause(items, *_CLAUSES, start=at)]))).columns
    out: list = []
    for item in _split(items[1:at], ","):
        n = next((i for i, x in enumerate(_flat(item)) if _is(x, "COLUMNS")), None)
        if n is None:
            out.append(item)
            continue
        for c in columns:
            got, ok = _with_column(item, c)
            if ok:
                out.append(got if any(_is(x, "AS") for x in got) else [*got, "AS", f"`{c}`"])
    select: list = []
    for i, item in enumerate(out):
        select += [",", *item] if i else item
    end = _clause(items, "GROUP", "HAVING", "QUALIFY", "WINDOW", "ORDER", "LIMIT", start=where)

    def put(xs: list) -> list:
        made: list = []
        for i, x in enumerate(xs):
            if isinstance(x, Group):
                made.append(Group(x.open, put(x.items)))
            elif _name(x) and x.strip("`") in aliases and x.strip("`") not in columns and (i == 0 or xs[i - 1] != "."):
                made.append(Group("(", aliases[x.strip("`")]))
            else:
                made.append(x)
        return made

    return ["SELECT", *select, *items[at:where], *put(items[where:end]), *items[end:]]


def _flat(items: list) -> list:
    out: list = []
    for x in items:
        out += _flat(x.items) if isinstance(x, Group) else [x]
    return out


def _with_column(items: list, column: str) -> tuple[list, bool]:
    """items with COLUMNS(...) replaced by a column, and whether its pattern takes it."""
    out, ok, i = [], True, 0
    while i < len(items):
        x = items[i]
        if _is(x, "COLUMNS") and i + 1 < len(items) and isinstance(items[i + 1], Group):
            pattern = items[i + 1].items
            ok = ok and (pattern == ["*"] or bool(re.search(pattern[0][1:-1], column)))
            out.append(f"`{column}`")
            i += 2
            continue
        if isinstance(x, Group):
            inner, fine = _with_column(x.items, column)
            ok = ok and fine
            x = Group(x.open, inner)
        out.append(x)
        i += 1
    return out, ok


def run(spark: SparkSession, text: str) -> DataFrame:
    """Run a read in the reference dialect."""
    items = tree(tokens(text.strip().rstrip(";")))
    if _is(items[0], "SUMMARIZE"):
        return relational.summarize(_relation(spark, items[1:])[0] if not _is(items[1], "SELECT", "FROM") else run(spark, text_of(items[1:])))
    if _is(items[0], "PIVOT"):
        on, using = _clause(items, "ON"), _clause(items, "USING")
        group = _clause(items, "GROUP")
        rows, _ = _relation(spark, items[1:on])
        keys = [x.strip("`") for x in items[group + 2 :] if x != ","]
        from pyspark.sql import functions as F

        return rows.groupBy(*keys).pivot(text_of(items[on + 1 : using]).strip("`")).agg(F.expr(text_of(_expressions(items[using + 1 : group]))))
    items = _paired(spark, items)
    if items and _is(items[0], "SELECT"):
        items = _expanded(spark, items)
    return spark.sql(text_of(_statement(items)))


def resorted(spark: SparkSession, text: str, order: list[tuple[str, bool]]) -> DataFrame:
    """The statement with its own top-level ORDER BY replaced by ``order`` (name, descending), NULLS LAST, before its LIMIT."""
    items = tree(tokens(text.strip().rstrip(";")))
    limit = _clause(items, "LIMIT", "OFFSET")
    at = min(_clause(items, "ORDER"), limit)
    by: list = []
    for i, (name, down) in enumerate(order):
        by += ([","] if i else []) + [f"`{name}`", "DESC" if down else "ASC", "NULLS", "LAST"]
    return run(spark, text_of([*items[:at], "ORDER", "BY", *by, *items[limit:]]))
