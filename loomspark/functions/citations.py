"""Citation marks of an answer, brought into one form."""

from __future__ import annotations

import re

_GROUP = re.compile(r"【([^】]*)】|\[\^?(\d+(?:\s*,\s*\^?\d+)*)\]")
_CHANNEL = re.compile(r"<\|[^|>]*\|>")


def renumbered(text: str, chunk_of: dict[int, str]) -> tuple[str, list[str]]:
    """(text with marks [1], [2] ... by first use, the chunks they mean). chunk_of: chunk of each number the answer may use.

    【n】 and [^n] count as [n], and [2, 3] as two marks; a chunk has one number. An unknown number is dropped, but a group of several
    numbers of which none is known is text and stays. Channel tokens are dropped.
    """
    order: list[str] = []

    def mark(m: re.Match) -> str:
        numbers = [int(x) for x in re.findall(r"\d+", (m[1] or m[2] or "").split("†")[0])]
        known = [chunk_of[n] for n in numbers if n in chunk_of]
        if not known:
            return m[0] if len(numbers) != 1 else ""
        out = []
        for c in dict.fromkeys(known):
            if c not in order:
                order.append(c)
            out.append(f"[{order.index(c) + 1}]")
        return "".join(out)

    return _GROUP.sub(mark, _CHANNEL.sub("", text)), order
