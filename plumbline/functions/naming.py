"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names like those given that none of the columns has, compared without case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
