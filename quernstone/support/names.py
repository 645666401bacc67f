"""Names for intermediate columns that no input column has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """Each name, with underscores behind it where a column is named so in any case."""
    held, out = {name.lower() for name in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
