"""Names that do not clash."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], name: str) -> str:
    """The name, with underscores in front until no column has it (names are compared as Spark does)."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name
