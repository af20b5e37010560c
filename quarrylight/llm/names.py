"""Names for helper columns beside a caller's columns."""

from __future__ import annotations


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or a longer one where a column has it already (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
