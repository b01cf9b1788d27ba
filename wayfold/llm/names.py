"""Names for columns that exist only inside an operator."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, with underscores before them until no column bears them (names do not differ by case)."""
    taken = {c.lower() for c in columns}
    lead = ""
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]
