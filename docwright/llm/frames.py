"""Names of columns that the operators carry beside their results."""

from __future__ import annotations


def without(columns: list[str], results: list[str]) -> list[str]:
    """``columns`` but those named like a result, in any case of letters: the result takes their place."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]
