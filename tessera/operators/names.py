"""Names of columns that an operator adds for its own use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def fresh(taken: DataFrame | Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to clash with no column (letter case does not tell columns apart)."""
    used = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    found = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(name)
    return found
