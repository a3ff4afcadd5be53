"""Names for columns that operators add for a while."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores after it as keep it apart from ``taken`` and from each other, whatever the case."""
    have, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
