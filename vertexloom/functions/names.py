"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores in front as set it apart from the taken ones (case does not tell names apart)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return tuple(out)
