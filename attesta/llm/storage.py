"""Where this subpackage writes tables, and how it names columns."""

from __future__ import annotations

from collections.abc import Iterable

from ..sources.shared import drop, new_path, shared_folder, written

__all__ = ["drop", "free_names", "new_path", "shared_folder", "written"]


def free_names(columns: Iterable[str], wanted: Iterable[str]) -> dict[str, str]:
    """A name for each of ``wanted``: its own, with as many underscores after
    it as make it differ from all ``columns``, case ignored."""
    taken, names = {c.lower() for c in columns}, {}
    for w in wanted:
        n = w
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        names[w] = n
    return names
