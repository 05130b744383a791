"""Names for helper columns that no column of the user's has."""

from __future__ import annotations


def free_name(wanted: str, *taken: str) -> str:
    """``wanted``, with underscores in front until no name in ``taken`` equals it.

    Names are compared as Spark does, without regard to case.
    """
    used = {n.lower() for n in taken}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted


def free_names(columns, *wanted: str) -> list[str]:
    """One free name for each wanted one; they differ from each other too."""
    found: list[str] = []
    for name in wanted:
        found.append(free_name(name, *columns, *found))
    return found
