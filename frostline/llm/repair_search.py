"""Cheapest repair of a conversation by depth-first branch and bound.

A row is one letter: its role's initial ``s``, ``u``, ``a`` or ``x`` for any other, in upper
case if the text is truncated; ``B`` (blank) and ``D`` (duplicate) must be deleted. The edits
turn the rows into an optional system turn followed by pairs of user and assistant, or into
nothing. The state after some edits is one of ``START``, ``SYSTEM``, ``USER``, ``REPLY``; it
fixes the role of an inserted or changed turn, so an audit (the edits' initials) decides the
repaired rows.

Two prefixes that reach the same row and state have the same completions. Of those the one
with the smaller (cost, audit) is kept: were one audit the beginning of the other, the rest
would be insertions, which cost something, so with equal costs the order of the prefixes is
that of the whole audits.
"""

from __future__ import annotations

import functools
import math

START, SYSTEM, USER, REPLY = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3  # fixed values: costs
FORCED = "BD"
MISSING = (0, 2, 1, 0)  # turns to insert at the end, per state

# state -> state after a user or assistant turn, and after a kept system turn
_TURN = {START: USER, SYSTEM: USER, USER: REPLY, REPLY: USER}
_WANTED = {START: "u", SYSTEM: "u", USER: "a", REPLY: "u"}


def suffix_bounds(codes: str, goal: int | None) -> list[list[float]]:
    """``bounds[i][state]``: no completion from there, over the rows from i on, costs less.

    They come from the relaxation that forgets audits and adds up costs alone, row by row from
    the end; infinite where the goal is out of reach.
    """
    last = [INSERT * m for m in MISSING] if goal is None else [0 if s == goal else math.inf for s in range(4)]
    bounds = [last]
    for code in reversed(codes):
        later = bounds[-1]
        now = [min(cost + later[after] for cost, _, after, used in _steps(code, s) if used) for s in range(4)]
        for s in (USER, REPLY, USER, SYSTEM, START):  # insertions lead from state to state
            now[s] = min(now[s], INSERT + now[_TURN[s]])
        bounds.append(now)
    return bounds[::-1]


def _steps(code: str, state: int):
    """(cost, initial, next state, rows used) in the order of the initials."""
    yield DELETE, "D", state, 1
    yield INSERT, "I", _TURN[state], 0
    if code in FORCED:
        return
    role, cut = code.lower(), CUT_OFF * code.isupper()
    if role == "s" and state == START:
        yield KEEP + cut, "K", SYSTEM, 1
    elif role == _WANTED[state]:
        yield KEEP + cut, "K", _TURN[state], 1
    yield REROLE + cut, "R", _TURN[state], 1


def search(codes: str, entry: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the best repair from ``entry`` to ``goal``, or None if there is none.

    Without a goal the conversation ends here: turns may be inserted after the last row until
    nothing or a whole pair is left at the end. With one, the last edit uses the last row.
    """
    n = len(codes)
    bounds = suffix_bounds(codes, goal)
    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if table[i, state] != (cost, audit):  # a better prefix came here since
            continue
        if best is not None and not _open(cost + bounds[i][state], audit, best):
            continue
        if i == n and (state == goal if goal is not None else state in (START, REPLY)):
            if best is None or (cost, audit) < best:
                best = cost, audit
            continue
        children = []
        if i < n:
            steps = _steps(codes[i], state)
        else:
            steps = [(INSERT, "I", _TURN[state], 0)] if goal is None else []
        for more, initial, after, used in steps:
            node, label = (i + used, after), (cost + more, audit + initial)
            if node in table and table[node] <= label:
                continue
            least = label[0] + bounds[i + used][after]
            if least < math.inf and (best is None or _open(least, label[1], best)):
                table[node] = label
                children.append((least, initial, (*node, *label)))
        children.sort(reverse=True)  # the most promising on top
        stack += [c[2] for c in children]
    return best


def _open(least: float, audit: str, best: tuple[int, str]) -> bool:
    """May a prefix still lead to a better (cost, audit)?"""
    return least < best[0] or (least == best[0] and audit <= best[1][: len(audit)])


@functools.lru_cache(maxsize=1 << 14)
def whole(codes: str) -> tuple[int, str]:
    """The best repair of a whole conversation."""
    return search(codes)


def block_table(codes: str, first: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a block of a longer conversation."""
    found = []
    for entry in (START,) if first else range(4):
        for goal in range(4):
            if (best := search(codes, entry, goal)) is not None:
                found.append((entry, goal, *best))
    return found


def extend(states: dict[int, tuple[int, str]], table) -> dict[int, tuple[int, str]]:
    """Best (cost, audit) per state after one more block."""
    out: dict[int, tuple[int, str]] = {}
    for entry, goal, cost, audit in table:
        if entry in states:
            label = states[entry][0] + cost, states[entry][1] + audit
            if goal not in out or label < out[goal]:
                out[goal] = label
    return out


def close(states: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The best label once the turns missing at the end are inserted."""
    return min((cost + INSERT * MISSING[s], audit + "I" * MISSING[s]) for s, (cost, audit) in states.items())
