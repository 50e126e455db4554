"""Cheapest repair of a sequence of turns by depth-first branch and bound.

A turn is one letter: ``s u a x`` for the initial of its role (x: any other), upper case where it is
cut off, ``d`` where it must go. Edits, in ASCII order: D deletes, I inserts a user or assistant turn
before, K keeps, R gives the turn the role user or assistant. What is kept must read ``s?(ua)*``, so the
role of an inserted or re-roled turn follows from the state, and of equal costs the ASCII-least audit is due.

Sequences of any length are cut into pieces. A piece is solved for each pair of states before and
after it; pieces are then joined by the least (cost, audit) for each state. That is exact: audits of
equal cost that take the same turns never begin one with the other, as each further I costs 2.
"""

from __future__ import annotations

import math
from functools import lru_cache

#: States: nothing kept yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: The state after one more user or assistant turn.
AFTER = (USER, USER, ASSISTANT, USER)
PIECE = 192

Best = tuple[int, str]


def kept(state: int, turn: str) -> int | None:
    """The state after a turn kept as it is, or None where its role does not fit."""
    role = turn.lower()
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def edits(state: int, turn: str) -> list[tuple[str, int, int, int]]:
    """(letter, cost, turns taken, state after) of the edits possible before a turn, in ASCII order."""
    found = [("D", DELETE, 1, state), ("I", INSERT, 0, AFTER[state])]
    if turn and turn != "d":
        after = kept(state, turn)
        if after is not None:
            found.append(("K", CUT_OFF * turn.isupper(), 1, after))
        found.append(("R", REROLE + CUT_OFF * turn.isupper(), 1, AFTER[state]))
    return found if turn else found[1:]


def suffix_bounds(turns: str, ends: tuple[int, ...]) -> list[list[float]]:
    """Least cost from each turn and state to one of ``ends`` after the last turn."""
    once = [0.0 if s in ends else math.inf for s in STATES]
    for _ in range(2):
        once = [min(once[s], INSERT + once[AFTER[s]]) for s in STATES]
    bounds = [once]
    for turn in reversed(turns):
        later = bounds[-1]
        own = [min((c + later[s] for _, c, taken, s in edits(state, turn) if taken), default=math.inf) for state in STATES]
        # One insertion may come before; a second would undo the first.
        bounds.append([min(own[s], INSERT + own[AFTER[s]]) for s in STATES])
    return bounds[::-1]


def _dive(turns: str, state: int, ends: tuple[int, ...], bounds: list[list[float]]) -> Best:
    """A first incumbent: always the edit of the least cost and bound."""
    cost, audit, i = 0, [], 0
    while i < len(turns):
        letter, c, taken, state = min(edits(state, turns[i]), key=lambda e: (e[1] + bounds[i + e[2]][e[3]], -e[2]))
        cost, i = cost + c, i + taken
        audit.append(letter)
    while state not in ends:
        cost, state = cost + INSERT, AFTER[state]
        audit.append("I")
    return cost, "".join(audit)


def search(turns: str, begin: int = START, ends: tuple[int, ...] = ENDS) -> Best | None:
    """The least (cost, audit) that takes all turns from state ``begin`` to one of ``ends``.

    Depth first with an explicit stack, edits in ASCII order, so that of two ways to a node at equal
    cost the first one met has the lesser audit. A node (turn, state) keeps the least cost it was
    reached with; whatever comes no cheaper is dropped, as is what cannot beat the incumbent.
    """
    n, bounds = len(turns), suffix_bounds(turns, ends)
    if bounds[0][begin] == math.inf:
        return None
    incumbent = _dive(turns, begin, ends, bounds)
    limit, found = incumbent[0], False
    reached = [[math.inf] * 4 for _ in range(n + 1)]
    path: list[str] = []
    stack = [(0, begin, 0, 0, "")]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        if cost >= reached[i][state]:
            continue
        least = cost + bounds[i][state]
        if least > limit or (found and least == limit):
            continue
        reached[i][state] = cost
        del path[max(depth - 1, 0):]
        if letter:
            path.append(letter)
        if i == n and state in ends:
            audit = "".join(path)
            incumbent = min(incumbent, (cost, audit))
            limit, found = incumbent[0], True
        for letter, c, taken, after in reversed(edits(state, turns[i] if i < n else "")):
            stack.append((i + taken, after, cost + c, depth + 1, letter))
    return incumbent


@lru_cache(maxsize=50_000)
def _short(turns: str) -> Best:
    return search(turns)


@lru_cache(maxsize=2_000)
def _piece(turns: str) -> dict[tuple[int, int], Best]:
    found = {(b, e): search(turns, b, (e,)) for b in STATES for e in STATES}
    return {k: v for k, v in found.items() if v is not None}


def joined(left: dict[tuple[int, int], Best], right: dict[tuple[int, int], Best]) -> dict[tuple[int, int], Best]:
    """Two pieces in a row as one."""
    out: dict[tuple[int, int], Best] = {}
    for (b, m), (cost, audit) in left.items():
        for e in STATES:
            if (m, e) in right:
                more, rest = right[m, e]
                best = (cost + more, audit + rest)
                if (b, e) not in out or best < out[b, e]:
                    out[b, e] = best
    return out


def transfer(turns: str) -> dict[tuple[int, int], Best]:
    """The least (cost, audit) for each pair of states before and after the turns."""
    parts = [_piece(turns[i:i + PIECE]) for i in range(0, len(turns), PIECE)] or [_piece("")]
    while len(parts) > 1:
        parts = [joined(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def finish(table: dict[tuple[int, int], Best]) -> Best:
    return min(table[START, e] for e in ENDS if (START, e) in table)


def solve(turns: str) -> Best:
    """The cheapest repair of a whole sequence."""
    return _short(turns) if len(turns) <= PIECE else finish(transfer(turns))
