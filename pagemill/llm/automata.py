"""Transitions of automata as one array, so that many texts can move side by side in numpy."""

from __future__ import annotations

import numpy as np

#: A cell of a table holds the state that owns it above this many bits, and the state it leads to below.
HALF = 32
LOW = np.int64((1 << HALF) - 1)


def packed(moves: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """place, table: the rows of a sparse transition table laid over each other.

    ``moves[s]`` leads from state s by symbols in [0, ``symbols``) to other states. A state
    is known by its place, which no two states share; its move by symbol c lies in
    ``table[place + c]``, if that cell names the place as its owner. Any state and symbol
    may be looked up: the table is long enough.
    """
    place = [0] * len(moves)
    taken: set[int] = set()
    used = bytearray(2 * symbols + 2 * sum(map(len, moves)) + 2 * len(moves) + 16)
    free = {True: symbols, False: symbols}  # where to look first for rows of several moves, and of one

    def in_use(cell: int) -> int:
        if cell + symbols >= len(used):
            used.extend(bytes(len(used)))
        return used[cell]

    for s in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        own = sorted(moves[s])
        if not own:
            continue
        several, first = len(own) > 1, own[0]
        cell = free[several]
        while in_use(cell):
            cell += 1
        free[several] = begun = cell
        while in_use(cell) or cell - first in taken or several and any(used[cell - first + c] for c in own):
            cell += 1
        if cell - begun > 64:  # the gaps before are too narrow for rows of this kind
            free[several] = cell - 64
        place[s] = cell - first
        taken.add(cell - first)
        for c in own:
            used[cell - first + c] = 1
    fresh = 0
    for s, own in enumerate(moves):
        if not own:
            while fresh in taken:
                fresh += 1
            place[s] = fresh
            taken.add(fresh)
    where = np.array(place, dtype=np.int64)
    table = np.full(max(place, default=0) + symbols + 1, -1, dtype=np.int64)
    for s, own in enumerate(moves):
        for c, to in own.items():
            table[place[s] + c] = place[s] << HALF | place[to]
    return where, table
