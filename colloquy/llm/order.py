"""Precedence constraints between the segments of a recording, their conflicts, and an order that meets what is left."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

#: The kinds of constraint from strong to weak, for a recording in which every segment has a time, and for another.
STRENGTH = {True: ("time", "place", "cue"), False: ("place", "cue", "time")}

Edge = tuple[str, int, int]


def _levels(values: Sequence[int | None]) -> list[list[int]]:
    """The segments that have a value, by ascending value; those of one value together."""
    known = sorted((v, i) for i, v in enumerate(values) if v is not None)
    out: list[list[int]] = []
    last = None
    for v, i in known:
        if v != last:
            out.append([])
            last = v
        out[-1].append(i)
    return out


def constraints(times: Sequence[int | None], cues: Sequence[int | None], places: Sequence[int]) -> Iterator[tuple[str, list[int], list[int]]]:
    """(kind, earlier segments, later segments) of neighbouring values: each of the first comes before each of the second."""
    for kind, values in (("time", times), ("cue", cues), ("place", places)):
        levels = _levels(values)
        yield from ((kind, a, b) for a, b in zip(levels, levels[1:]))


def precedence(times: Sequence[int | None], cues: Sequence[int | None], places: Sequence[int], timed: bool) -> tuple[list[int], list[Edge], list[Edge]]:
    """An order of the segments, the edges kept and the edges dropped.

    Each of timing, cue numbers and dialogue order wants the segments of one value before those of the next, which is an edge of
    its kind between neighbours; several segments on both sides are joined through a node between them, so there are as many
    edges as segments.  The strongest kind (STRENGTH) is kept whole.  An edge of a weaker kind is dropped if a stronger kind, asked from
    strong to weak, orders its ends the other way round.  What is left has no cycle, since every kept edge ascends in
    (strongest, next) values, and is ordered topologically; of segments that may come next the one of least place does.
    """
    n = len(places)
    strong, second, _ = STRENGTH[timed]
    value = {"time": times, "cue": cues, "place": places}

    def against(u: int, v: int, kind: str) -> bool:
        for other in (strong, second):
            if other == kind:
                return False
            a, b = value[other][u], value[other][v]
            if a is not None and b is not None and a != b:
                return a > b
        return False

    kept: list[Edge] = []
    dropped: list[Edge] = []
    nodes = n
    after: list[list[int]] = [[] for _ in range(n)]
    waits = [0] * n

    def link(u: int, v: int) -> None:
        after[u].append(v)
        waits[v] += 1

    for kind, first, then in constraints(times, cues, places):
        if len(first) * len(then) > 1 and kind == strong:  # a node between the two; nothing is against the strongest kind
            after.append([])
            waits.append(0)
            for u in first:
                link(u, nodes)
            for v in then:
                link(nodes, v)
            nodes += 1
            kept.append((kind, first[0], then[0]))
            continue
        for u, v in zip(first, then):
            edge = (kind, u, v)
            if against(*edge[1:], kind):
                dropped.append(edge)
            else:
                kept.append(edge)
                link(u, v)
    ready = [(places[i], i) for i in range(n) if not waits[i]]
    heapq.heapify(ready)
    order: list[int] = []
    while ready:
        _, u = heapq.heappop(ready)
        free = [u]
        if u < n:
            order.append(u)
        while free:
            for v in after[free.pop()]:
                waits[v] -= 1
                if not waits[v]:
                    if v < n:
                        heapq.heappush(ready, (places[v], v))
                    else:
                        free.append(v)
    return order, kept, dropped
