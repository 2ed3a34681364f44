"""One-to-one matching of sparse candidate tables (GR4) and how clear each pair is (GR5).

Gains sit in adjacency lists, never in a matrix. Each left node in turn is matched along a cheapest augmenting path
(Dijkstra over costs made non-negative by dual potentials); staying alone is an option of gain zero. What a
chosen pair is worth, against the best matching without it, is one more cheapest path in the residual graph.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

#: A node of the residual graph that stands for being unmatched.
_ALONE = ("alone", 0)


class Matching:
    """A matching of largest total gain between left nodes 0..n-1 and right nodes; ``pairs`` lists (left, right)."""

    def __init__(self, gains: Sequence[dict[int, float]]):
        self.gains = gains
        self.partner: dict[int, int] = {}  # of a right node
        self.mate: list[int | None] = [None] * len(gains)  # of a left node
        self.u, self.v = [0.0] * len(gains), {b: 0.0 for row in gains for b in row}
        for left in range(len(gains)):
            self._augment(left)

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return [(a, b) for a, b in enumerate(self.mate) if b is not None]

    def _augment(self, start: int) -> None:
        gains, u, v = self.gains, self.u, self.v
        u[start] = min(0.0, min((-g - v[b] for b, g in gains[start].items()), default=0.0))
        reached, settled = {start: 0.0}, {}  # left and right nodes
        distance: dict[int, float] = {}
        come_from: dict[int, int] = {}
        heap: list[tuple[float, int]] = []
        left, at = start, 0.0
        best, last, ends_right = -u[start], start, None  # the start stays alone
        while True:
            for b, g in gains[left].items():
                if b not in settled:
                    d = at - g - u[left] - v[b]
                    if d < distance.get(b, best):
                        distance[b], come_from[b] = d, left
                        heapq.heappush(heap, (d, b))
            while heap and (heap[0][1] in settled or heap[0][0] > distance[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            at, b = heapq.heappop(heap)
            settled[b] = at
            if b not in self.partner:
                best, last, ends_right = at, come_from[b], b
                break
            left = self.partner[b]
            reached[left] = at
            if at - u[left] < best:  # this one could stay alone
                best, last, ends_right = at - u[left], left, None
        for a, d in reached.items():
            if d < best:
                u[a] += best - d
        for b, d in settled.items():
            if d < best:
                v[b] -= best - d
        left, right = last, ends_right
        while True:
            before = self.mate[left]
            self.mate[left] = right
            if right is not None:
                self.partner[right] = left
            if left == start:
                if right is None and before is not None:
                    del self.partner[before]
                break
            right, left = before, come_from[before]

    def loss_without(self, left: int, most: float) -> tuple[float, int] | None:
        """(loss of gain, change of the number of pairs) of the best matching without the pair of ``left``; None if it loses more than ``most``."""
        target = self.mate[left]
        u, v = self.u, self.v
        heap: list[tuple[float, int, tuple]] = [(0.0, -1, ("left", left))]
        done: set[tuple] = set()
        while heap:
            at, change, node = heapq.heappop(heap)
            if at > most:
                return None
            if node in done:
                continue
            done.add(node)
            kind, k = node
            if node == ("right", target):
                return at, change
            if kind == "left":
                for b, g in self.gains[k].items():
                    if b != self.mate[k] and ("right", b) not in done:
                        heapq.heappush(heap, (max(0.0, at - g - u[k] - v[b]), change + 1, ("right", b)))
                if self.mate[k] is not None:
                    heapq.heappush(heap, (at - u[k], change, _ALONE))
            elif kind == "right":
                if k in self.partner:
                    heapq.heappush(heap, (at, change - 1, ("left", self.partner[k])))
                else:
                    heapq.heappush(heap, (at, change, _ALONE))
            else:  # a right node is given up, or a left one that was alone joins in
                for b in self.partner:
                    if at - v[b] <= most:
                        heapq.heappush(heap, (at - v[b], change, ("right", b)))
                for a, mate in enumerate(self.mate):
                    if mate is None:
                        heapq.heappush(heap, (at, change, ("left", a)))
        return None


def assign(edges: Sequence[tuple], least: float, margin: float) -> list[tuple]:
    """(left, right, score, chosen, ambiguous) of the pairs that matter, from (left, right, score) rows of one connected group.

    Chosen pairs maximise the sum of score - least over pairs of at least ``least``. A pair is ambiguous if the best rival of its right node, or any of its
    left node, is less than ``margin`` apart (the latter makes the rival's right node ambiguous, too), or if the best total of scores
    without the pair is. A right node that got no pair is given with its best candidate if it is ambiguous: by
    the rule above, or because its candidate went, unambiguously, to another at a score less than ``margin`` apart.
    """
    best: dict[tuple, float] = {}
    for a, b, s in edges:
        if s is not None and s == s and s >= least:
            best[a, b] = max(s, best.get((a, b), s))
    lefts, rights = sorted({a for a, _ in best}), sorted({b for _, b in best})
    left_at, right_at = {a: k for k, a in enumerate(lefts)}, {b: k for k, b in enumerate(rights)}
    gains: list[dict[int, float]] = [{} for _ in lefts]
    of_right: list[list[tuple[float, int]]] = [[] for _ in rights]
    for (a, b), s in sorted(best.items()):
        gains[left_at[a]][right_at[b]] = s - least + 1e-12
        of_right[right_at[b]].append((s, left_at[a]))
    found = Matching(gains)
    score = lambda i, j: best[lefts[i], rights[j]]
    ambiguous: set[int] = set()  # right nodes
    for i, j in found.pairs:
        s = score(i, j)
        others = [other for other, k in of_right[j] if k != i]
        if others and abs(s - max(others)) < margin:
            ambiguous.add(j)
        rivals = {k for k in gains[i] if k != j and abs(s - score(i, k)) < margin}
        if rivals:
            ambiguous |= rivals | {j}
        if j not in ambiguous:
            without = found.loss_without(i, margin + least)
            if without is not None and without[0] - least * without[1] < margin:
                ambiguous.add(j)
    out = [(lefts[i], rights[j], score(i, j), True, j in ambiguous) for i, j in found.pairs]
    clear = {i: score(i, j) for i, j in found.pairs if j not in ambiguous}
    matched = {j for _, j in found.pairs}
    for j, candidates in enumerate(of_right):
        if j not in matched and (j in ambiguous or any(k in clear and abs(clear[k] - s) < margin for s, k in candidates)):
            s, k = max(candidates, key=lambda c: (c[0], -c[1]))
            out.append((lefts[k], rights[j], s, False, True))
    return out
