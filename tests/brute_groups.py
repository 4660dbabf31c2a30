"""Greedy groups, repair and exact groups over listed pairs, as brute force for operators/grouping.py."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import Any

from weftline import options as O


class Units:
    """Units of a change in order of position, with the affinity of each pair that has any."""

    def __init__(self, files: list[Any], locs: list[int], edges: Iterable[tuple[int, int, int]], options: O.PlanOptions):
        self.files, self.locs, self.options = files, locs, options
        self.near: dict[int, dict[int, int]] = defaultdict(dict)
        for a, b, score in edges:
            self.near[a][b] = self.near[b][a] = score

    def load(self, group: Iterable[int]) -> int:
        return sum(self.locs[u] for u in group)

    def closeness(self, a: Iterable[int], b: Iterable[int]) -> int:
        return sum(self.near[x].get(y, 0) for x in a for y in b)

    def grow(self) -> list[list[int]]:
        """Groups by affinity: the largest free unit starts one, and the unit that gains most joins as
        long as one that fits gains anything. Gains of all units are kept up to date, not recomputed."""
        o, free, out = self.options, set(range(len(self.locs))), []
        while free:
            seed = min(free, key=lambda u: (-self.locs[u], u))
            group, load, own = [seed], self.locs[seed], {self.files[seed]}
            free.discard(seed)
            pull = dict(self.near[seed])
            while free:
                best, best_gain = None, 0.0
                for u in sorted(free):
                    if load and load + self.locs[u] > o.max_loc:
                        continue
                    gain = pull.get(u, 0) + self.locs[u] / max(1, o.max_loc)
                    if o.priority == O.Priority.ORTHOGONAL and self.files[u] not in own:
                        gain -= O.ORTHOGONAL_FILE_PENALTY
                    if gain > best_gain:
                        best, best_gain = u, gain
                if best is None:
                    break
                group.append(best)
                free.discard(best)
                load += self.locs[best]
                own.add(self.files[best])
                for u, score in self.near[best].items():
                    pull[u] = pull.get(u, 0) + score
            out.append(sorted(group))
        return out

    def _adjacent(self, groups: list[list[int]], a: int, b: int) -> bool:
        """Whether in each file that both groups touch no other group stands between them."""
        for file in {self.files[u] for u in groups[a]} & {self.files[u] for u in groups[b]}:
            firsts = {i: [u for u in g if self.files[u] == file] for i, g in enumerate(groups)}
            order = sorted((u[0], i) for i, u in firsts.items() if u)
            place = {i: k for k, (_, i) in enumerate(order)}
            if abs(place[a] - place[b]) != 1:
                return False
        return True

    def _missing(self, *loads: int) -> int:
        """Lines that the loads lack to the minimum, together."""
        return sum(max(0, self.options.min_loc - n) for n in loads)

    def _partner(self, groups: list[list[int]], i: int) -> int | None:
        """The group that a small one had best be merged into: enough lines first, then closeness, distance,
        how full it gets, and the earlier pair."""
        own, loads = self.load(groups[i]), [self.load(g) for g in groups]
        fits = [j for j, n in enumerate(loads) if j != i and own + n <= self.options.max_loc and self._missing(own + n) < self._missing(own, n) and self._adjacent(groups, i, j)]

        def worth(j: int) -> tuple:
            return not self._missing(own + loads[j]), self.closeness(groups[i], groups[j]), -abs(groups[i][0] - groups[j][0]), loads[j], -min(i, j), -max(i, j)

        return max(fits, key=worth, default=None)

    def _merges(self, groups: list[list[int]]) -> Iterator[tuple[int, int]]:
        """Small groups and their partners, the smallest first."""
        if self.options.min_loc is not None and len(groups) > 1:
            small = [(self.load(g), g[0], i) for i, g in enumerate(groups) if self._missing(self.load(g))]
            pairs = ((i, self._partner(groups, i)) for _, _, i in sorted(small))
            yield from ((i, j) for i, j in pairs if j is not None)

    def repair(self, groups: list[list[int]]) -> list[list[int]]:
        """Merges groups below the minimum into the best group beside them, smallest first, until none can be."""
        groups = [list(g) for g in groups]
        while pair := next(self._merges(groups), None):
            i, j = pair
            groups[j] = sorted(groups[i] + groups[j])
            del groups[i]
        return groups

    def cost(self, groups: list[list[int]]) -> int:
        """What the exact search minimises."""
        o = self.options
        per_group, cross, divisor = O.EXACT_WEIGHTS[o.priority]
        total = per_group * len(groups)
        for g in groups:
            load = self.load(g)
            total += O.EXACT_OVERFLOW * max(0, load - o.max_loc)
            if o.min_loc is not None:
                total += O.EXACT_UNDERFLOW * max(0, o.min_loc - load)
            for a, b in combinations(g, 2):
                total += self._pair(a, b, cross, divisor)
        return total

    def _pair(self, a: int, b: int, cross: int, divisor: int) -> int:
        score = self.near[a].get(b, 0)
        return cross * (self.files[a] != self.files[b]) - (score // divisor if score > 0 else 0)

    def exact(self) -> list[list[int]]:
        """The cheapest partition, by search over set partitions with a bound; of equal ones the first in
        the order of growing groups. Groups come in order of their first unit."""
        o, n = self.options, len(self.locs)
        per_group, cross, divisor = O.EXACT_WEIGHTS[o.priority]
        pair = [[self._pair(a, b, cross, divisor) for b in range(n)] for a in range(n)]
        gain = [0] * (n + 1)  # the most that units from i on can still save
        for i in reversed(range(n)):
            gain[i] = gain[i + 1] + sum(min(0, pair[i][j]) for j in range(i))
        best: list = [None, None]
        groups: list[list[int]] = []

        def place(i: int, spent: int) -> None:
            over = sum(max(0, self.load(g) - o.max_loc) for g in groups)
            if best[0] is not None and spent + per_group * len(groups) + O.EXACT_OVERFLOW * over + gain[i] >= best[0]:
                return
            if i == n:
                total = self.cost(groups)
                if best[0] is None or total < best[0]:
                    best[:] = [total, [list(g) for g in groups]]
                return
            for g in groups:
                extra = sum(pair[i][j] for j in g)
                g.append(i)
                place(i + 1, spent + extra)
                g.pop()
            groups.append([i])
            place(i + 1, spent)
            groups.pop()

        place(0, 0)
        return best[1] or []
