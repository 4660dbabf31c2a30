"""Algorithms that go step by step, on plain lists and without Spark; each runs once for each change."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .. import options as O


#: Bytes of a batch that are made Python objects at a time, if it has more than one change in them.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE bytes; one change is never parted."""
    step = max(1, batch.num_rows * SLICE // max(SLICE, batch.nbytes))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def values(array: pa.Array) -> list:
    """array.to_pylist(), column by column: structs are made of whole columns, lists cut out of one."""
    kind = array.type
    if pa.types.is_list(kind):
        flat, out, at = values(array.flatten()), [], 0
        for n in array.value_lengths().to_pylist() if array.null_count else np.diff(array.offsets.to_numpy()).tolist():
            out.append(None if n is None else flat[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, row, strict=True)) for row in zip(*map(values, array.flatten()), strict=True)]
        if array.null_count:
            return [x if known else None for x, known in zip(out, array.is_valid().to_pylist(), strict=True)]
        return out
    if pa.types.is_string(kind) or ((pa.types.is_integer(kind) or pa.types.is_boolean(kind)) and not array.null_count):
        return array.to_numpy(zero_copy_only=False).tolist()
    return array.to_pylist()


def by_change(df: DataFrame, columns: list[str], run: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """run over the rows of each change, given in the order of `columns`; result rows without change_id.

    Rows of a change are collected into one array, and whole batches of changes go to Python at once:
    cost is by row, not by change. A change is the unit of work of these algorithms. Of a batch about SLICE bytes at a
    time are Python's objects, whatever texts the rows hold."""
    kind = df.schema["change_id"].dataType.simpleString()
    grouped = df.groupBy("change_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    full = f"change_id {kind}, {schema}"
    parsed = to_arrow_schema(_parse_datatype_string(full))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for given in batches for part in slices(given)):
            out: list[tuple] = []
            for change, rows in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                out += [(change, *r) for r in run(rows)]
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 10_000], strict=True), parsed, strict=True)], schema=parsed)

    return grouped.mapInArrow(work, full)


# ---- chunks -------------------------------------------------------------------------------------


def best_chunks(files: list[Any], tokens: list[int], budget: int) -> tuple[float, list[int]]:
    """The cheapest cut of a sequence into chunks within the budget: (cost, first hunk of each chunk).
    Of equally cheap last chunks the shortest is taken. Every hunk must fit the budget."""
    n = len(tokens)
    upto = np.concatenate([[0], np.cumsum(np.array(tokens, np.int64))])
    cost, cut = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    mix = np.zeros(n, np.int64)  # of each start: files between it and the present end, but for one
    before: dict[Any, int] = {}
    for end, file in enumerate(files, 1):
        mix[before.get(file, -1) + 1 : end - 1] += 1
        before[file] = end - 1
        first = int(np.searchsorted(upto, upto[end] - budget))
        slack = budget - (upto[end] - upto[first:end])
        border = O.CHUNK_SAME_FILE_BOUNDARY if end < n and files[end] == file else 0.0
        whole = cost[first:end] + (O.CHUNK_BASE_COST + slack * slack / max(1, budget) + mix[first:end] * O.CHUNK_FILE_MIX + border)
        cut[end] = end - 1 - int(whole[::-1].argmin())
        cost[end] = whole[cut[end] - first]
    starts = [n]
    while starts[-1]:
        starts.append(int(cut[starts[-1]]))
    return float(cost[n]), starts[:0:-1]


#: Hunks of a window up to which changes are cut side by side.
WINDOW = 64


def best_chunks_of(bounds: np.ndarray, files: np.ndarray, tokens: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """best_chunks of many changes: (cost of each, whether a chunk starts at each hunk). Hunks of change k are those from bounds[k] to
    bounds[k + 1]; files are numbers. Changes of about one length are cut side by side, step by step; those with a
    window of more than WINDOW hunks one by one."""
    bounds = bounds.astype(np.int64)
    n, first = np.diff(bounds), bounds[:-1]
    change = np.repeat(np.arange(len(n)), n)
    upto = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    fall = np.zeros(len(n), bool)
    fall[change[tokens < 0]] = True
    order = np.lexsort((np.arange(len(files)), files, change))  # hunks of a file follow each other
    same = (files[order][1:] == files[order][:-1]) & (change[order][1:] == change[order][:-1])
    before = np.full(len(files), -1, np.int64)  # the hunk before of the same file, by its place in the change
    before[order[1:][same]] = order[:-1][same] - first[change[order[1:][same]]]
    reach = np.full(len(files), budget + 1, np.int64)  # hunks of the widest chunk that ends here
    if not fall.any():
        reach = np.arange(1, len(files) + 1) - np.maximum(first[change], np.searchsorted(upto, upto[1:] - budget))
    widest = np.zeros(len(n), np.int64)
    np.maximum.at(widest, change, reach)
    fall |= widest > WINDOW
    cost, starts = np.zeros(len(n)), np.zeros(len(files), bool)
    for k in np.flatnonzero(fall & (n > 0)).tolist():
        a, z = bounds[k], bounds[k + 1]
        cost[k], heads = best_chunks(files[a:z].tolist(), tokens[a:z].tolist(), budget)
        starts[a + np.array(heads)] = True
    scale = np.where(fall | (n == 0), 0, np.frexp(n.astype(float))[1])
    for size in np.unique(scale[scale > 0]).tolist():
        own = np.flatnonzero(scale == size)
        _side_by_side(own, first[own], n[own], before, tokens, reach, budget, cost, starts)
    return cost, starts


def _side_by_side(own: np.ndarray, first: np.ndarray, n: np.ndarray, before: np.ndarray, tokens: np.ndarray, reach: np.ndarray, budget: int, cost: np.ndarray, starts: np.ndarray) -> None:
    """best_chunks of the changes `own`, a column each; writes into cost and starts."""
    most, lanes = int(n.max()), np.arange(len(own))
    place = np.minimum(first + np.arange(most)[:, None], len(tokens) - 1)
    inside = np.arange(most)[:, None] < n
    load = np.where(inside, tokens[place], 0)
    prev, width = np.where(inside, before[place], -1), np.where(inside, reach[place], 1)
    upto = np.concatenate([np.zeros((1, len(own)), np.int64), np.cumsum(load, 0, dtype=np.int64)])
    total, cut = np.zeros((most + 1, len(own))), np.zeros((most + 1, len(own)), np.int32)
    mix = np.zeros((most, len(own)), np.int64)
    for end in range(1, most + 1):
        wide = int(width[end - 1].max())
        rows = np.arange(end - 1, end - 1 - wide, -1)[:, None]  # the shortest chunk first
        low = end - wide
        mix[low : end - 1] += rows[:0:-1] > prev[end - 1]
        slack = budget - (upto[end] - upto[low:end][::-1])
        border = np.where(prev[end] == end - 1, O.CHUNK_SAME_FILE_BOUNDARY, 0.0) if end < most else 0.0
        whole = total[low:end][::-1] + (O.CHUNK_BASE_COST + slack * slack / max(1, budget) + mix[low:end][::-1] * O.CHUNK_FILE_MIX + border)
        whole[end - rows[:, 0][:, None] > width[end - 1]] = np.inf
        best = whole.argmin(0)
        cut[end], total[end] = end - 1 - best, whole[best, lanes]
    cost[own] = total[n, lanes]
    at, lane = n.copy(), lanes
    while len(lane):
        at = cut[at, lane]
        starts[first[lane] + at] = True
        lane, at = lane[at > 0], at[at > 0]


def bins(loads: np.ndarray, limit: int) -> np.ndarray:
    """For each element of a sequence the number of the bin it falls in: a bin ends before the element that would
    lift it over the limit; one too large stands alone. One search in running sums for each bin."""
    upto = np.concatenate([[0], np.cumsum(loads, dtype=np.int64)])
    heads = np.zeros(len(loads), np.int64)
    at = 0
    while at < len(loads):
        heads[at] = 1
        at = max(at + 1, int(np.searchsorted(upto, upto[at] + limit, "right")) - 1)
    return np.cumsum(heads) - 1


# ---- graphs -------------------------------------------------------------------------------------


class Graph:
    """Nodes in order and the parents of each. Parents that aren't nodes are left out and listed."""

    def __init__(self, parents: dict[Any, list[Any]]):
        self.unknown = [(n, p) for n, ps in parents.items() for p in ps if p not in parents]
        self.parents = {n: [p for p in dict.fromkeys(ps) if p in parents] for n, ps in parents.items()}
        self.children: dict[Any, list[Any]] = {n: [] for n in parents}
        for n, ps in self.parents.items():
            for p in ps:
                self.children[p].append(n)
        self._bits: dict[Any, int] | None = None

    def levels(self) -> dict[Any, int]:
        """The longest way from a root, for each node that is on or behind no cycle."""
        open_ = {n: len(ps) for n, ps in self.parents.items()}
        level, ready = {}, [n for n, k in open_.items() if not k]
        depth = 0
        while ready:
            behind = []
            for n in ready:
                level[n] = depth
                for c in self.children[n]:
                    open_[c] -= 1
                    if not open_[c]:
                        behind.append(c)
            ready, depth = behind, depth + 1
        return level

    def acyclic(self) -> bool:
        return len(self.levels()) == len(self.parents)

    def order(self) -> list[Any]:
        level, place = self.levels(), {n: i for i, n in enumerate(self.parents)}
        return sorted(level, key=lambda n: (level[n], place[n]))

    def reach(self) -> dict[Any, int]:
        """All ancestors of each node as the bits of a number, by place of node. One pass down the levels, where a node has
        what its parents have; nodes on or behind a cycle are passed until nothing is new."""
        if self._bits is None:
            self.place = {n: i for i, n in enumerate(self.parents)}
            levels = self.levels()
            self._bits = dict.fromkeys(self.parents, 0)
            rest = [n for n in self.parents if n not in levels]
            for n in sorted(levels, key=levels.__getitem__):
                self._gather(n)
            while any([self._gather(n) for n in rest]):
                pass
        return self._bits

    def _gather(self, n: Any) -> bool:
        """Takes over what a node's parents reach; whether any is new."""
        have = before = self._bits[n]
        for p in self.parents[n]:
            have |= self._bits[p] | 1 << self.place[p]
        self._bits[n] = have
        return have != before

    def reaches(self, node: Any, ancestor: Any) -> bool:
        return bool(self.reach()[node] >> self.place[ancestor] & 1)

    def ancestors(self, node: Any) -> set[Any]:
        bits = self.reach()[node]
        return {n for n, i in self.place.items() if bits >> i & 1 and n != node}

    def descendants(self, node: Any) -> set[Any]:
        self.reach()
        return {n for n in self.parents if n != node and self.reaches(n, node)}

    def _around(self, n: Any, p: Any) -> bool:
        """Whether a parent of a node on or behind a cycle is also reached without the edge between them."""
        around = {q for q in self.parents[n] if q != p}
        todo = list(around)
        while todo:
            q = todo.pop()
            new = {r for r in self.parents[q] if (q, r) != (n, p)} - around
            around |= new
            todo += new
        return p in around

    def reduced(self) -> dict[Any, list[Any]]:
        """Parents without those that another parent reaches, in order of name. On and behind cycles each edge is
        judged by itself on the whole graph, so edges of a cycle with a detour go, too."""
        levels, bits, out = self.levels(), self.reach(), {}
        for n, ps in self.parents.items():
            if n in levels:
                known = 0
                for p in ps:
                    known |= bits[p]
                out[n] = sorted(p for p in ps if not known >> self.place[p] & 1)
            else:
                out[n] = sorted(p for p in ps if not self._around(n, p))
        return out

    def chains(self) -> list[list[Any]]:
        """Longest runs without a fork or a merge, in order of their heads."""
        def joined(n: Any) -> bool:
            return len(self.parents[n]) == 1 and len(self.children[self.parents[n][0]]) == 1

        out = []
        for n in self.order():
            if not joined(n):
                run = [n]
                while len(self.children[run[-1]]) == 1 and joined(self.children[run[-1]][0]):
                    run.append(self.children[run[-1]][0])
                out.append(run)
        return out

    def tree(self, current: Any = None, markdown: bool = False, most: int = 10_000) -> list[str]:
        """Lines of a tree from the roots; a node with several parents shows under each. From line `most` on, what is
        below a node is shown once, and referred to after that: in a graph with many ways each way would be a line."""
        lines: list[str] = []
        shown: set[Any] = set()

        def line(n: Any, lead: str, last: bool, top: bool) -> str:
            mark = "  <-- this one" if n == current else ""
            if markdown:
                return f"{lead}- {f'**{n}**' if n == current else n}{mark}"
            return f"{n}{mark}" if top else f"{lead}{'└── ' if last else '├── '}{n}{mark}"

        todo = [(n, "", True, True) for n in reversed(self.parents) if not self.parents[n]] if self.acyclic() else []
        while todo:
            n, lead, last, top = todo.pop()
            again = len(lines) >= most and n in shown and bool(self.children[n])
            lines.append(line(n, lead, last, top) + " (see above)" * again)
            shown.add(n)
            if again:
                continue
            inner = lead + "  " if markdown else lead if top else lead + ("    " if last else "│   ")
            below = self.children[n]
            todo += [(c, inner, k == len(below) - 1, False) for k, c in reversed([*enumerate(below)])]
        return lines


class History:
    """Commits and their parents; each has a generation above those of its parents. Parents that aren't known and
    commits on or behind a cycle have none and are left out."""

    def __init__(self, parents: dict[Any, list[Any]]):
        graph = Graph(parents)
        self.generation = graph.levels()
        self.parents = {c: [p for p in graph.parents[c] if p in self.generation] for c in self.generation}

    def bases(self, a: Any, b: Any) -> set[Any]:
        """Commits that both reach and that no other such commit reaches. Commits are taken by falling generation, so all
        that lead to one have marked it before; the walk ends when what is left lies behind a base."""
        if a not in self.parents or b not in self.parents:
            return set()
        from_a, from_b, behind = 1, 2, 4
        marks = {a: from_a}
        marks[b] = marks.get(b, 0) | from_b
        heap = [(-self.generation[c], k, c) for k, c in enumerate(marks)]
        heapq.heapify(heap)
        live, found = len(heap), set()
        while live:
            *_, c = heapq.heappop(heap)
            mark = marks[c]
            live -= not mark & behind
            if mark == from_a | from_b:
                found.add(c)
                mark |= behind
            for p in self.parents[c]:
                had = marks.get(p)
                marks[p] = (had or 0) | mark
                if had is None:
                    heapq.heappush(heap, (-self.generation[p], len(marks), p))
                    live += not mark & behind
                else:
                    live -= not had & behind and bool(mark & behind)
        return found


# ---- hunks --------------------------------------------------------------------------------------


def apply_hunks(base: str, hunks: Iterable[tuple[int, int, str]]) -> str:
    """Replaces lines of a text by hunks (source start, source length, text with header), from the last
    up, so no place moves before it is used. The result ends with a line end unless it is empty."""
    lines = [x + "\n" for x in base.split("\n")]
    lines[-1:] = [lines[-1][:-1]] if lines[-1] != "\n" else []
    for start, length, text in sorted(hunks, reverse=True):
        at = max(0, start - 1)
        lines[at : at + length] = [x[1:] + "\n" for x in text.split("\n")[1:] if x[:1] in ("+", " ")]
    out = "".join(lines)
    return out if not out or out.endswith("\n") else out + "\n"
