"""Groups of many small changes at once: what grouping.Units does for one change, as array steps over a batch of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .. import options as O
from . import grouping, kernels

#: Units of a change up to which it goes with others of about its size; entries of such a batch's matrices.
SMALL, ENTRIES = 200, 1 << 20
#: Units up to which all subsets of a batch of changes are summed at once, and entries of such a batch, which caches hold.
SUBSETS, SUMS = 12, 1 << 17


class Batch(NamedTuple):
    """Changes of at most n units, filled up to n: in, lines, kind of file of each unit, and affinities of each two."""

    real: np.ndarray
    locs: np.ndarray
    kind: np.ndarray
    near: np.ndarray


class _Codes:
    """Features of different paths as numbers."""

    def __init__(self, paths: list[str]):
        files = [grouping.file_of(p) for p in paths]
        ids: dict[Any, int] = {}
        number = lambda x: ids.setdefault(x, len(ids))
        self.heads = np.full((len(files), max((len(f.heads) for f in files), default=0)), -1, np.int32)
        for row, f in zip(self.heads, files, strict=True):
            row[: len(f.heads)] = [number(("h", h)) for h in f.heads]
        self.suffix = np.array([number(("s", f.suffix)) for f in files], np.int32)
        self.subject = np.array([number(("b", f.subject)) for f in files], np.int32)
        self.other = np.array([number(("b", f.counterpart)) for f in files], np.int32)

    def affinities(self, kind: np.ndarray, priority: O.Priority) -> np.ndarray:
        """grouping.affinity() of each two units of changes; kind has the paths of each change's units."""
        same = lambda x, y: x[:, :, None] == y[:, None, :]
        depth = np.zeros((*kind.shape, kind.shape[1]), np.int32)
        for k in range(self.heads.shape[1]):
            at = self.heads[kind, k]
            depth += same(at, at) & (at >= 0)[:, :, None]
        score = depth * O.SHARED_DIR + O.SAME_SUFFIX * same(self.suffix[kind], self.suffix[kind]) + O.TEST_PAIR * same(self.subject[kind], self.other[kind])
        score = np.maximum(0, score - O.ORTHOGONAL_PENALTY) if priority == O.Priority.ORTHOGONAL else score + O.LOGICAL_DIR_BONUS * (depth > 0)
        return np.where(same(kind, kind), O.SAME_FILE, score)


def grown(b: Batch, o: O.PlanOptions) -> np.ndarray:
    """The group of each unit, by Units.grow() of each change; -1 where there is no unit."""
    many, n = b.locs.shape
    off = int(O.ORTHOGONAL_FILE_PENALTY) if o.priority == O.Priority.ORTHOGONAL else 0
    wide = int(b.locs.max(initial=0)) + 1
    group = np.full((many, n), -1, np.int64)
    free, own = b.real.copy(), np.zeros((many, n), bool)
    load, count = np.zeros(many, np.int64), np.zeros(many, np.int64)
    gain = np.zeros((many, n), np.int64)
    grows = np.zeros(many, bool)  # whether a group of the change is open
    at = np.flatnonzero(free.any(1))
    while len(at):
        open_, room = free[at], (o.max_loc - load[at])[:, None]
        fits = open_ & ((b.locs[at] <= room) | (load[at] == 0)[:, None])
        worth = np.where(fits & grows[at, None], (gain[at] - off * ~own[at]) * wide + b.locs[at], 0)
        unit = worth.argmax(1)
        joins = worth[np.arange(len(at)), unit] > 0
        seed = np.where(open_, b.locs[at], -1).argmax(1)
        unit = np.where(joins, unit, seed)
        new = at[~joins]
        count[new] += 1
        load[new], gain[new], own[new] = 0, 0, False
        grows[at] = True
        group[at, unit], free[at, unit] = count[at] - 1, False
        load[at] += b.locs[at, unit]
        gain[at] += b.near[at, unit]
        own[at] |= b.kind[at] == b.kind[at, unit][:, None]
        at = at[free[at].any(1)]
    return group


def repaired(b: Batch, group: np.ndarray, o: O.PlanOptions) -> np.ndarray:
    """The groups after Units.repair() of each change, numbered again where some are gone."""
    least, n = o.min_loc, group.shape[1]
    m = int(group.max(initial=-1)) + 1
    if least is not None and m > 1:
        far = n + 1
        member = (group[:, :, None] == np.arange(m)) & b.real[:, :, None]
        load = (member * b.locs[:, :, None]).sum(1)
        alive = member.any(1)
        anchor = np.where(alive, member.argmax(1), far)
        # Of each file, known by its first unit, the first unit in each group; far where there is none.
        file = (b.kind[:, :, None] == b.kind[:, None, :]).argmax(2)
        first = np.full((len(group), m, n), far, np.int16)
        change, unit = np.nonzero(b.real)
        np.minimum.at(first, (change, group[change, unit], file[change, unit]), unit.astype(np.int16))
        stuck = np.zeros_like(alive)
        numbers = np.arange(m)
        group = group.copy()
        small = alive & (load < least)
        at = np.flatnonzero(small.any(1))
        while len(at):
            row = np.arange(len(at))
            key = np.where(small[at] & ~stuck[at], (load[at] * (far + 1) + anchor[at]) * m + numbers, np.iinfo(np.int64).max)
            i = key.argmin(1)
            mine, all_ = first[at, i][:, None, :], first[at]
            below = np.where(all_ < mine, all_, -1).max(1, keepdims=True)
            above = np.where(all_ > mine, all_, far).min(1, keepdims=True)
            apart = ((mine < far) & (all_ < far) & ((all_ < below) | (all_ > above))).any(2)
            sum_ = load[at] + load[at, i][:, None]
            fits = alive[at] & ~apart & (sum_ <= o.max_loc) & (numbers != i[:, None])
            left = fits
            in_i = (group[at] == i[:, None]) & b.real[at]
            pull = np.einsum("bu,buv->bv", in_i.astype(np.float64), b.near[at].astype(np.float64))
            close = np.zeros((len(at), m + 1))
            np.add.at(close, (row[:, None], np.where(b.real[at], group[at], m)), pull)
            lo, hi = np.minimum(numbers, i[:, None]), np.maximum(numbers, i[:, None])
            for by in (sum_ >= least, close[:, :m], -np.abs(anchor[at] - anchor[at, i][:, None]), load[at], -lo, -hi):
                by = np.where(left, by, -np.inf)
                left = left & (by == by.max(1, keepdims=True))
            found, j = fits.any(1), left.argmax(1)
            stuck[at[~found], i[~found]] = True
            c, i, j = at[found], i[found], j[found]
            group[c] = np.where(group[c] == i[:, None], j[:, None], group[c])
            load[c, j] += load[c, i]
            anchor[c, j] = np.minimum(anchor[c, i], anchor[c, j])
            first[c, j] = np.minimum(first[c, i], first[c, j])
            first[c, i], alive[c, i] = far, False
            # What stands between two groups of a file may be gone now.
            stuck[c] &= ~((first[c] < far) & (first[c, j] < far)[:, None, :]).any(2)
            small = alive & (load < least)
            at = at[(small[at] & ~stuck[at]).any(1)]
        number = np.cumsum(alive, 1) - 1
        group = np.where(b.real, np.take_along_axis(number, np.maximum(group, 0), 1), -1)
    return group


def cheapest(b: Batch, o: O.PlanOptions) -> tuple[np.ndarray, np.ndarray]:
    """(the group of each unit, cost) by sums over all subsets, for changes that have n units each."""
    many, n = b.locs.shape
    weight, cross, divisor = O.EXACT_WEIGHTS[o.priority]
    same = b.kind[:, :, None] == b.kind[:, None, :]
    pair = cross * ~same - b.near // divisor
    load, cost = np.zeros((1 << n, many), np.int64), np.zeros((1 << n, many), np.int64)
    for i in range(n):
        with_i = np.zeros((1, many), np.int64)
        for j in range(i):
            with_i = np.concatenate([with_i, with_i + pair[:, i, j]])
        load[1 << i : 2 << i] = load[: 1 << i] + b.locs[:, i]
        cost[1 << i : 2 << i] = cost[: 1 << i] + with_i
    cost += weight + O.EXACT_OVERFLOW * np.maximum(0, load - o.max_loc)
    if o.min_loc is not None:
        cost += O.EXACT_UNDERFLOW * np.maximum(0, o.min_loc - load)
    best = np.zeros((1 << n, many), np.int64)
    for i in range(n):
        mask, part, begin = grouping._splits(i)
        best[1 << i : 2 << i] = np.minimum.reduceat(cost[1 << i | part] + best[mask ^ part], begin, 0)
    lead = np.zeros((many, n), np.int64)  # of each unit: the first unit of its group
    left = np.full(many, (1 << n) - 1)
    while mask := int(left.max(initial=0)):
        at = np.flatnonzero(left == mask)
        last = 1 << mask.bit_length() - 1
        rest, parts = mask ^ last, np.zeros(1, np.int64)
        for i in range(n):
            if rest >> i & 1:
                parts = np.concatenate([parts, parts + (1 << i)])
        own = parts[(cost[(parts | last)[:, None], at] + best[(rest ^ parts)[:, None], at]).argmin(0)] | last
        low = np.log2(own & -own).astype(np.int64)
        for u in range(n):
            hit = own >> u & 1 == 1
            lead[at[hit], u] = low[hit]
        left[at] ^= own
    number = np.cumsum(lead == np.arange(n), 1) - 1
    return np.take_along_axis(number, lead, 1), best[-1]


def _packed(sizes: np.ndarray, even: bool) -> Iterator[np.ndarray]:
    """Changes in batches of about one size, or exactly one; matrices of a batch stay within ENTRIES."""
    order = np.argsort(sizes, kind="stable")
    begin = 0
    while begin < len(order):
        low = int(sizes[order[begin]])
        top = low if even else low + low // 4 + 2
        end = min(int(np.searchsorted(sizes[order], top, "right")), begin + max(1, SUMS * 3 // 3**low if even else ENTRIES // (top * top)))
        yield order[begin:end]
        begin = end


def _steps(name: str, o: O.PlanOptions, batch: Batch, places: np.ndarray) -> list[np.ndarray]:
    """Of each unit of a batch what one of the ways says."""
    if name == "exact":
        group, cost = cheapest(batch, o)
        return [group, np.broadcast_to(cost[:, None], group.shape), np.broadcast_to(cost[:, None], group.shape)]
    return [repaired(batch, grown(batch, o), o)]


class _Classes:
    """Classes of paths by what they share, as numbers: pairs with an affinity are pairs within classes, by inclusion and
    exclusion. Two files of one stem of which one is a test are a pair of the stem's class, but not of the subject's."""

    def __init__(self, paths: list[str]):
        codes = _Codes(paths)
        none = np.full(len(paths), -1, np.int64)
        self.heads = [codes.heads[:, k].astype(np.int64) for k in range(codes.heads.shape[1])]
        self.depth = (codes.heads >= 0).sum(1)
        self.top = self.heads[0] if self.heads else none
        self.path, self.suffix, subject = np.arange(len(paths)), codes.suffix.astype(np.int64), codes.subject.astype(np.int64)
        stem = np.minimum(subject, codes.other)
        both = lambda x, y: np.unique(x * (int(y.max(initial=0)) + 1) + y, return_inverse=True)[1]
        self.file = (stem, subject)
        self.suffix_file = tuple(both(self.suffix, x) for x in self.file)
        self.top_file = tuple(both(self.top + 1, x) for x in self.file)
        self.top_suffix = both(self.top + 1, self.suffix)
        self.top_suffix_file = tuple(both(self.top_suffix, x) for x in self.file)

    def weights(self, priority: O.Priority) -> list[tuple[np.ndarray, Any, Any]]:
        """(class of each path, what a pair of it adds to the affinity, and to the number of pairs above 0)."""
        has = (self.top >= 0).astype(np.int64)
        pair = lambda classes, w, m: [(classes[0], w, m), (classes[1], -w, -m)]
        out = pair(self.top_file, 0 * has, -has) + [(self.top, 0 * has, has)]
        if priority == O.Priority.LOGICAL:
            extra, alike = O.LOGICAL_DIR_BONUS, self.depth * O.SHARED_DIR + O.SAME_SUFFIX + O.LOGICAL_DIR_BONUS * (self.depth > 0)
            out += pair(self.file, O.TEST_PAIR, 1) + [(self.suffix, O.SAME_SUFFIX, 1)] + pair(self.suffix_file, 0, -1)
            out += [(self.top_suffix, 0 * has, -has)] + pair(self.top_suffix_file, 0 * has, has)
        else:
            off = O.ORTHOGONAL_PENALTY
            extra, alike = -off, (self.depth * O.SHARED_DIR + O.SAME_SUFFIX - off) * (self.depth > 0)
            out += pair(self.file, O.TEST_PAIR - off, 1) + pair(self.suffix_file, O.SAME_SUFFIX, 0) + pair(self.top_file, off * has, 0 * has)
            out += [(self.top_suffix, O.SAME_SUFFIX * has, 0 * has)] + pair(self.top_suffix_file, -O.SAME_SUFFIX * has, 0 * has)
        out += [(h, (O.SHARED_DIR + extra * (k == 0)) * (h >= 0), 0) for k, h in enumerate(self.heads)]
        return [*out, (self.path, O.SAME_FILE - alike, 0 if priority == O.Priority.LOGICAL else 1 - has)]


def sums(paths: list[str], kinds: np.ndarray, place: np.ndarray, sizes: np.ndarray, priorities: list[O.Priority]) -> list[np.ndarray]:
    """grouping.pair_sums() of each change, a row for each: for each priority an array of four columns. kinds: the path of
    each unit; units of a change stand together, in order of place."""
    classes = _Classes(paths)
    change = np.repeat(np.arange(len(sizes)), sizes)
    ranks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ranked(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit how many of its class and change stand before and behind it."""
        if id(of) not in ranks:
            key = change * (int(of.max(initial=0)) + 2) + of[kinds] + 1
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.diff(key[order], prepend=-1))
            many = np.diff(head, append=len(key))
            before = np.empty(len(key), np.int64)
            before[order] = np.arange(len(key)) - np.repeat(head, many)
            behind = np.empty(len(key), np.int64)
            behind[order] = np.repeat(many, many)
            ranks[id(of)] = before, behind - 1 - before
        return ranks[id(of)]

    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(sizes)])])
    out = []
    for priority in priorities:
        pairs, near, far = (np.zeros(len(place), np.int64) for _ in range(3))
        for of, weight, meets in classes.weights(priority):
            before, behind = ranked(of)
            at = lambda x: x[kinds] if isinstance(x, np.ndarray) else x
            w = at(weight)
            pairs += at(meets) * before
            near += w * before
            far += w * behind
        out.append(np.stack([total(pairs), total(near), total(far * place), total(near * place)], 1))
    return out


def sums_by_change(units: DataFrame, priorities: list[O.Priority]) -> DataFrame:
    """change_id, priority, pairs, score, first, second: sums() of whole batches of changes, where there is a pair."""
    kind = units.schema["change_id"].dataType.simpleString()
    rows = units.select("change_id", F.struct("position", F.col("file_path").cast("string").alias("path")).alias("r"))
    full = f"change_id {kind}, priority string, pairs long, score long, first long, second long"
    parsed = to_arrow_schema(_parse_datatype_string(full))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in (part for batch in batches for part in kernels.slices(batch)):
            lists = given.column(1)
            flat, path = lists.flatten(), lists.flatten().field("path").dictionary_encode()
            kinds, place = path.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.field("position").to_numpy(zero_copy_only=False).astype(np.int64)
            for priority, found in zip(priorities, sums(path.dictionary.to_pylist(), kinds, place, np.diff(lists.offsets.to_numpy()), priorities), strict=True):
                some = np.flatnonzero(found[:, 0])
                columns = [given.column(0).take(pa.array(some)), pa.array([str(priority)] * len(some), pa.string()), *(pa.array(c) for c in found[some].T)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, parsed, strict=True)], schema=parsed)

    return rows.groupBy("change_id").agg(F.sort_array(F.collect_list("r")).alias("rows")).mapInArrow(work, full)


def by_units(units: DataFrame, name: str, one: Callable[[grouping.Units], list[tuple]], o: O.PlanOptions, schema: str, keep: bool) -> DataFrame:
    """For each unit its change and position and, by schema, what `one` says of it: a row for each unit. Small changes go by
    _steps(), whole batches at a time, with the same result. keep: the unit's loc and file_path come along."""
    kind = units.schema["change_id"].dataType.simpleString()
    rows = units.select("change_id", F.struct("position", F.col("loc").cast("long").alias("loc"), F.col("file_path").cast("string").alias("path")).alias("r"))
    grouped = rows.groupBy("change_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    full = f"change_id {kind}, position int, {schema}" + ", loc long, file_path string" * keep
    parsed = to_arrow_schema(_parse_datatype_string(full))
    most = SUBSETS if name == "exact" else SMALL

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for k in range(0, given.num_rows, 2000):
                yield from told(given.slice(k, 2000))

    def told(given: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = given.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        place, loc = flat.field("position").to_numpy(zero_copy_only=False), flat.field("loc").to_numpy(zero_copy_only=False)
        path = flat.field("path").dictionary_encode()
        kinds, names = path.indices.to_numpy(zero_copy_only=False).astype(np.int64), path.dictionary.to_pylist()
        codes = _Codes(names)
        out = [np.zeros(len(place), np.int64) for _ in schema.split(",")]
        small = np.flatnonzero((sizes <= most) & (sizes > 0))
        for chosen in _packed(sizes[small], name == "exact"):
            chosen = small[chosen]
            n = int(sizes[chosen].max())
            at = bounds[chosen][:, None] + np.arange(n)
            real = np.arange(n) < sizes[chosen][:, None]
            at = np.where(real, at, 0)
            kind_ = np.where(real, kinds[at], kinds[at[:, :1]])
            batch = Batch(real, np.where(real, loc[at], 0), np.where(real, kind_, -1 - np.arange(n)), codes.affinities(kind_, o.priority) * (real[:, :, None] & real[:, None, :]))
            for column, found in zip(out, _steps(name, o, batch, place), strict=True):
                column[at[real]] = found[real]
        known: dict[int, grouping.File] = {}
        for c in np.flatnonzero(sizes > most).tolist():
            own = slice(int(bounds[c]), int(bounds[c + 1]))
            files = [known.get(x) or known.setdefault(x, grouping.file_of(names[x])) for x in kinds[own].tolist()]
            for i, *found in one(grouping.Units(files, loc[own].tolist(), o)):
                for column, x in zip(out, found, strict=True):
                    column[own.start + i] = x
        change = given.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        columns = [change, flat.field("position"), *out, *([flat.field("loc"), flat.field("path")] if keep else [])]
        arrays = [(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, parsed, strict=True)]
        made = pa.RecordBatch.from_arrays(arrays, schema=parsed)
        for k in range(0, made.num_rows, 10_000):
            yield made.slice(k, 10_000)

    return grouped.mapInArrow(work, full)
