"""Many small changes at once against one change at a time."""

from __future__ import annotations

import random

import numpy as np
import pytest

from weftline import options as O
from weftline.operators import batches, grouping, partition

from .conftest import rows
from .test_grouping import UNIT


def made(seed):
    """Changes of random units: options, (paths, lines) of each, and the same as one batch."""
    r = random.Random(seed)
    names = list(dict.fromkeys(f"{r.choice(['a', 'b', 'a/c', 'b/d/e'])}/{r.choice(['test_', '', ''])}{r.choice('xyz')}{r.choice(['.py', '.md', ''])}" for _ in range(r.randint(1, 25))))
    options = O.PlanOptions(max_loc=r.choice([40, 60, 120]), min_loc=r.choice([None, 10, 20, 30]), priority=r.choice(list(O.Priority)))
    sizes = [r.randint(1, r.choice([6, 12, 40])) for _ in range(12)]
    changes = [([r.choice(names) for _ in range(n)], [r.randint(0, 50) for _ in range(n)]) for n in sizes]
    real = np.arange(max(sizes)) < np.array(sizes)[:, None]
    kind, locs = -1 - np.broadcast_to(np.arange(max(sizes)), real.shape), np.zeros(real.shape, np.int64)
    kind = kind.copy()
    for k, (paths, lines) in enumerate(changes):
        kind[k, : len(paths)], locs[k, : len(lines)] = [names.index(p) for p in paths], lines
    near = batches._Codes(names).affinities(np.maximum(kind, 0), options.priority) * (real[:, :, None] & real[:, None, :])
    return options, changes, batches.Batch(real, locs, kind, near)


def labels(groups, n):
    return [next(k for k, g in enumerate(groups) if i in g) for i in range(n)]


@pytest.mark.parametrize("seed", range(30))
def test_batches_against_single_changes(seed):
    options, changes, batch = made(seed)
    grown = batches.grown(batch, options)
    repaired = batches.repaired(batch, grown, options)
    for k, (paths, lines) in enumerate(changes):
        n, units = len(paths), grouping.Units([grouping.file_of(p) for p in paths], lines, options)
        groups = units.grow()
        assert grown[k, :n].tolist() == labels(groups, n) and repaired[k, :n].tolist() == labels(units.repair(groups), n)
        if n <= batches.SUBSETS:
            group, cost = batches.cheapest(batches.Batch(*(x[k : k + 1, :n] for x in batch[:3]), batch.near[k : k + 1, :n, :n]), options)
            groups, least, _ = units.exact(0)
            assert (group[0].tolist(), cost[0]) == (labels(groups, n), least)


@pytest.mark.parametrize("strategy", ["graph", "cp_sat"])
def test_sizes_on_both_sides_of_the_limits(spark, monkeypatch, strategy):
    monkeypatch.setattr(batches, "SMALL", 6)  # workers take it as it is when the plan is made
    monkeypatch.setattr(batches, "SUBSETS", 6)
    options = O.PlanOptions(max_loc=60, min_loc=20, priority="logical", partition_strategy=strategy)
    units = [(c, 10 * p, f"d{p % 2}/f{p * c % 5}.py", 1 + p * 7 % 30) for c in range(1, 11) for p in range(c)]
    got = rows(partition.group_units(spark.createDataFrame(units, UNIT), options, keep=True), "change_id", "position")
    assert sorted((r["change_id"], r["position"], r["file_path"], r["loc"]) for r in got) == sorted(units)
    for c in range(1, 11):
        own = [u for u in units if u[0] == c]
        one = grouping.Units([grouping.file_of(u[2]) for u in own], [u[3] for u in own], options)
        groups = one.repair(one.grow()) if strategy == "graph" else one.exact(500)[0]
        assert {r["position"] // 10: r["group_ord"] for r in got if r["change_id"] == c} == dict(enumerate(labels(groups, c)))


def test_sums_of_many_changes_are_those_of_each():
    rng = random.Random(5)
    names = ["", "/", "a.py", "a", "test_a.py", "a_test.py", "b.md", "/a.py", "x/a.py", "x/test_a.py", "x/a_test.md", "x//a.py", "x/./y/a.py", "x/y/test_a.py", "x/y/z/b.md", "y/b.md", "y/test_b.md", ".py"]
    changes = [[rng.choice(names) for _ in range(rng.choice([1, 2, 7, 40]))] for _ in range(60)]
    places = [sorted(rng.sample(range(1000), len(c))) for c in changes]
    paths = list(dict.fromkeys(p for c in changes for p in c))
    kinds = np.array([paths.index(p) for c in changes for p in c])
    found = batches.sums(paths, kinds, np.array([x for p in places for x in p]), np.array([len(c) for c in changes]), list(O.Priority))
    for priority, rows_ in zip(O.Priority, found, strict=True):
        assert [tuple(r) for r in rows_.tolist()] == [grouping.pair_sums([grouping.file_of(x) for x in c], p, priority) for c, p in zip(changes, places, strict=True)]
