"""Cheapest chunks of many changes at once, against one change at a time."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.conftest import rows
from weftline.operators import chunking, kernels


def _random(r: random.Random, most: int) -> list[tuple[list[str], list[int]]]:
    out = []
    for _ in range(60):
        n = r.choice((0, 1, 2, 3, 7, 20, most))
        sizes = r.choice(((1, 2, 3), (0, 1), (5, 20, 29), (30,)))
        out.append(([r.choice("abcd") for _ in range(n)] if r.random() < 0.5 else sorted(r.choices("abcdefgh", k=n)), [r.choice(sizes) for _ in range(n)]))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_side_by_side_as_one_by_one(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(kernels, "WINDOW", r.choice((0, 4, 64, 10_000)))
    changes, budget = _random(r, r.choice((33, 200))), r.choice((30, 45, 100))
    bounds = np.cumsum([0, *[len(f) for f, _ in changes]])
    files = np.array([ord(x) for f, _ in changes for x in f])
    cost, starts = kernels.best_chunks_of(bounds, files, np.array([x for _, t in changes for x in t], np.int64), budget)
    for k, (f, t) in enumerate(changes):
        want = kernels.best_chunks(f, t, budget)
        assert (cost[k], np.flatnonzero(starts[bounds[k] : bounds[k + 1]]).tolist()) == want


def test_no_change_has_none():
    cost, starts = kernels.best_chunks_of(np.zeros(1, int), np.zeros(0, int), np.zeros(0, int), 10)
    assert len(cost) == len(starts) == 0


def test_oversize_changes_are_left_out_without_a_join(spark):
    r = random.Random(3)
    changes = [c for c in _random(r, 40) if c[0]]
    data = [(k, i, f, i * 2, t) for k, (fs, ts) in enumerate(changes) for i, (f, t) in enumerate(zip(fs, ts, strict=True))]
    data += [(900, 0, None, 0, 3), (900, 1, None, 1, 3), (901, 0, "a", 0, 30), (901, 1, "a", 1, 31)]
    seq = spark.createDataFrame(data, "change_id long, seq int, file_path string, hunk_index int, token_estimate int")
    want = {k: kernels.best_chunks(f, t, 30) for k, (f, t) in enumerate(changes)} | {900: kernels.best_chunks([None, None], [3, 3], 30)}
    costs = chunking.chunk_costs(seq, 30)
    assert {x["change_id"]: (x["cost"], x["chunks"]) for x in rows(costs)} == {k: (c, len(s)) for k, (c, s) in want.items()}
    cut = chunking.chunk(seq, 30)
    starts = {}
    for x in sorted(rows(cut), key=lambda x: (x["change_id"], x["seq"])):
        starts.setdefault((x["change_id"], x["chunk"]), x["seq"])
    assert starts == {(k, i): s for k, (_, ss) in want.items() for i, s in enumerate(ss)}
    assert cut.count() == len(data) - 2 and {x["change_id"] for x in rows(chunking.chunk(seq, 30, "greedy"))} == set(want)
    for df in (costs, cut, chunking.chunk(seq, 30, "greedy")):  # an anti-join went over the rows a second time
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
