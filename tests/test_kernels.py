from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from weftline import options as O
from weftline.operators.kernels import Graph, History, apply_hunks, best_chunks, bins


def cut_cost(files, tokens, starts, budget):
    total, ends = 0.0, [*starts[1:], len(tokens)]
    for a, z in zip(starts, ends, strict=True):
        used = sum(tokens[a:z])
        if used > budget:
            return float("inf")
        total += 100 + (budget - used) ** 2 / max(1, budget) + 50 * (len(set(files[a:z])) - 1) + (10_000 if z < len(tokens) and files[z - 1] == files[z] else 0)
    return total


def test_best_chunks_against_all_cuts():
    cases = 0
    for n in range(1, 5):
        for files in itertools.product("ab", repeat=n):
            for tokens in itertools.product((1, 2, 3), repeat=n):
                for budget in (3, 4, 5):
                    cost, starts = best_chunks(files, tokens, budget)
                    cuts = [[0, *c] for k in range(n) for c in itertools.combinations(range(1, n), k)]
                    assert cost == pytest.approx(min(cut_cost(files, tokens, c, budget) for c in cuts))
                    assert cut_cost(files, tokens, starts, budget) == pytest.approx(cost)
                    cases += 1
    assert cases > 4000


def test_best_chunks_fixtures():
    assert best_chunks(["a", "b"], [100, 100], 150)[1] == [0, 1]
    assert best_chunks(["a", "b"], [100, 100], 1000)[1] == [0]
    assert best_chunks(["a", "b", "b"], [30, 60, 40], 100)[1] == [0, 1]
    assert best_chunks([], [], 100) == (0.0, [])
    assert best_chunks(["a", "b"], [50, 50], 100)[1] == [0]


@pytest.mark.parametrize("seed", range(30))
def test_bins_against_a_fold(seed):
    r = random.Random(seed)
    loads, limit = [r.choice((0, 1, 2, 5, 9, 30)) for _ in range(r.randint(0, 40))], r.choice((1, 5, 10, 29))
    want, bin_, load = [], -1, 0
    for x in loads:
        fits = bin_ >= 0 and load + x <= limit
        bin_, load = (bin_, load + x) if fits else (bin_ + 1, x)
        want.append(bin_)
    assert bins(np.array(loads, np.int64), limit).tolist() == want


def test_bins_of_a_million():
    began = time.time()
    assert bins(np.ones(1_000_000, np.int64), 7)[-1] == 142_857 and time.time() - began < 5


@pytest.mark.parametrize("seed", range(40))
def test_merge_bases_against_all_ancestors(seed):
    r = random.Random(seed)
    parents = {f"c{r.random()}": [] for _ in range(r.randint(1, 3))}
    for k in range(25):
        parents[f"d{k}"] = r.sample(list(parents), min(len(parents), r.choice((1, 1, 2, 3))))
    graph, history = Graph(parents), History(parents)
    for _ in range(30):
        a, b = r.choice(list(parents)), r.choice(list(parents))
        both = ({a} | graph.ancestors(a)) & ({b} | graph.ancestors(b))
        assert history.bases(a, b) == both - {x for c in both for x in graph.ancestors(c)}
    assert history.bases("nothing", a) == set()


def test_merge_bases_of_a_long_line():
    n = 100_000
    history = History({k: [k - 1] if k else [] for k in range(n)} | {"x": [n - 5]})
    began = time.time()
    assert all(history.bases(n - 1 - k, "x") == {min(n - 1 - k, n - 5)} for k in range(20)) and time.time() - began < 2


def test_graph_fixtures():
    line = Graph({"a": [], "b": ["a"], "c": ["b"]})
    assert line.order() == ["a", "b", "c"] and line.ancestors("c") == {"a", "b"} and line.descendants("a") == {"b", "c"}
    diamond = Graph({"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]})
    assert diamond.chains() == [["a"], ["b"], ["c"], ["d"]] and diamond.levels()["d"] == 2
    assert not Graph({"a": ["b"], "b": ["a"]}).acyclic()
    assert Graph({"pr-1": [], "pr-2": [], "pr-3": ["pr-2"], "pr-4": [], "pr-5": ["pr-4"]}).chains() == [["pr-1"], ["pr-2", "pr-3"], ["pr-4", "pr-5"]]
    fork = Graph({"a": [], "b": ["a"], "c": ["b"], "d": ["a"]})
    assert sorted(fork.chains()) == [["a"], ["b", "c"], ["d"]]
    assert Graph({"a": ["zz"]}).unknown == [("a", "zz")]
    assert Graph({"a": [], "b": ["a"], "c": ["a", "b"]}).reduced() == {"a": [], "b": ["a"], "c": ["b"]}


@pytest.mark.parametrize("seed", range(30))
def test_reduction_keeps_reach(seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(8)]
    g = Graph({n: r.sample(names[:i], r.randint(0, i)) for i, n in enumerate(names)})
    small = Graph(g.reduced())
    for n in names:
        assert small.ancestors(n) == g.ancestors(n)
        for p in small.parents[n]:
            without = Graph({m: [q for q in ps if (m, q) != (n, p)] for m, ps in small.parents.items()})
            assert p not in without.ancestors(n)


@pytest.mark.parametrize("seed", range(60))
def test_reach_and_reduction_against_search(seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(r.randint(1, 9))]
    # Odd seeds have cycles.
    g = Graph({n: r.sample(names if seed % 2 else names[:i], r.randint(0, min(3, len(names) if seed % 2 else i))) for i, n in enumerate(names)})

    def search(node, but=None):
        seen, todo = set(), [p for p in g.parents[node] if (node, p) != but]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [p for p in g.parents[n] if (n, p) != but]
        return seen

    for n in names:
        assert g.ancestors(n) == search(n) - {n} and g.descendants(n) == {m for m in names if m != n and n in search(m)}
    assert g.reduced() == {n: sorted(p for p in g.parents[n] if p not in search(n, (n, p))) for n in names}


def test_closure_of_two_thousand_groups():
    r = random.Random(1)
    g = Graph({k: sorted({r.randrange(k) for _ in range(6)}) if k else [] for k in range(2000)})
    began = time.time()
    small = g.reduced()
    assert time.time() - began < 5 and Graph(small).reach() == g.reach()


def test_tree_of_many_ways_is_bounded():
    ladder = {"r": []}
    for k in range(40):
        up = ["r"] if k == 0 else [f"a{k - 1}", f"b{k - 1}"]
        ladder |= {f"a{k}": up, f"b{k}": up}
    lines = Graph(ladder).tree(most=100)
    assert 100 < len(lines) < 500 and any(x.endswith("(see above)") for x in lines)


def test_tree_text():
    lines = Graph({"a": [], "b": ["a"], "c": ["a", "b"]}).tree()
    assert lines == ["a", "├── b", "│   └── c", "└── c"]


def test_apply_hunks():
    base = "".join(f"line{i}\n" for i in range(1, 16))
    one, two = (1, 5, "@@ -1,5 +1,6 @@\n line1\n+new\n line2\n line3\n line4\n line5\n"), (10, 4, "@@ -10,4 +11,5 @@\n line10\n line11\n+late\n line12\n line13\n")
    assert apply_hunks(base, []) == base
    assert apply_hunks(base, [one]).splitlines() == ["line1", "new", *[f"line{i}" for i in range(2, 16)]]
    both = apply_hunks(base, [one, two]).splitlines()
    assert len(both) == 17 and both[12] == "late"
    assert apply_hunks("a", []) == "a\n" and apply_hunks("", []) == ""
    assert apply_hunks("x\n\ny\x0cz", []) == "x\n\ny\x0cz\n"


def test_options():
    assert O.PlanOptions(max_loc=400, max_refinement_iterations=1).min_loc == 100
    assert O.PlanOptions().min_loc is None
    for bad in ({"max_loc": 0}, {"min_loc": 0}, {"max_loc": 10, "min_loc": 10}, {"max_refinement_iterations": -1}, {"priority": "other"}):
        with pytest.raises(ValueError):
            O.PlanOptions(**bad)
    assert O.options_from({"WEFTLINE_MAX_LOC": "50", "WEFTLINE_DRAFT": "true", "OTHER": "x"}) == O.PlanOptions(max_loc=50, draft=True)
    with pytest.raises(O.PlanError):
        O.options_from({"WEFTLINE_MAX_LOC": "many"})
    assert O.PlanOptions().needs_chunking(900_000) and not O.PlanOptions().needs_chunking(800_000)


def test_values_are_those_of_arrow():
    import pyarrow as pa

    from weftline.operators import kernels

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.string()), ("c", pa.list_(pa.int64())), ("d", pa.struct([("e", pa.bool_()), ("f", pa.float64())])), ("g", pa.map_(pa.string(), pa.int32()))]))
    row = {"a": 1, "b": "x", "c": [1, 2], "d": {"e": True, "f": 0.5}, "g": [("k", 1)]}
    rows = [[row, row | {"a": None}], None, [], [None, row | {"b": None, "c": None}], [row | {"c": [None, 3], "d": None, "g": None}, row | {"d": {"e": None, "f": None}, "c": []}]]
    array = pa.array(rows, kind)
    for part in (array, array.slice(1), array.slice(3, 1), array.slice(0, 1), array.slice(2, 1)):
        assert kernels.values(part) == part.to_pylist()
