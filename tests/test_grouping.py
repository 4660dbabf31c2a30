from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tests import brute_groups
from tests.conftest import rows
from weftline import options as O
from weftline.operators import grouping, partition
from weftline.functions import paths
from weftline.operators.grouping import Units, affinity, terms
from weftline.operators.grouping import file_of as file


def options(**kw):
    return O.PlanOptions(**{"max_loc": 10, "priority": "orthogonal"} | kw)


def random_units(seed, most=30, kinds=14):
    r = random.Random(seed)
    dirs = ["a", "a/b", "a/b/c", "d", "d/e", "", "x/y/z"] if seed % 5 else ["/".join(f"p{d}" for d in range(n)) for n in (0, 3, 18, 19, 20, 21, 24)]
    names = ["/".join(filter(None, [r.choice(dirs), r.choice(("", "", "test_")) + r.choice("uvwxyz") + r.choice(("", "_test")) + r.choice((".py", ".md", ""))])) for _ in range(kinds)]
    known = {n: file(n) for n in names}
    files = [known[r.choice(names)] for _ in range(r.randint(1, most))]
    locs = [r.choice((0, 1, 2, 3, 3, 5, 8, 9, 15)) for _ in files]
    o = options(max_loc=r.choice((5, 10, 20, 60)), min_loc=r.choice((None, 2, 4)), priority=r.choice(list(O.Priority)))
    edges = [(a, b, affinity(files[a], files[b], o.priority)) for a in range(len(files)) for b in range(a + 1, len(files))]
    return Units(files, locs, o), brute_groups.Units([f.path for f in files], locs, [e for e in edges if e[2]], o)


def test_grow_and_repair_fixtures():
    two = Units([file("a.py"), file("b.md")], [3, 4], options())
    assert two.grow() == [[1], [0]]
    low = Units([file("a.py"), file("b.md")], [3, 4], options(min_loc=5))
    assert low.repair(low.grow()) == [[0, 1]]
    near = Units([file("src/auth.py"), file("src/auth_test.py")], [3, 3], options(priority="logical"))
    assert near.grow() == [[0, 1]]
    same = Units([file("c.py")] * 2, [1, 1], options(max_loc=1))
    assert same.grow() == [[0], [1]]
    assert Units([], [], options()).grow() == [] and Units([], [], options(min_loc=1)).repair([]) == []


@pytest.mark.parametrize("seed", range(400))
def test_greedy_groups_against_all_pairs(seed):
    units, brute = random_units(seed)
    grown, repaired = brute.grow(), brute.repair(brute.grow())
    assert units.grow() == grown and units.repair(grown) == repaired
    units.near = None  # as for a large change
    assert units.grow() == grown and units.repair(grown) == repaired


@pytest.mark.parametrize("seed", range(40))
def test_terms_add_up_to_the_affinity(seed):
    units, _ = random_units(seed)
    for priority in O.Priority:
        for x in units.files:
            for y in units.files:
                own = {t[0] for t in terms(y, priority)}
                assert sum(w for _, asked, w in terms(x, priority) if asked in own) == affinity(x, y, priority)


def test_many_units_in_seconds():
    r = random.Random(3)
    kinds = [file(f"s{r.randint(0, 9)}/m{r.randint(0, 30)}/{'test_' * (k % 3 == 0)}n{r.randint(0, 2000)}x{k % 2}{r.choice(('.py', '.md'))}") for k in range(4000)]
    units = Units([r.choice(kinds) for _ in range(20_000)], [r.randint(1, 50) for _ in range(20_000)], options(max_loc=120, min_loc=30))
    began = time.time()
    groups = units.repair(units.grow())
    assert time.time() - began < 60  # 5 on the machine this was written on; all pairs of units would be 2 * 10 ** 8
    assert sorted(u for g in groups for u in g) == list(range(20_000)) and all(units.load(g) <= 120 for g in groups)


@pytest.mark.parametrize("seed", range(60))
def test_exact_against_all_partitions(seed):
    units, brute = random_units(seed, 8, 5)
    want = brute.cost(brute.exact())
    groups, cost, bound = units.exact(0)
    assert cost == bound == units.cost(groups) == brute.cost(groups) == want and groups == sorted(groups)
    search = grouping._Search(units)
    groups, cost, bound = search.run(10**6)
    assert cost == bound == units.cost(groups) == want and sorted(u for g in groups for u in g) == list(range(len(units.locs)))
    assert search.run(2)[2] <= want <= search.run(2)[1]


def test_subsets_beyond_the_table():
    r = random.Random(1)
    kinds = [file(n) for n in ("a/x.py", "a/test_x.py", "b/y.md", "c.py")]
    units = Units([r.choice(kinds) for _ in range(14)], [r.randint(1, 20) for _ in range(14)], options(max_loc=40, min_loc=10))
    _, cost, bound = units.exact(0)
    assert cost == bound == grouping._Search(units).run(10**5)[1]


@pytest.mark.parametrize("priority", list(O.Priority))
def test_large_changes_have_a_proven_gap(priority):
    r = random.Random(5)
    kinds = [file(f"s{r.randint(0, 4)}/m{r.randint(0, 6)}/n{k}.py") for k in range(40)]
    units = Units([r.choice(kinds) for _ in range(200)], [r.randint(1, 50) for _ in range(200)], options(max_loc=120, min_loc=30, priority=priority))
    groups, cost, bound = units.exact(20)
    assert bound <= cost == units.cost(groups) and sorted(u for g in groups for u in g) == list(range(200))
    assert cost <= units.cost(units.repair(units.grow()))
    assert units.exact(200)[2] >= bound


def test_files_are_those_of_the_column_functions(spark):
    names = ["a.py", "/a/b/test_x.tar.gz", "x", "", "/", "./a//b/./c_test.py", ".env", "d/.env", "a.", "test_", "test__test", "d.e/f", "a/b.c/..", "tests/test_test_a_test.md"]
    made = paths.add_features(spark.createDataFrame([(n,) for n in names], "n string"), F.col("n"), "f").select("f.*")
    for r in made.collect():
        assert (r["path"], tuple(r["heads"]), r["suffix"], r["stem"], r["is_test"]) == tuple(file(r["path"])), r


UNIT = "change_id long, position int, file_path string, loc long"


def test_exact_groups_as_rows(spark):
    sizes = {1: 3, 2: 12, 3: 25}
    units = spark.createDataFrame([(c, p, f"d{p % 2}/f{p % 5}.py", 10 + p) for c, n in sizes.items() for p in range(n)], UNIT)
    exact = options(max_loc=60, min_loc=10, priority="logical", partition_strategy="cp_sat")
    got = rows(partition.exact_groups(units, exact))
    assert {c: sum(r["change_id"] == c for r in got) for c in sizes} == sizes
    assert all(r["bound"] <= r["cost"] and r["group_ord"] is not None for r in got) and all(r["bound"] == r["cost"] for r in got if r["change_id"] < 3)
    assert rows(partition.group_units(units, exact), "change_id", "position") == [{k: r[k] for k in ("change_id", "position", "group_ord")} for r in rows(partition.exact_groups(units, exact), "change_id", "position")]


@pytest.mark.parametrize("priority", list(O.Priority))
def test_sums_of_classes_against_pairs(spark, priority):
    made = [(seed, p, f.path, 1) for seed in range(40) for p, f in enumerate(random_units(seed)[0].files)]
    units = spark.createDataFrame(made, UNIT)
    pairs = partition.affinity_pairs(units, priority)
    want = pairs.groupBy("change_id").agg(F.count("*").alias("pairs"), F.sum("score").alias("score"), F.sum(F.col("score") * F.col("a")).alias("first"), F.sum(F.col("score") * F.col("b")).alias("second"))
    assert rows(partition.affinity_sums(units, priority).drop("priority"), "change_id") == rows(want, "change_id")
