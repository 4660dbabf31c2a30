"""Pushes and pull requests by change, against closures of bases, and how often rows move."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftline.operators import actions, graph
from weftline.operators.kernels import Graph


def _want(base, pushed):
    g = Graph({n: [b] for n, b in base.items()})
    return {n: all(pushed[a] for a in g.ancestors(n)) for n in base}


@pytest.mark.parametrize("seed", range(20))
def test_bases_are_free_as_their_closure_says(seed):
    r = random.Random(seed)
    for _ in range(100):
        names = list(range(r.randint(1, 9)))
        base = {n: r.choice([*names, "main"]) if r.random() < 0.5 else (n // 2 if n else "main") for n in r.sample(names, len(names))}
        pushed = {n: r.random() < 0.7 for n in names}
        assert graph._bases_free(base, pushed) == _want(base, pushed)


def _shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning|RepartitionByExpression|Exchange rangepartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_pulls_of_many_changes_move_once(spark):
    r = random.Random(4)
    groups, branches, done = [], [], []
    for c in range(40):
        ids = [f"g{k}" for k in range(r.randint(1, 7))]
        for k, g in enumerate(ids):
            ups = sorted(r.sample(ids[:k], min(k, r.choice((0, 1, 1, 2)))))
            groups.append((c, g, k, [*ups, g] if r.random() < 0.05 else ups, f"title {g}"))
    table = spark.createDataFrame(groups, "change_id long, group_id string, group_ord int, depends_on array<string>, title string")
    frame = actions.branches(table, F.col("change_id").cast("string"), stacked=True)
    assert _shuffles(frame) == 1
    made = rows(frame)
    order = {(x["change_id"], x["group_id"]): x["place"] for x in rows(graph.topological_order(table))}
    assert {(x["change_id"], x["group_id"]): x["place"] for x in made} == order and len(made) < len(groups)
    done = [(x["change_id"], x["branch_name"]) for x in made if r.random() < 0.6] + [(0, "unknown")]
    lost = {("g0", c) for c in range(0, 40, 5)}
    titled, bodies = table.filter("not (group_id = 'g0' and change_id % 5 = 0)"), table.filter("change_id % 2 = 0").select("change_id", "group_id", F.concat(F.lit("b"), "group_id").alias("body"))
    stored = spark.createDataFrame(made, frame.schema)
    for pushed, known in ((spark.createDataFrame(done, "change_id long, branch_name string"), set(done)), (None, {(x["change_id"], x["branch_name"]) for x in made})):
        acts = actions.pulls(stored, titled, bodies, pushed, draft=True)
        assert _shuffles(acts) == 1, acts._jdf.queryExecution().executedPlan().toString()  # eight and more before
        want = set()
        for c in range(40):
            own = [x for x in made if x["change_id"] == c]
            free = _want({x["branch_name"]: x["base_branch"] for x in own}, {x["branch_name"]: (c, x["branch_name"]) in known for x in own})
            for x in own:
                g, head = x["group_id"], x["branch_name"]
                want.add((c, g, x["place"], "push", head, None, None, None, None))
                if (g, c) not in lost:
                    said = "create" if free[head] and (c, head) in known else "skip: branch or base not pushed"
                    want.add((c, g, x["place"], said, head, x["base_branch"], f"title {g}", None if c % 2 else f"b{g}", True))
        got = [tuple(x.values()) for x in rows(acts)]
        assert set(got) == want and len(got) == len(want)


def test_null_changes_and_branches_have_pushes_only(spark):
    made = spark.createDataFrame([(None, "g", 0, "b", "main"), (1, None, 0, "x", "main"), (1, "h", 1, "y", "x")], "change_id long, group_id string, place int, branch_name string, base_branch string")
    groups = spark.createDataFrame([(None, "g", "t"), (1, None, "t"), (1, "h", "t")], "change_id long, group_id string, title string")
    acts = actions.pulls(made, groups, groups.select("change_id", "group_id", F.col("title").alias("body")), made)
    assert sorted((x["action"], x["head"]) for x in rows(acts)) == [("create", "y"), ("push", "b"), ("push", "x"), ("push", "y")]
    free = graph.base_pushed(made.withColumn("pushed", F.col("branch_name") != "x"))
    assert sorted(x["branch_name"] for x in rows(free)) == ["b", "x"]
