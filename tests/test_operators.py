from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftline.functions import paths, text
from weftline.operators import chunking, edit, graph, partition, score, stats, status, validate
from weftline.options import PlanError, PlanOptions
from weftline.plans import adapters
from weftline.sources import sinks

HUNK = "change_id string, file_ord int, file_path string, hunk_index int, added int, removed int"
UNRELATED = [("c", 0, "a.py", 0, 3, 0), ("c", 1, "b.py", 0, 4, 0)]


def scalar(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_paths(spark):
    L = F.lit
    for name, suffix in (("a.py", ".py"), (".bashrc", ""), ("foo.", ""), ("x.tar.gz", ".gz"), ("..b", ".b"), ("d/e", "")):
        assert scalar(spark, paths.suffix(L(name))) == suffix
    some = spark.createDataFrame([(n,) for n in ("a/b/test_x.py", "y", "/r/z_test.tar.gz", ".bashrc", "a//b/./c.py")], "p string")
    both = paths.add_features(some.withColumn("f", paths.features(F.col("p"))), F.col("p"), "g").collect()
    assert all(r["f"] == r["g"] for r in both)
    bonus = lambda a, b: scalar(spark, paths.test_pair_bonus(paths.features(L(a)), paths.features(L(b))))
    assert bonus("tests/test_auth.py", "src/auth.py") == 40 and bonus("src/auth_test.py", "src/auth.py") == 40
    assert bonus("latest.py", "late.py") == 0 and bonus("contest.py", "con.py") == 0
    depth = lambda a, b: scalar(spark, paths.shared_dir_depth(L(a), L(b)))
    assert (depth("a/b/c.py", "a/b/d.py"), depth("a/b/c", "a/x/c"), depth("c", "d"), depth("/a/b", "/a/c"), depth("a/b/a/x", "a/c/a/x")) == (2, 1, 0, 2, 1)
    near = lambda a, b, p: scalar(spark, paths.affinity(paths.features(L(a)), paths.features(L(b)), p))
    assert near("src/auth.py", "src/auth_test.py", "logical") == 85 and near("a.py", "b.py", "orthogonal") == 0 and near("a", "a", "logical") == 500
    assert scalar(spark, paths.split_namespace(L("#42"))) == "42" and scalar(spark, paths.split_namespace(L("me:fix/this one"))) == "fix-this-one"
    assert scalar(spark, paths.fork_ref(L("##12")))["pr_number"] == 12 and scalar(spark, paths.fork_ref(L("me:a:b")))["branch"] == "a:b" and scalar(spark, paths.fork_ref(L("dev"))) is None
    assert scalar(spark, paths.url_number(L("Creating\nhttps://x/pull/17\n"))) == 17


def test_texts(spark):
    assert scalar(spark, text.patch_sha(F.lit("p"), F.lit(""))) == scalar(spark, F.sha2(F.lit("p"), 256))
    assert scalar(spark, text.patch_sha(F.lit("p"), F.lit("given"))) == "given" and scalar(spark, text.patch_sha(F.lit(""), F.lit(""))) == ""
    assert "no hunks" in scalar(spark, text.file_summary(F.lit("a"), F.lit(0), F.lit(0), F.array().cast("array<string>"), F.lit(0)))
    assert scalar(spark, text.pr_body(F.lit("d"), F.lit(""), F.lit("s"), F.lit(None), F.lit("t"))) == "d\n\ns\n\nt"
    assert scalar(spark, text.pr_body(F.lit("d"), F.lit("f"), F.lit("s"), F.lit(""), F.lit("t"), "<{files}> {{x}} {tree}")) == "<f> {x} t"
    with pytest.raises(ValueError, match="available"):
        text.pr_body(*[F.lit("")] * 5, template="{nope}")


def test_units_and_chunks(spark):
    h = spark.createDataFrame([("c", 0, "f", i, n, 0) for i, n in enumerate((5, 6, 20, 1, 1))] + [("c", 1, "g", 0, 2, 0)], HUNK)
    units = rows(chunking.partition_units(h, 10), "position")
    assert [(u["unit_id"], u["loc"]) for u in units] == [("f:0-0", 5), ("f:1-1", 6), ("f:2-2", 20), ("f:3-4", 2), ("g:0-0", 2)]
    seq = spark.createDataFrame([("c", i, f, k, t) for i, (f, k, t) in enumerate((("a", 0, 30), ("b", 0, 60), ("b", 1, 40)))], "change_id string, seq int, file_path string, hunk_index int, token_estimate int")
    assert [r["chunk"] for r in rows(chunking.chunk(seq, 100, "greedy"), "seq")] == [0, 0, 1]
    assert [r["chunk"] for r in rows(chunking.chunk(seq, 100), "seq")] == [0, 1, 1]
    assert chunking.chunk(seq, 50).count() == 0 and "exceeds budget" in rows(chunking.oversize(seq, 50))[0]["detail"]


@pytest.mark.parametrize("seed", range(3))
def test_affinity_blocking(spark, seed):
    r = random.Random(seed)
    names = ["/".join(r.choices(["src", "lib", "x"], k=r.randint(0, 3)) + [r.choice(["", "test_"]) + r.choice(["a", "b"]) + r.choice(["", "_test"]) + r.choice([".py", ".md", ""])]) for _ in range(25)]
    units = spark.createDataFrame([("c", i, n, 1) for i, n in enumerate(names)], "change_id string, position int, file_path string, loc int")
    for priority in ("logical", "orthogonal"):
        got = {(p["a"], p["b"]): p["score"] for p in rows(partition.affinity_pairs(units, priority))}
        a, b = units.select("change_id", F.col("position").alias("a"), paths.features(F.col("file_path")).alias("x")), units.select("change_id", F.col("position").alias("b"), paths.features(F.col("file_path")).alias("y"))
        every = a.join(b, "change_id").filter("a < b").select("a", "b", paths.affinity(F.col("x"), F.col("y"), priority).alias("score")).filter("score > 0")
        assert got == {(p["a"], p["b"]): p["score"] for p in rows(every)}


@pytest.mark.parametrize("strategy", ["graph", "cp_sat"])
@pytest.mark.parametrize("case", [("orthogonal", UNRELATED, 10, None, 2), ("orthogonal", UNRELATED, 10, 5, 1), ("logical", [("c", 0, "src/auth.py", 0, 3, 0), ("c", 1, "src/auth_test.py", 0, 3, 0)], 10, None, 1), ("orthogonal", [("c", 0, "c.py", 0, 1, 0), ("c", 0, "c.py", 1, 1, 0)], 1, None, 2)])
def test_partition_matrix(spark, strategy, case):
    priority, data, most, least, count = case
    h = spark.createDataFrame(data, HUNK)
    options = PlanOptions(max_loc=most, min_loc=least, priority=priority, partition_strategy=strategy)
    groups = rows(partition.partition(h, options), "group_ord")
    assert len(groups) == count and sum(g["estimated_loc"] for g in groups) == sum(x[4] + x[5] for x in data)
    if data[0][2] == "c.py":
        assert groups[1]["depends_on"] == ["pr-1"] and {a["assignment_type"] for g in groups for a in g["assignments"]} == {"partial_hunks"}
    again = rows(partition.partition(h.repartition(3), options), "group_ord")
    assert again == groups
    files = stats.files_from_hunks(h)
    found = validate.violations(partition.partition(h, options), h, files, options)
    assert rows(found.filter("severity = 'error'")) == []


GROUP = "change_id string, group_ord int, group_id string, depends_on array<string>, assignments array<struct<file_path: string, assignment_type: string, hunk_indices: array<int>>>, estimated_loc int, estimated_added int, estimated_removed int"


def group(i, deps, assigned, loc):
    return ("c", i, f"g{i}", deps, [(f, t, h) for f, t, h in assigned], loc, loc, 0)


def rules(spark, groups, hunks=UNRELATED, **kw):
    h = spark.createDataFrame(hunks, HUNK)
    found = validate.violations(spark.createDataFrame(groups, GROUP), h, stats.files_from_hunks(h), PlanOptions(**kw))
    return sorted((r["severity"], r["rule"]) for r in rows(found))


def test_violations(spark):
    whole = [group(1, [], [("a.py", "whole_file", [0])], 3), group(2, [], [("b.py", "whole_file", [0])], 4)]
    assert rules(spark, whole) == [] and rules(spark, whole, max_loc=2) == [("warning", "above_max")] * 2
    assert rules(spark, whole, max_loc=10, min_loc=5, strict_loc_bounds=True) == [("error", "below_min")] * 2
    assert ("error", "coverage_gap") in rules(spark, whole[:1])
    assert ("error", "coverage_overlap") in rules(spark, [whole[0], group(2, [], [("a.py", "whole_file", [0]), ("b.py", "whole_file", [0])], 4)])
    assert rules(spark, [group(1, [], [("a.py", "whole_file", [])], 3), whole[1]]) == []
    assert ("error", "coverage_overlap") in rules(spark, [group(1, [], [("a.py", "whole_file", [])], 3), group(2, [], [("a.py", "partial_hunks", [0]), ("b.py", "whole_file", [0])], 4)])
    assert ("error", "loc_mismatch") in rules(spark, [group(1, [], whole[0][4], 5), group(2, [], whole[1][4], 5)])
    both = lambda deps: [group(1, [], [("a.py", "partial_hunks", [0])], 3), group(2, deps, [("a.py", "partial_hunks", [0])], 4)]
    assert ("error", "conflict") in rules(spark, both([])) and ("error", "conflict") not in rules(spark, both(["g1"]))
    assert ("error", "cycle") in rules(spark, [group(1, ["g2"], whole[0][4], 3), group(2, ["g1"], whole[1][4], 4)])
    assert ("error", "unknown_dependency") in rules(spark, [group(1, ["zz"], whole[0][4], 3), whole[1]])
    with pytest.raises(PlanError):
        validate.raise_on_errors(validate.coverage_gap(spark.createDataFrame([], "change_id string, file_path string, hunk_index int"), spark.createDataFrame(UNRELATED, HUNK)).selectExpr("change_id", "'error' severity", "1 priority", "'gap' rule", "file_path detail"))


@pytest.mark.parametrize("groups,most,least,want", [
    ([group(1, [], [("a", "whole_file", [0])], 120), group(2, ["g1"], [("b", "whole_file", [0])], 80)], 100, None, 20030),
    ([group(1, [], [("s", "partial_hunks", [0])], 40), group(2, [], [("s", "partial_hunks", [1])], 30)], 100, None, 53),
    ([group(1, [], [("a", "whole_file", [0])], 10), group(2, [], [("b", "whole_file", [0])], 90)], 100, None, 13),
    ([group(1, [], [("a", "whole_file", [0])], 20), group(2, [], [("b", "whole_file", [0])], 90)], 100, 50, 30113),
])
def test_objective(spark, groups, most, least, want):
    df = spark.createDataFrame(groups, GROUP)
    assert rows(score.plan_metrics(df, graph.assigned(df), most, least))[0]["objective"] == want


def test_edits(spark):
    keys = "change_id string, file_path string, hunk_index int"
    hunks = spark.createDataFrame([("c", "a.py", i) for i in range(3)] + [("c", "b.py", 0)], keys)
    assigned = spark.createDataFrame([("c", "a.py", 0, "g1"), ("c", "a.py", 1, "g1"), ("c", "b.py", 0, "g2")], keys + ", group_id string")
    groups = spark.createDataFrame([("c", "g1"), ("c", "g2"), ("c", "g3")], "change_id string, group_id string")
    edits = spark.createDataFrame([("c", "a.py", 1, "g1", "g3"), ("c", "a.py", 0, "g1", "g1"), ("c", "a.py", 0, "g1", "zz"), ("c", "a.py", 99, "g1", "g2"), ("c", "a.py", 2, "g1", "g2")], keys + ", from_id string, to_id string")
    after, told = edit.move_hunks(assigned, edits, groups, hunks)
    assert {(r["file_path"], r["hunk_index"]): r["group_id"] for r in rows(after)} == {("a.py", 0): "g1", ("a.py", 1): "g3", ("b.py", 0): "g2"}
    assert [r["applied"] for r in rows(told, "hunk_index", "to_id")].count(True) == 1
    ordered = assigned.withColumn("group_ord", F.substring("group_id", 2, 1).cast("int"))
    assert [(r["file_path"], r["hunk_index"], r["group_id"]) for r in rows(edit.assign_uncovered(ordered, hunks))] == [("a.py", 2, "g1")]


def test_chain_merge_and_stack(spark):
    own = spark.createDataFrame([("c", "child", "shared", "partial_hunks", [1]), ("c", "child", "own", "whole_file", [0]), ("c", "parent", "shared", "partial_hunks", [0]), ("c", "parent", "parent_only", "whole_file", [0])], "change_id string, group_id string, file_path string, assignment_type string, hunk_indices array<int>")
    up = own.filter("group_id = 'parent'").withColumn("group_id", F.lit("child")).select("change_id", "group_id", "file_path", "hunk_indices")
    mine = own.filter("group_id = 'child'")
    assert {r["file_path"]: r["hunk_indices"] for r in rows(edit.merge_chain(mine, up))} == {"shared": [0, 1], "own": [0]}
    assert {r["file_path"]: r["hunk_indices"] for r in rows(edit.merge_chain(mine, up, True))} == {"shared": [0, 1], "own": [0], "parent_only": [0]}
    groups = spark.createDataFrame([("c", 0, "parent", []), ("c", 1, "child", ["parent"])], "change_id string, group_ord int, group_id string, depends_on array<string>")
    stack = {r["group_id"]: r for r in rows(edit.stacked_schedule(groups, own))}
    assert stack["child"]["base_branch"] == "parent" and stack["parent"]["base_branch"] == "main"
    assert {a["file_path"]: a["hunk_indices"] for a in stack["child"]["assignments"]} == {"shared": [0, 1], "own": [0]}


def test_upsert(spark):
    kind = "change_id string, group_ord int, group_id string, title string, depends_on array<string>, assignments array<struct<file_path: string>>"
    a = spark.createDataFrame([("c", 0, "g1", "old", ["x"], [("a",)])], kind)
    b = spark.createDataFrame([("c", 0, "g1", "new", ["y", "x"], [("b",)]), ("c", 1, "g2", "two", [], [("d",)])], kind)
    got = rows(edit.upsert_groups(a, b), "group_ord")
    assert got[0]["title"] == "old" and got[0]["depends_on"] == ["x", "y"] and [x["file_path"] for x in got[0]["assignments"]] == ["a", "b"]
    assert got[1]["group_id"] == "g2" and got[1]["group_ord"] == 2


def test_merge_walk(spark):
    groups = spark.createDataFrame([("c", i, f"g{i}", d) for i, d in enumerate(([], ["g0"], ["g1"], []))], "change_id string, group_ord int, group_id string, depends_on array<string>")
    prs = spark.createDataFrame([("c", "g0", 1), ("c", "g1", 2), ("c", "g2", 3)], "change_id string, group_id string, pr_number int")
    live = spark.createDataFrame([(1, "OPEN", None, False), (2, "OPEN", "APPROVED", False), (3, "OPEN", "REVIEW_REQUIRED", False)], "pr_number int, state string, review_decision string, is_draft boolean")
    walk = status.merge_walk(groups, prs, live, prs.filter("pr_number = 2"))
    assert [r["outcome"] for r in rows(walk, "group_id")] == ["merge", "failed", "not reached", "skip: no pull request"]
    told = rows(status.merge_summary(walk))[0]
    assert told["failed"] == ["g1"] and not told["success"]
    assert rows(status.merge_walk(groups, prs, live), "group_id")[2]["outcome"] == "skip: review required"


def test_sinks(spark):
    groups = spark.createDataFrame([("c", 0, "pr-1", "a|b", 1200)], "change_id string, group_ord int, id string, title string, estimated_loc int")
    scores = spark.createDataFrame([("c", 3, 1200, 1, 50, True)], "change_id string, total_files long, total_loc long, total_groups long, objective long, should_split boolean")
    body = rows(sinks.score_comment(groups, scores))[0]["body"]
    assert "a\\|b" in body and "1,200" in body
    old = spark.createDataFrame([("c", 7, "x <!-- m -->"), ("c", 5, "<!-- m -->")], "change_id string, comment_id int, body string")
    new = spark.createDataFrame([("c", "n"), ("d", "n")], "change_id string, body string")
    got = {r["change_id"]: (r["action"], r["comment_id"]) for r in rows(sinks.upsert_comments(new, old, "<!-- m -->"))}
    assert got == {"c": ("update", 5), "d": ("create", None)}
    assert rows(sinks.action_outputs(spark.createDataFrame([("a", 1)], "name string, value int")))[0]["value"] == "a=1"


def test_stream_of_states(spark, tmp_path):
    import datetime

    from weftline.streaming.poll import terminal_states

    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("k", "OPEN", t), ("k", "MERGED", t), ("k", "MERGED", t), ("j", "OPEN", t)], "key string, state string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, state string, ts timestamp").parquet(str(tmp_path / "in"))
    q = terminal_states(stream, "key", "state", "ts", ["MERGED", "CLOSED"]).writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select key, state from polled").collect() == [("k", "MERGED")]


def test_order_units_are_line_items(spark, tmp_path):
    items = [(1, k, k, 6 * (k % 2), 5.0, "2020-01-01", 1.0) for k in range(12)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate string, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(r["position"] for r in adapters.order_units(spark, str(tmp_path)).collect()) == list(range(12))
