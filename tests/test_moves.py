"""Rows of line size move once, by change, instead of being joined hunk by hunk."""

from __future__ import annotations

import json

from tests.conftest import rows
from weftline.operators import edit, graph, partition, planning, validate

HUNKS = [("c", "a", 0, 3, 0), ("c", "a", 1, 10, 2), ("c", "b", 0, 0, 4), ("e", "a", 0, 7, 7)]
ASSIGNMENTS = "array<struct<file_path: string, assignment_type: string, hunk_indices: array<int>>>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def hunk_table(spark):
    return spark.createDataFrame(HUNKS, "change_id string, file_path string, hunk_index int, added int, removed int")


def test_uncovered_hunks_are_placed_without_moves_by_hunk(spark):
    listed = [("c", 0, "g1", [("a", "partial_hunks", [0, 5])]), ("c", 1, "g2", [("x", "partial_hunks", []), ("y", "partial_hunks", [])]), ("c", 2, None, [])]
    groups = spark.createDataFrame(listed, f"change_id string, group_ord int, group_id string, assignments {ASSIGNMENTS}")
    made = planning.with_uncovered(groups, hunk_table(spark))
    assert "hunk_index" not in "".join(x for x in plan(made).split("\n") if "hashpartitioning" in x)
    got = {r["group_id"]: ({a["file_path"]: a["hunk_indices"] for a in r["assignments"]}, r["estimated_added"], r["estimated_removed"], r["estimated_loc"]) for r in rows(made)}
    assert got == {"g1": ({"a": [0, 5, 1]}, 13, 2, 15), "g2": ({"x": [], "y": [], "b": [0]}, 0, 4, 4)}


def test_versions_of_a_plan_share_hunks_and_equal_ids_stay_single(spark):
    group = lambda hunks: {"id": "g", "title": "t", "description": "", "depends_on": [], "assignments": [{"file_path": "a", "assignment_type": "partial_hunks", "hunk_indices": hunks}], "estimated_loc": 0}
    said = [("c", 1, 1, "no JSON"), ("c", 1, 2, json.dumps({"groups": [group([0]), group([1])]})), ("c", 2, 1, json.dumps({"groups": [group([1, 7])]})), ("e", 1, 1, "{}")]
    groups, good, failed = planning.accepted(spark.createDataFrame(said, "change_id string, iteration int, attempt int, payload_json string"), "iteration", 2)
    assert [(r["change_id"], r["iteration"]) for r in rows(good, "iteration")] == [("c", 1), ("c", 2)] and [r["change_id"] for r in rows(failed)] == ["e"]
    made = planning.recounted(groups.withColumnRenamed("id", "group_id"), hunk_table(spark), "iteration")
    assert "hunk_index" not in "".join(x for x in plan(made).split("\n") if "hashpartitioning" in x)
    assert [(r["iteration"], r["group_ord"], r["estimated_loc"]) for r in rows(made, "iteration", "group_ord")] == [(1, 0, 15), (1, 1, 15), (2, 0, 12)]


def test_groups_from_units_move_once_and_leave_unknown_files_out(spark):
    units = spark.createDataFrame([("c", 0, 0, "a", [0]), ("c", 1, 1, "a", [1]), ("c", 2, 1, "b", [0]), ("c", 3, 2, "gone", [0])], "change_id string, position int, group_ord int, file_path string, hunk_indices array<int>")
    both = [partition.groups_from_units(units, None, hunk_table(spark), "graph"), partition.groups_from_units(units.select("change_id", "position", "group_ord"), units.drop("group_ord"), hunk_table(spark), "graph")]
    assert "hunk_index," not in "".join(x for x in plan(both[0]).split("\n") if "hashpartitioning" in x)
    for made in both:
        got = [(r["group_id"], [(a["file_path"], a["assignment_type"], a["hunk_indices"]) for a in r["assignments"]], r["estimated_added"], r["estimated_loc"], r["depends_on"]) for r in rows(made, "group_id")]
        assert got == [("pr-1", [("a", "partial_hunks", [0])], 3, 3, []), ("pr-2", [("a", "partial_hunks", [1]), ("b", "whole_file", [0])], 10, 16, ["pr-1"])]


def test_edits_of_a_hunk_are_folded_where_it_is(spark):
    keys = "change_id string, file_path string, hunk_index int"
    assigned = spark.createDataFrame([("c", "a", 0, "g1"), ("c", "a", 1, "g1"), ("c", "b", 0, "g2")], f"{keys}, group_id string")
    groups = spark.createDataFrame([("c", "g1"), ("c", "g2"), ("c", "g3")], "change_id string, group_id string")
    said = [("c", "a", 0, 1, "g1", "g2"), ("c", "a", 0, 2, "g2", "g3"), ("c", "a", 1, 3, "g2", "g3"), ("c", "b", 0, 4, "g2", "none"), ("c", "z", 0, 5, "g1", "g2")]
    edits = spark.createDataFrame(said, f"{keys}, seq int, from_id string, to_id string")
    for hunks in (None, assigned, hunk_table(spark)):
        made = edit.edited(assigned, edits, groups, hunks)
        assert "hunk_index" not in "".join(x for x in plan(made).split("\n") if "hashpartitioning" in x)
        assert [(r["file_path"], r["hunk_index"], r["held"], r["done"]) for r in rows(made, "file_path", "hunk_index")] == [("a", 0, ["g3"], [1, 2]), ("a", 1, ["g1"], []), ("b", 0, ["g2"], [])]
    assert rows(edit.edited(assigned, edits, groups, hunk_table(spark).limit(0)).filter("size(done) > 0")) == []


def test_conflicts_are_found_without_joining_hunks_with_themselves(spark):
    held = [("c", "a", 0, g) for g in ("g3", "g1", "g2", "g1")] + [("c", "a", 1, "g1"), ("c", None, 0, "g1"), ("c", None, 0, "g2"), ("e", "a", 0, "g1")]
    assigned = spark.createDataFrame(held, "change_id string, file_path string, hunk_index int, group_id string")
    groups = spark.createDataFrame([("c", "g1", []), ("c", "g2", ["g1"]), ("c", "g3", []), ("e", "g1", [])], "change_id string, group_id string, depends_on array<string>")
    made = validate.conflicts(assigned, groups)
    assert "hunk_index" not in "".join(x for x in plan(made).split("\n") if "hashpartitioning" in x)
    assert [tuple(r.values()) for r in rows(made, "a", "b")] == [("c", "a", 0, "g1", "g3"), ("c", "a", 0, "g2", "g3")]


def test_chain_merged_file_by_file_is_the_chain_merged_by_joins(spark):
    groups = spark.createDataFrame([("c", "g1", []), ("c", "g2", ["g1"]), ("c", "g3", ["g2"]), ("c", "g4", []), ("e", "g1", ["g2"])], "change_id string, group_id string, depends_on array<string>")
    held = [("c", "g1", "a", "partial_hunks", [0]), ("c", "g2", "b", "partial_hunks", [1]), ("c", "g3", "a", "partial_hunks", [3, 0]), ("c", "g3", "b", "whole_file", [0]), ("c", "g4", "a", None, None), ("e", "g1", "a", "partial_hunks", [2])]
    own = spark.createDataFrame(held, "change_id string, group_id string, file_path string, assignment_type string, hunk_indices array<int>")
    up = graph.closure(groups).join(own.withColumnRenamed("group_id", "ancestor_id"), ["change_id", "ancestor_id"]).select("change_id", "group_id", "file_path", "hunk_indices")
    order = ("change_id", "group_id", "file_path")
    made = rows(edit.merge_own_chain(groups, own), *order)
    assert made == rows(edit.merge_chain(own, up), *order)
    assert {(r["group_id"], r["file_path"]): r["hunk_indices"] for r in made if r["change_id"] == "c"}[("g3", "a")] == [0, 3]
