from __future__ import annotations

import random

from tests.conftest import rows
from weftline.operators import edit, stats
from weftline.sources import diffs, documents

NEW = "diff --git a/a.py b/a.py\nnew file mode 100644\n--- /dev/null\n+++ b/a.py\n@@ -0,0 +1,3 @@\n+x = 1\n+\n+y = 2\n"
TWO = "diff --git a/c.py b/c.py\n--- a/c.py\n+++ b/c.py\n@@ -1,3 +1,4 @@ def f():\n one\n+two\n three\n four\n@@ -10,3 +11,4 @@\n ten\n--- dash\n++++ plus\n+more\n twelve\n"
OTHER = "diff --git a/old name.py b/new name.py\nsimilarity index 100%\nrename from old name.py\nrename to new name.py\ndiff --git a/gone.py b/gone.py\ndeleted file mode 100644\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-bye\n\\ No newline at end of file\n"


def parsed(spark, *texts):
    return diffs.parse_diffs(spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "change_id string, raw_diff string"))


def test_files_and_hunks(spark):
    p = parsed(spark, NEW + TWO, OTHER, "", None)
    files = rows(diffs.files_of(p), "change_id", "file_ord")
    assert [(f["file_path"], f["added"], f["removed"], f["is_new"], f["is_deleted"], f["is_renamed"], f["hunk_count"]) for f in files] == [
        ("a.py", 3, 0, True, False, False, 1), ("c.py", 3, 1, False, False, False, 2), ("new name.py", 0, 0, False, False, True, 0), ("gone.py", 0, 1, False, True, False, 1),
    ]
    hunks = rows(diffs.hunks_of(p), "change_id", "file_ord", "hunk_index")
    assert [(h["hunk_index"], h["source_start"], h["source_length"]) for h in hunks] == [(0, 0, 0), (0, 1, 3), (1, 10, 3), (0, 1, 1)]
    assert hunks[1]["hunk_text"].startswith("@@ -1,3 +1,4 @@ def f():\n one\n")
    lines = rows(diffs.lines_of(diffs.hunks_of(p)), "change_id", "file_path", "hunk_index", "line_no")
    assert [x["text"] for x in lines if x["kind"] == "removed"] == ["-- dash", "bye"]


def test_errors(spark):
    p = parsed(spark, "@@ -1 +1 @@\n-a\n+b\n", NEW, "--- a/x\n+++ b/x\n@@ -1,5 +1,5 @@\n a\n")
    assert [r["change_id"] for r in rows(diffs.errors_of(p), "change_id")] == ["c0", "c2"]
    assert diffs.files_of(p).count() == 1


def test_plain_patch_and_stats(spark):
    p = parsed(spark, "--- a/e.py\n+++ b/e.py\n@@ -1,2 +1,3 @@\n a\n+b\n c\n--- a/f.py\n+++ b/f.py\n@@ -1 +1 @@\n-a\n+b\n")
    s = rows(stats.diff_stats(diffs.files_of(p)))[0]
    assert (s["total_files"], s["total_added"], s["total_removed"], s["total_loc"]) == (2, 2, 1, 3)
    text = rows(stats.labelled_diff(diffs.files_of(p), diffs.hunks_of(p)))[0]["text"]
    assert text.startswith("--- a/e.py\n+++ b/e.py\n[hunk_index=0]\n@@ -1,2") and text.count("[hunk_index=0]") == 2


def test_materialize(spark):
    p = parsed(spark, NEW + TWO + OTHER)
    files, hunks = diffs.files_of(p), diffs.hunks_of(p)
    base = spark.createDataFrame([("c0", "c.py", "one\nthree\nfour\n" + "x\n" * 6 + "ten\n-- dash\ntwelve\n"), ("c0", "gone.py", "bye")], "change_id string, file_path string, content string")
    some = spark.createDataFrame([("c0", "pr-1", "a.py", 0), ("c0", "pr-1", "c.py", 1), ("c0", "pr-1", "gone.py", 0), ("c0", "pr-1", "unknown", 0)], "change_id string, group_id string, file_path string, hunk_index int")
    got = {r["file_path"]: r["content"] for r in rows(edit.materialize(some, files, hunks, base))}
    assert got == {"a.py": "x = 1\n\ny = 2\n", "c.py": "one\nthree\nfour\n" + "x\n" * 6 + "ten\n+++ plus\nmore\ntwelve\n", "gone.py": None}


def test_random_edits_round_trip(spark):
    import difflib

    r, changes, base = random.Random(4), [], []
    wanted = {}
    for k in range(30):
        old = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 40))]
        new = [x if r.random() > 0.2 else r.choice(("-- z", "++ q", "@@ -1 +1 @@", "")) for x in old if r.random() > 0.1] or ["only"]
        text = "".join(difflib.unified_diff([x + "\n" for x in old], [x + "\n" for x in new], "a/f", "b/f"))
        changes.append((f"c{k}", text))
        base.append((f"c{k}", "f", "".join(x + "\n" for x in old)))
        if text:
            wanted[f"c{k}"] = "".join(x + "\n" for x in new)
    p = diffs.parse_diffs(spark.createDataFrame(changes, "change_id string, raw_diff string"))
    hunks = diffs.hunks_of(p)
    from pyspark.sql import functions as F

    made = edit.materialize(hunks.select("change_id", F.lit("g").alias("group_id"), "file_path", "hunk_index"), diffs.files_of(p), hunks, spark.createDataFrame(base, "change_id string, file_path string, content string"))
    assert {r["change_id"]: r["content"] for r in rows(made)} == wanted


def test_numstat_and_status(spark):
    lines = spark.createDataFrame([("3\t1\ta.py",), ("-\t-\tpic.png",), ("short",)], "value string")
    assert [(r["file_path"], r["added"], r["removed"]) for r in rows(documents.numstat_lines(lines), "file_path")] == [("a.py", 3, 1), ("pic.png", 0, 0)]
    clean = lambda *x: rows(documents.worktree_clean(spark.createDataFrame([(v,) for v in x], "value string")))[0]["clean"]
    assert clean("?? a", "?? b") and clean() and not clean("?? a", " M b")


def test_model_groups(spark):
    good = '{"groups": [{"id": "pr-1", "title": "t", "description": "d", "depends_on": [], "assignments": [{"file_path": "a.py", "assignment_type": "whole_file", "hunk_indices": []}], "estimated_loc": 3}]}'
    data = spark.createDataFrame([("c0", good), ("c1", '{"plan": 1}'), ("c2", good.replace("whole_file", "half")), ("c3", "no json"), ("c4", '{"groups": {}}')], "change_id string, payload_json string")
    groups, errors = documents.model_groups(data)
    assert [(g["change_id"], g["id"]) for g in rows(groups)] == [("c0", "pr-1")]
    told = {e["change_id"]: e["error"] for e in rows(errors)}
    assert sorted(told) == ["c1", "c2", "c3", "c4"] and "plan" in told["c1"]


def test_plan_round_trip(spark, tmp_path):
    import pytest

    from weftline import schemas
    from weftline.options import PlanError
    from weftline.sources import sinks

    plan = {"plan": {"dev_branch": "dev", "base_branch": "main", "max_loc": 400, "groups": [{"id": "pr-1", "title": "t", "depends_on": [], "assignments": [{"file_path": "a", "assignment_type": "whole_file", "hunk_indices": [0]}], "estimated_loc": 1}]}, "git_state": {"branches": [], "prs": []}}
    import json

    df = spark.read.schema(schemas.PLAN).json(spark.sparkContext.parallelize([json.dumps(plan)]))
    sinks.write_plan(df, str(tmp_path / "plan"))
    again = documents.read_plan(spark, str(tmp_path / "plan"))
    from pyspark.sql import functions as F

    group = rows(documents.plan_groups(again, F.lit("c")))[0]
    assert group["id"] == "pr-1" and group["assignments"][0]["hunk_indices"] == [0]
    with pytest.raises(PlanError):
        documents.read_plan(spark, str(tmp_path / "none"))


def test_forks_and_live(spark):
    ok = '{"head": {"ref": "b", "repo": {"fork": true, "clone_url": "u", "owner": {"login": "me"}}}, "base": {"ref": "main"}}'
    got = rows(documents.fork_pulls(spark.createDataFrame([(1, ok), (2, '{"head": {"repo": null}}'), (3, None)], "pr_number int, json string")), "pr_number")
    assert got[0]["error"] is None and got[0]["user"] == "me" and got[1]["error"] and got[2]["error"]
    live = rows(documents.live_states(spark.createDataFrame([(1, '{"state": "OPEN", "isDraft": true}'), (2, "broken")], "pr_number int, json string")), "pr_number")
    assert live[0]["state"] == "OPEN" and live[0]["is_draft"] and live[1]["state"] is None


def _random_diff(r, files):
    out = r.choice(("", "From: someone\nan introduction\n\n"))
    for k in range(files):
        name, n = f"d{r.randint(0, 3)}/f {k}.py", r.randint(0, 3)
        out += f"diff --git a/{name} b/{name}\n" + (f"--- a/{name}\n+++ b/{name}\n" if n else "old mode 100644\nnew mode 100755\n")
        for h in range(n):
            body = [r.choice(" +-") + r.choice(("x", "", "diff --git a/q b/q", "-- a/x", "é" * 40, "\tt\r")) for _ in range(r.randint(1, 12))]
            plus, minus = sum(b[0] != "-" for b in body), sum(b[0] != "+" for b in body)
            out += f"@@ -{h * 50 + 1},{minus} +{h * 50 + 1},{plus} @@ def\n" + "\n".join(body) + "\n"
    return out


def test_large_files_are_cut_anywhere(spark, tmp_path):
    r = random.Random(4)
    texts = {f"c {k}.diff": _random_diff(r, r.randint(1, 30)) for k in range(3)} | {"empty.diff": "", "two.diff": NEW + TWO + OTHER, "bad.diff": NEW + "diff --git a/z b/z\n--- a/z\n+++ b/z\n@@ -1,5 +1,5 @@\n a\n" + TWO, "plain.diff": "--- a/e.py\n+++ b/e.py\n@@ -1 +1 @@\n-a\n+b\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = diffs.parse_diffs(spark.createDataFrame(list(texts.items()), "change_id string, raw_diff string"))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "3000")
        got = diffs.parse_files(spark, str(tmp_path))
        assert got.columns == want.columns
        told = lambda df: sorted((tuple(x) for x in df.filter("error is null").collect()), key=repr)
        assert told(got) == told(want) and len(told(want)) > 50
        assert [x["change_id"] for x in diffs.errors_of(got).collect()] == ["bad.diff"]
    finally:
        spark.conf.set(name, before)
