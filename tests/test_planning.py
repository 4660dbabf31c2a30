from __future__ import annotations

import inspect
import json
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftline.functions import prompts, text
from weftline.functions.prompts import Prompts
from weftline.operators import actions, chunking, edit, graph, kernels, planning, stats, validate
from weftline.options import PlanOptions
from weftline.sources import documents, sinks

HUNK = "change_id string, file_ord int, file_path string, hunk_index int, added int, removed int, hunk_text string"
DIFF = [("c", 0, "a.py", 0, 3, 0, "@@ a0"), ("c", 0, "a.py", 1, 10, 2, "@@ a1"), ("c", 1, "b.py", 0, 0, 4, "@@ b0"), ("c", 2, "d.py", 0, 1, 1, "@@ d0")]


def group(id_, files, depends_on=(), title="t", description="d"):
    return {"id": id_, "title": title, "description": description, "depends_on": list(depends_on), "assignments": [{"file_path": f, "assignment_type": "partial_hunks", "hunk_indices": list(h)} for f, h in files], "estimated_loc": 0}


def answer(*groups):
    return json.dumps({"groups": list(groups)})


@pytest.fixture(scope="module")
def hunks(spark):
    return spark.createDataFrame(DIFF, HUNK)


@pytest.fixture(scope="module")
def files(hunks):
    made = stats.files_from_hunks(hunks)
    return made.withColumns({"source_file": F.concat(F.lit("a/"), "file_path"), "target_file": F.concat(F.lit("b/"), "file_path")})


def as_groups(spark, groups, hunks):
    made, _ = documents.model_groups(spark.createDataFrame([("c", answer(*groups))], "change_id string, payload_json string"))
    return planning.recounted(made.withColumnRenamed("id", "group_id"), hunks)


def test_summary_has_the_fixed_format(files):
    assert rows(stats.summary_text(files))[0]["text"] == "Total: 3 files, +14/-7 (21 LOC)\n  a.py: +13/-2 (2 hunks, indices 0..1)\n  b.py: +0/-4 (1 hunks, indices 0..0) [deleted]\n  d.py: +1/-1 (1 hunks, indices 0..0)"


def test_prompts(spark, hunks, files):
    said = Prompts().system_text("logical", 250)
    assert "250" in said and Prompts().logical in said and not re.search(r"[{}]", said)
    assert Prompts().orthogonal in Prompts().system_text("orthogonal", 1)
    user = rows(planning.user_prompts(files, hunks))[0]["text"]
    assert "Total: 3 files" in user and "[hunk_index=1]\n@@ a1" in user
    with pytest.raises(ValueError):
        Prompts().filled("nothing")
    chunks = spark.createDataFrame([("c", 0, "a.py", 0), ("c", 0, "a.py", 1), ("c", 1, "b.py", 0), ("c", 1, "d.py", 0)], "change_id string, chunk int, file_path string, hunk_index int")
    known = spark.createDataFrame([("c", 1, "CATALOGUE")], "change_id string, chunk int, text string")
    one, two = rows(planning.chunk_prompts(chunks, files, hunks, known), "chunk")
    assert "chunk 1 of 2" in one["text"] and "1 more" in one["text"] and "a.py: +13/-2" in one["text"] and "@@ b0" not in one["text"]
    assert "chunk 2 of 2" in two["text"] and "CATALOGUE" in two["text"] and "Total: 2 files, +1/-5 (6 LOC)" in two["text"] and "@@ a0" not in two["text"]


def test_refinement_prompt_and_plan_text(spark, hunks, files):
    groups = as_groups(spark, [group("pr-1", [("a.py", [0, 1])], title="ü"), group("pr-2", [("b.py", [0]), ("d.py", [0])], ["pr-1"])], hunks)
    text_ = rows(planning.plan_json(groups))[0]["text"]
    plain = [{"id": g["id"], "title": g["title"], "description": g["description"], "depends_on": g["depends_on"], "assignments": g["assignments"], "estimated_loc": n} for g, n in ((group("pr-1", [("a.py", [0, 1])], title="ü"), 15), (group("pr-2", [("b.py", [0]), ("d.py", [0])], ["pr-1"]), 6))]
    assert text_ == json.dumps(plain, indent=2)
    said = rows(planning.refinement_prompts(groups, files, hunks, PlanOptions(max_loc=14, min_loc=7)))[0]["text"]
    assert "  - pr-1: 15 LOC (+13/-2), above maximum 14\n  - pr-2: 6 LOC (+1/-5), below minimum 7" in said and text_ in said
    assert planning.refinement_prompts(groups, files, hunks, PlanOptions(max_loc=100)).count() == 0


def test_chunks_are_folded_and_retried(spark, hunks):
    good1 = answer(group("pr-1", [("a.py", [0])], title="first"), group("pr-2", [], ["pr-1"]))
    good2 = answer(group("pr-1", [("b.py", [0])], ["pr-2"], title="later"), group("pr-3", [("a.py", [])]))
    schema = "change_id string, chunk int, attempt int, payload_json string"
    answers = spark.createDataFrame([("c", 0, 1, "{"), ("c", 0, 2, good1), ("c", 1, 1, good2), ("x", 0, 1, "{}"), ("x", 0, 2, "no"), ("x", 0, 3, good1)], schema)
    made, failed = planning.chunked_plan(answers, hunks)
    got = {r["group_id"]: r for r in rows(made)}
    assert [(r["change_id"], r["chunk"]) for r in rows(failed)] == [("x", 0)] and {r["change_id"] for r in got.values()} == {"c"}
    assert [g["group_id"] for g in sorted(got.values(), key=lambda g: g["group_ord"])] == ["pr-1", "pr-2", "pr-3"]
    held = {k: [(a["file_path"], a["hunk_indices"]) for a in g["assignments"]] for k, g in got.items()}
    # a.py:1 goes to the first group with a.py, d.py to the group with the most assignments
    assert held == {"pr-1": [("a.py", [0, 1]), ("b.py", [0]), ("d.py", [0])], "pr-2": [], "pr-3": [("a.py", [])]}
    assert got["pr-1"]["title"] == "first" and got["pr-1"]["depends_on"] == ["pr-2"] and got["pr-1"]["estimated_loc"] == 21


def test_refinement_stops(spark, hunks):
    options = PlanOptions(max_loc=14, min_loc=2, max_refinement_iterations=3)
    start = as_groups(spark, [group("pr-1", [("a.py", [0, 1]), ("b.py", [0]), ("d.py", [0])])], hunks)
    half = answer(group("pr-1", [("a.py", [0, 1])]), group("pr-2", [("b.py", [0]), ("d.py", [0])]))
    fine = answer(group("pr-1", [("a.py", [0])]), group("pr-2", [("a.py", [1])]), group("pr-3", [("b.py", [0]), ("d.py", [0])]))
    schema = "change_id string, iteration int, attempt int, payload_json string"

    def ends(*payloads, options=options):
        answers = spark.createDataFrame([("c", i + 1, 1, p) for i, p in enumerate(payloads)], schema)
        groups, told = planning.refined(start, answers, hunks, options)
        t = rows(told)[0]
        return t["iterations"], t["remaining"], t["resolved"], groups.count()

    assert ends(half, fine, half) == (2, 0, True, 3)
    assert ends(half, "{", fine) == (1, 1, False, 2)
    assert ends(half, half, half, fine) == (3, 1, False, 2)
    assert ends() == (0, 1, False, 1)
    assert ends(fine, options=PlanOptions(max_loc=14)) == (0, 1, False, 1)
    assert ends(fine, options=PlanOptions(max_loc=50, min_loc=30, max_refinement_iterations=1)) == (1, 3, False, 3)


def test_plan_with_measures(spark, hunks):
    groups, measures = planning.plan(hunks.drop("hunk_text"), PlanOptions(max_loc=14))
    assert rows(measures)[0]["group_count"] == groups.count() > 1
    said = spark.createDataFrame([("c", 1, answer(group("pr-1", [("a.py", [0, 1]), ("b.py", [0]), ("d.py", [0])])))], "change_id string, attempt int, payload_json string")
    groups, measures = planning.plan(hunks, PlanOptions(max_loc=14, partition_strategy="llm"), said)
    assert rows(measures)[0]["overflow"] == 7 and rows(groups)[0]["estimated_loc"] == 21
    with pytest.raises(ValueError):
        planning.plan(hunks, PlanOptions(partition_strategy="llm"))


def test_calibrated_ratio(spark, hunks):
    counts = spark.createDataFrame([("c", 130, 30, 50)], "change_id string, tokens int, overhead int, chars int")
    assert [r["token_estimate"] for r in rows(planning.calibrated_sequence(hunks, counts), "seq")] == [10, 10, 10, 10]
    none = spark.createDataFrame([("c", 130, 30, 0)], "change_id string, tokens int, overhead int, chars int")
    assert {r["token_estimate"] for r in planning.calibrated_sequence(hunks, none).collect()} == {1}
    assert rows(planning.needs_chunks(counts.select("change_id", F.lit(900_000).alias("tokens")), PlanOptions()))[0]["chunked"]


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    d = spark.createDataFrame([(1, "some words here"), (2, None), (3, "")], "k int, text string")
    assert [r["tokens"] for r in rows(planning.token_counts(d, path), "k")] == [len(Tokenizer.from_file(path).encode("some words here").ids), 0, 0]


def test_effective_hunks_of_a_stack(spark, hunks, files):
    groups = as_groups(spark, [group("r", [("a.py", [0])]), group("m", [("b.py", [0])], ["r"]), group("x", [("a.py", [1])], ["m"]), group("y", [("d.py", [0])], ["x", "m"]), group("z", [("a.py", []), ("d.py", [])], ["y"])], hunks)
    got = {r["group_id"]: {a["file_path"]: a["hunk_indices"] for a in r["assignments"]} for r in rows(edit.effective_hunks(groups, files))}
    # m doesn't have a.py, so x doesn't get r's hunk of it; y carries everything of its ancestors
    assert got == {"r": {"a.py": [0]}, "m": {"b.py": [0]}, "x": {"a.py": [1]}, "y": {"d.py": [0], "a.py": [0, 1], "b.py": [0]}, "z": {"a.py": [0, 1], "d.py": [0]}}


def test_edits_follow_each_other(spark):
    keys = "change_id string, file_path string, hunk_index int"
    assigned = spark.createDataFrame([("c", "f", 0, "p"), ("c", "f", 1, "p"), ("c", "g", 0, "q"), ("c", "g", 0, "p")], f"{keys}, group_id string")
    groups = spark.createDataFrame([("c", g) for g in "pqr"], "change_id string, group_id string")
    edits = [("c", "f", 0, 1, "p", "q"), ("c", "f", 0, 2, "q", "r"), ("c", "f", 0, 3, "p", "q"), ("c", "f", 1, 4, "p", "nowhere"), ("c", "f", 9, 5, "p", "q"), ("c", "g", 0, 6, "p", "q"), ("c", "f", 1, 7, "p", "p")]
    after, told = edit.edit_hunks(assigned, spark.createDataFrame(edits, f"{keys}, seq int, from_id string, to_id string"), groups, assigned)
    assert sorted((r["file_path"], r["hunk_index"], r["group_id"]) for r in after.collect()) == [("f", 0, "r"), ("f", 1, "p"), ("g", 0, "q")]
    assert [r["applied"] for r in rows(told, "seq")] == [True, True, False, False, False, True, False]


def test_actions(spark, hunks):
    groups = as_groups(spark, [group("a", [("a.py", [0])]), group("b", [("a.py", [1])], ["a"]), group("c", [("b.py", [0])], ["a", "b"])], hunks)
    made = actions.branches(groups, F.lit("fix"), merge_base="abc", stacked=True)
    assert [(r["branch_name"], r["start_point"], r["base_branch"]) for r in rows(made, "place")] == [("split/fix/a", "abc", "main"), ("split/fix/b", "split/fix/a", "split/fix/a"), ("split/fix/c", "abc", "main")]
    flat = actions.branches(groups, F.lit("fix"))
    assert {r["base_branch"] for r in flat.collect()} == {"main"}
    bodies = groups.select("change_id", "group_id", F.lit("body").alias("body"))
    acts = actions.pulls(made, groups, bodies, made.filter("group_id <> 'a'"), draft=True)
    told = {(r["group_id"], r["action"]) for r in acts.filter("action <> 'push'").collect()}
    assert told == {("a", "skip: branch or base not pushed"), ("b", "skip: branch or base not pushed"), ("c", "create")} and acts.filter("action = 'push'").count() == 3
    prs = spark.createDataFrame([("c", 0, 7), ("c", 1, 3)], "change_id string, pr_ord int, pr_number int")
    assert [(r["action"], r["target"]) for r in rows(actions.clean(prs, made.filter("group_id = 'a'"), "plan.json"), "place")] == [("close_pr", "7"), ("close_pr", "3"), ("delete_branch", "split/fix/a"), ("delete_remote_branch", "split/fix/a"), ("delete_plan", "plan.json")]


def test_refs_and_merge_bases(spark, tmp_path):
    lines = spark.createDataFrame([("aa1 refs/heads/main",), ("bb2 refs/remotes/origin/dev",), ("",)], "value string")
    known = documents.refs(lines)
    wanted = spark.createDataFrame([("main",), ("origin/dev",), ("aa1",), ("none",)], "name string")
    assert {r["name"]: r["exists"] for r in documents.refs_exist(wanted, known).collect()} == {"main": True, "origin/dev": True, "aa1": True, "none": False}
    commits = [("c", "1", []), ("c", "2", ["1"]), ("c", "3", ["2"]), ("c", "4", ["2"]), ("c", "9", [])]
    table = spark.createDataFrame(commits, "change_id string, sha string, parents array<string>")
    several = spark.createDataFrame([("c", "3", "4"), ("c", "1", "4"), ("c", "1", "4"), ("c", "zz", "4"), ("none", "a", "b")], "change_id string, a string, b string")
    found = {(r["change_id"], r["a"], r["b"]): r["merge_base"] for r in rows(documents.merge_bases(table, several))}
    assert found == {("c", "3", "4"): "2", ("c", "1", "4"): "1", ("c", "zz", "4"): None, ("none", "a", "b"): None}
    base = lambda a, b: rows(documents.merge_bases(table, spark.createDataFrame([("c", a, b)], "change_id string, a string, b string")))[0]["merge_base"]
    assert (base("3", "4"), base("3", "2"), base("4", "9"), base("3", "gone")) == ("2", "2", None, None)
    (tmp_path / "body.md").write_text("x {tree}\ny\n")
    assert documents.body_template(spark, str(tmp_path / "body.md")) == "x {tree}\ny\n" and documents.body_template(spark, str(tmp_path / "no.md")) is None


def test_files_are_written(spark, tmp_path):
    made = spark.createDataFrame([("c", "g", "d/x.py", "a\n"), ("c", "g", "gone.py", None), ("c", "h", "d/x.py", "ü")], "change_id string, group_id string, file_path string, content string")
    (tmp_path / "c" / "g").mkdir(parents=True)
    (tmp_path / "c" / "g" / "gone.py").write_text("old")
    assert {(r["path"].removeprefix(str(tmp_path)), r["bytes"]) for r in sinks.write_files(made, f"file://{tmp_path}").collect()} == {("/c/g/d/x.py", 2), ("/c/g/gone.py", None), ("/c/h/d/x.py", 2)}
    assert (tmp_path / "c/h/d/x.py").read_text() == "ü" and not (tmp_path / "c/g/gone.py").exists()
    with pytest.raises(Exception, match="outside its folder"):
        sinks.write_files(made.withColumn("file_path", F.lit("../x")), f"file://{tmp_path}").collect()


def test_tables_and_catalogue(spark, hunks):
    groups = as_groups(spark, [group("pr-1", [("a.py", [0, 1])]), group("pr-20", [("b.py", [0]), ("a.py", [0]), ("b.py", [1])], ["pr-1"], title="long title")], hunks)
    lines = rows(stats.plan_table(groups))[0]["text"].split("\n")
    assert lines[0] == "Split Plan" and lines[1] == "ID     Title       Diff    Depends On  Files" and set(lines[2]) == {"-"}
    assert lines[3] == "pr-1   t           +13/-2              a.py" and lines[4].startswith("pr-20  long title")
    assert rows(stats.group_catalogue(groups))[0]["text"] == "Group pr-1: t\n  Description: d\n  Files (1): a.py\n  Assignments: 1, ~15 LOC\n\nGroup pr-20: long title (depends on: pr-1)\n  Description: d\n  Files (2): a.py, b.py\n  Assignments: 3, ~7 LOC\n"
    state = spark.createDataFrame([("c", 0, "g", "t", "b", None, "OPEN", "")], "change_id string, group_ord int, group_id string, title string, branch_name string, pr_number int, state string, review string")
    assert rows(stats.status_table(state))[0]["text"].split("\n")[3] == "g   t      b           OPEN"


def test_long_chains_are_drawn():
    tree = kernels.Graph({f"n{k}": [f"n{k - 1}"] if k else [] for k in range(5000)})
    assert len(tree.tree()) == 5000 and tree.tree()[1] == "└── n1"
    assert kernels.Graph({"a": [], "b": ["a"], "c": ["a"], "d": ["b"]}).tree() == ["a", "├── b", "│   └── d", "└── c"]


def test_messages_are_those_of_checks(spark):
    source = inspect.getsource(validate) + inspect.getsource(chunking) + inspect.getsource(text)
    assert all(f'MESSAGES["{k}"]' in source for k in text.MESSAGES)
    said = Prompts().system_text("orthogonal", 77)
    assert all(name in said for name in prompts.CHECKS) and "the maximum is 77" in said and "partial_hunks" in said


def test_catalogue_of_queries_matches_its_sql():
    from weftline.plans import catalogue, flows

    assert flows.query is catalogue.query and set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 61
    assert validate.violations and graph.levels


def test_payloads_are_sent_and_failures_are_rows(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    heard = []

    class Hook(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            heard.append((body, self.headers["Idempotency-Key"]))
            self.send_response(500 if "broken" in body else 400 if "bad" in body else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        outcomes = spark.createDataFrame([("a", "fine"), ("b", "bad"), ("c", "broken")], "change_id string, note string")
        got = {r["change_id"]: r for r in sinks.send_payloads(sinks.webhook_payload(outcomes), f"http://127.0.0.1:{server.server_port}/hook").collect()}
        assert {c: (r["status"], r["tries"], r["error"] is None) for c, r in got.items()} == {"a": (200, 1, True), "b": (400, 1, False), "c": (500, 2, False)}
        assert json.loads(next(b for b, k in heard if k == got["a"]["key"])) == {"note": "fine"} and len({k for _, k in heard}) == 3
    finally:
        server.shutdown()
    gone = sinks.send_payloads(sinks.webhook_payload(outcomes), f"http://127.0.0.1:{server.server_port + 1 if server.server_port < 65535 else 1}/", timeout=1).collect()
    assert all(r["status"] is None and r["error"] for r in gone)


def test_files_are_named_when_all_are_written(spark, tmp_path):
    spark.dataSource.register(sinks.GroupFiles)
    root = tmp_path / "out"
    schema = "change_id string, group_id string, file_path string, content string"

    def save(made):
        made.write.format("group_files").option("root", f"file://{root}").mode("append").save()

    def found():
        return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}

    first = {"c/g/d/x.py": "a\n", "c/g/y.py": "ü", "c/h/x.py": ""}
    save(spark.createDataFrame([(*k.split("/", 2), v) for k, v in first.items()], schema).repartition(3))
    assert found() == first
    save(spark.createDataFrame([("c", "g", "y.py", None), ("c", "g", "z.py", "new"), ("c", "h", "x.py", "again"), ("c", "h", "none.py", None)], schema).repartition(2))
    after = {"c/g/d/x.py": "a\n", "c/g/z.py": "new", "c/h/x.py": "again"}
    assert found() == after
    with pytest.raises(Exception, match="outside"):  # one task fails: nothing is named, and nothing stays behind
        save(spark.createDataFrame([("c", "g", "w.py", "w"), ("c", "g", "../w.py", "w")], schema).repartition(2))
    assert found() == after


def test_what_dead_attempts_staged_is_never_named(tmp_path):
    writer = sinks._GroupFilesWriter(f"file://{tmp_path}", [])
    row = {"change_id": "c", "group_id": "g", "file_path": "a", "content": "lost"}
    writer.write(iter([row]))  # its message never comes
    writer.commit([writer.write(iter([row | {"content": "kept"}])), None])
    assert [(str(p.relative_to(tmp_path)), p.read_text()) for p in tmp_path.rglob("*") if p.is_file()] == [("c/g/a", "kept")]


def test_stacked_schedule_moves_rows_once_and_keeps_groups_that_hold_nothing(spark):
    groups = spark.createDataFrame([(1, "a", 0, []), (1, "b", 1, ["a"]), (1, "c", 2, ["a", "b"]), (1, "d", 3, ["b"]), (1, "e", 4, ["e"])], "change_id long, group_id string, group_ord int, depends_on array<string>")
    own = spark.createDataFrame([(1, "a", "f", "partial_hunks", [0]), (1, "a", "g", "partial_hunks", [1]), (1, "b", "f", "partial_hunks", [2]), (1, "c", "f", "whole_file", [3])], "change_id long, group_id string, file_path string, assignment_type string, hunk_indices array<int>")
    made = edit.stacked_schedule(groups, own)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
    got = {r["group_id"]: (r["level"], r["base_branch"], r["assignments"] and [tuple(a) for a in r["assignments"]]) for r in made.collect()}
    assert got == {
        "a": (0, "main", [("f", "partial_hunks", [0]), ("g", "partial_hunks", [1])]), "b": (1, "a", [("f", "partial_hunks", [0, 2])]),
        "c": (2, "main", [("f", "whole_file", [3]), ("g", "partial_hunks", [1])]), "d": (2, "b", None), "e": (None, "e", None),
    }
