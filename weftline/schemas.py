"""Schemas of the tables, as DDL. Every table is keyed by change_id; order is data, in columns."""

CHANGES = "change_id string, raw_diff string"
FILES = "change_id string, file_ord int, file_path string, source_file string, target_file string, added int, removed int, is_new boolean, is_deleted boolean, is_renamed boolean, hunk_count int"
HUNKS = "change_id string, file_ord int, file_path string, hunk_index int, source_start int, source_length int, target_start int, target_length int, added int, removed int, hunk_text string"
ASSIGNMENT = "struct<file_path: string, assignment_type: string, hunk_indices: array<int>>"
_GROUP_FIELDS = (("id", "string"), ("title", "string"), ("description", "string"), ("depends_on", "array<string>"), ("assignments", f"array<{ASSIGNMENT}>"), ("estimated_loc", "int"), ("estimated_added", "int"), ("estimated_removed", "int"), ("expected_patch", "string"), ("expected_patch_sha256", "string"))
GROUP = ", ".join(f"{n} {k}" for n, k in _GROUP_FIELDS)
GROUP_STRUCT = "struct<" + ", ".join(f"{n}: {k}" for n, k in _GROUP_FIELDS) + ">"
PLAN = (
    "plan struct<dev_branch: string, base_branch: string, min_loc: int, max_loc: int, strict_loc_bounds: boolean, stacked: boolean, draft: boolean, priority: string, "
    f"groups: array<{GROUP_STRUCT}>, author: string, merge_base_sha: string, dev_branch_arg: string, raw_diff: string>, "
    "git_state struct<branches: array<struct<group_id: string, branch_name: string, base_branch: string, commit_sha: string>>, "
    "prs: array<struct<group_id: string, pr_number: int, pr_url: string, state: string>>>"
)
PR_LIVE = "pr_number int, state string, review_decision string, is_draft boolean"
VIOLATIONS = "change_id string, severity string, priority int, rule string, group_id string, detail string"
