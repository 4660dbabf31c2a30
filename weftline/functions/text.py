"""Column functions that make texts: titles, messages, bodies, tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import stem

#: What operators/validate.py and chunking.py say of a broken rule.
MESSAGES = {
    "cycle": "the dependency graph has a cycle",
    "unknown_dependency": "depends on an unknown group",
    "coverage_gap": "hunk %d of %s is in no group",
    "coverage_overlap": "hunk %d of %s is in groups %s",
    "loc_mismatch": "groups have %d lines of code, the diff has %d",
    "conflict": "unrelated groups %s and %s share hunk %d of %s",
    "below_min": "group %s has %d lines of code (+%d -%d), below the minimum of %d",
    "above_max": "group %s has %d lines of code (+%d -%d), above the maximum of %d",
    "hunk_too_large": "hunk %d of %s needs %d tokens and exceeds budget %d",
}


def group_title(index: Column, files: Column) -> Column:
    """files: sorted distinct paths of the group."""
    one = F.concat(F.lit("chore(split): review "), F.replace(stem(F.get(files, F.lit(0))), F.lit("_"), F.lit("-")), F.lit("-"), index.cast("string"))
    return F.when(F.size(files) == 1, one).otherwise(F.concat(F.lit("chore(split): review-slice-"), index.cast("string")))


def group_description(backend: str, files: Column) -> Column:
    return F.concat(F.lit(f"{backend} partition over "), F.size(files).cast("string"), F.lit(" file(s): "), F.array_join(files, ", "))


def unit_id(path: Column, first: Column, last: Column) -> Column:
    return F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))


def bound_message(kind: Column, group: Column, loc: Column, added: Column, removed: Column, limit: Column) -> Column:
    return F.when(kind == "below_min", F.format_string(MESSAGES["below_min"], group, loc, added, removed, limit)).otherwise(F.format_string(MESSAGES["above_max"], group, loc, added, removed, limit))


def file_flags(is_new: Column, is_deleted: Column, is_renamed: Column) -> Column:
    return F.array_compact(F.array(F.when(is_new, "new"), F.when(is_deleted, "deleted"), F.when(is_renamed, "renamed")))


def file_summary(path: Column, added: Column, removed: Column, flags: Column, hunks: Column) -> Column:
    """A line for a changed file: path, lines, which hunk indices it has, flags."""
    spans = F.when(hunks == 0, "no hunks").otherwise(F.concat(F.lit("indices 0.."), (hunks - 1).cast("string")))
    mark = F.when(F.size(flags) > 0, F.concat(F.lit(" ["), F.array_join(flags, ", "), F.lit("]"))).otherwise("")
    return F.concat(F.lit("  "), path, F.lit(": +"), added.cast("string"), F.lit("/-"), removed.cast("string"), F.lit(" ("), hunks.cast("string"), F.lit(" hunks, "), spans, F.lit(")"), mark)


def patch_sha(patch: Column, sha: Column) -> Column:
    """The given hash, or that of the patch where only the patch is given."""
    return F.when((patch != "") & (sha == ""), F.sha2(patch, 256)).otherwise(sha)


def markdown_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def review_label(decision: Column) -> Column:
    return F.initcap(F.replace(decision, F.lit("_"), F.lit(" ")))


def pr_body(description: Column, files: Column, stats: Column, depends_on: Column, tree: Column, template: str | None = None) -> Column:
    """The sections that there are, a blank line between them; or a template with {placeholders}."""
    sections = {"description": description, "files": files, "stats": stats, "dependencies": depends_on, "tree": tree}
    if template is None:
        return F.concat_ws("\n\n", *[F.when(c != "", c) for c in sections.values()])
    import string

    wanted = {f for _, f, _, _ in string.Formatter().parse(template) if f is not None}
    if wanted - sections.keys():
        raise ValueError(f"unknown placeholder {sorted(wanted - sections.keys())}; available: {sorted(sections)}")
    out = F.lit("")
    for literal, field, _, _ in string.Formatter().parse(template):
        out = F.concat(out, F.lit(literal), F.coalesce(sections[field], F.lit("")) if field is not None else F.lit(""))
    return out
