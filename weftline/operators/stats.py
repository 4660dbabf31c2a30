"""Counts over files, hunks and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import file_flags, file_summary
from ..options import TOKEN_RATIO


def diff_stats(files: DataFrame) -> DataFrame:
    """Of each change: files, added, removed and all changed lines, and its files in order."""
    summary = F.struct("file_ord", "file_path", "added", "removed", "is_new", "is_deleted", "is_renamed", "hunk_count")
    return files.groupBy("change_id").agg(
        F.count("*").alias("total_files"), F.sum("added").alias("total_added"), F.sum("removed").alias("total_removed"),
        F.sum(F.col("added") + F.col("removed")).alias("total_loc"), F.sort_array(F.collect_list(summary)).alias("file_summaries"),
    )


def files_from_hunks(hunks: DataFrame) -> DataFrame:
    """Files as hunks alone tell them: a file without removed lines counts as new, without added ones as deleted."""
    rows = hunks.groupBy("change_id", "file_ord", "file_path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("hunk_count"))
    return rows.withColumns({"is_new": F.col("removed") == 0, "is_deleted": F.col("added") == 0, "is_renamed": F.lit(False)})


def file_summaries(files: DataFrame) -> DataFrame:
    flags = file_flags(F.col("is_new"), F.col("is_deleted"), F.col("is_renamed"))
    return files.select("change_id", "file_ord", "file_path", flags.alias("flags"), file_summary(F.col("file_path"), F.col("added"), F.col("removed"), flags, F.col("hunk_count")).alias("summary"))


def summary_text(files: DataFrame) -> DataFrame:
    """change_id, text: the totals of a change and a line for each file, in order."""
    lines = file_summaries(files).groupBy("change_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_ord", "summary"))), lambda x: x["summary"]), "\n").alias("lines"))
    sums = diff_stats(files)
    head = F.format_string("Total: %s files, +%s/-%s (%s LOC)", *[F.col(c).cast("string") for c in ("total_files", "total_added", "total_removed", "total_loc")])
    return sums.join(lines, "change_id").select("change_id", F.concat(head, F.lit("\n"), "lines").alias("text"))


def file_paths(files: DataFrame) -> DataFrame:
    return files.select("change_id", "file_ord", "file_path").orderBy("change_id", "file_ord")


def first_files(files: DataFrame) -> DataFrame:
    """Of files with one path in one change the first."""
    return files.groupBy("change_id", "file_path").agg(F.min("file_ord").alias("file_ord"))


def hunks_for_file(hunks: DataFrame, path: Column) -> DataFrame:
    rows = hunks.filter(F.col("file_path") == path)
    return rows.join(first_files(rows), ["change_id", "file_path", "file_ord"], "left_semi")


def hunk_texts(wanted: DataFrame, hunks: DataFrame) -> DataFrame:
    """The text of each wanted (change_id, file_path, hunk_index). An unknown file gives an empty text, an
    unknown index of a known file an error."""
    first = first_files(hunks)
    known = hunks.join(first, ["change_id", "file_path", "file_ord"], "left_semi").select("change_id", "file_path", "hunk_index", "hunk_text")
    out = wanted.join(known, ["change_id", "file_path", "hunk_index"], "left").join(first.select("change_id", "file_path", F.lit(True).alias("_file")), ["change_id", "file_path"], "left")
    error = F.when(F.col("hunk_text").isNull() & F.col("_file"), "no such hunk")
    return out.select("change_id", "file_path", "hunk_index", F.coalesce("hunk_text", F.lit("")).alias("hunk_text"), error.alias("error"))


def hunk_sequence(hunks: DataFrame, ratio: float = TOKEN_RATIO) -> DataFrame:
    """Hunks in order of file and index, numbered from 0, with an estimate of their tokens."""
    order = W.Window.partitionBy("change_id").orderBy("file_ord", "hunk_index")
    tokens = F.greatest(F.lit(1), F.floor(F.length("hunk_text") * F.lit(ratio)).cast("int"))
    return hunks.select("change_id", (F.row_number().over(order) - 1).alias("seq"), "file_path", "hunk_index", tokens.alias("token_estimate"))


def with_lines(listed: DataFrame, hunks: DataFrame) -> DataFrame:
    """Rows of listed and those of hunks, whose _own is true, with the lines (_added, _removed) of their hunk in the diff, null for
    an unknown one. Both move once, by change, instead of being joined."""
    known = hunks.select("change_id", F.col("file_path").cast("string").alias("file_path"), "hunk_index", "added", "removed", F.lit(True).alias("_own"))
    rows = listed.withColumn("_own", F.lit(False)).unionByName(known, allowMissingColumns=True).repartition("change_id")
    same = W.Window.partitionBy("change_id", "file_path", "hunk_index")
    valid = F.col("file_path").isNotNull() & F.col("hunk_index").isNotNull()
    return rows.withColumns({"_added": F.when(valid, F.sum("added").over(same)), "_removed": F.when(valid, F.sum("removed").over(same)), "_listed": valid & F.max(~F.col("_own")).over(same)})


def group_loc(assigned: DataFrame, hunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Added, removed and all lines of each group from its listed hunks; unknown hunks count nothing."""
    found = with_lines(assigned.select("change_id", "group_id", "file_path", "hunk_index"), hunks).filter(~F.col("_own"))
    sums = found.groupBy("change_id", "group_id").agg(F.sum("_added").alias("added"), F.sum("_removed").alias("removed"))
    out = groups.select("change_id", "group_id").join(sums, ["change_id", "group_id"], "left")
    added, removed = (F.coalesce(c, F.lit(0)) for c in ("added", "removed"))
    return out.select("change_id", "group_id", added.alias("estimated_added"), removed.alias("estimated_removed"), (added + removed).alias("estimated_loc"))


def unknown_hunks(assigned: DataFrame, hunks: DataFrame) -> DataFrame:
    """Assigned hunks that the diff doesn't have."""
    return assigned.join(hunks, ["change_id", "file_path", "hunk_index"], "left_anti")


def labelled_diff(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """The diff of each change as text with the index before each hunk."""
    def joined(value: str, order: str, sep: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep)

    body = hunks.withColumn("_t", F.concat(F.lit("[hunk_index="), F.col("hunk_index").cast("string"), F.lit("]\n"), "hunk_text"))
    body = body.groupBy("change_id", "file_ord").agg(joined("_t", "hunk_index", "\n").alias("_body"))
    heads = files.select("change_id", "file_ord", F.concat(F.lit("--- "), "source_file", F.lit("\n+++ "), "target_file", F.lit("\n")).alias("_head"))
    rows = heads.join(body, ["change_id", "file_ord"], "left").withColumn("_t", F.concat("_head", F.coalesce("_body", F.lit(""))))
    return rows.groupBy("change_id").agg(joined("_t", "file_ord", "\n").alias("text"))


def group_catalogue(groups: DataFrame) -> DataFrame:
    """change_id, text: four lines and an empty one about each group, in order. groups: change_id, group_ord,
    group_id, title, description, depends_on, assignments, estimated_loc."""
    files = F.array_sort(F.array_distinct(F.transform("assignments", lambda a: a["file_path"])))
    after = F.when(F.size("depends_on") > 0, F.concat(F.lit(" (depends on: "), F.array_join("depends_on", ", "), F.lit(")"))).otherwise("")
    text = F.concat(
        F.lit("Group "), F.col("group_id").cast("string"), F.lit(": "), "title", after, F.lit("\n  Description: "), "description", F.lit("\n  Files ("), F.size(files).cast("string"), F.lit("): "),
        F.array_join(files, ", "), F.lit("\n  Assignments: "), F.size("assignments").cast("string"), F.lit(", ~"), F.col("estimated_loc").cast("string"), F.lit(" LOC\n"),
    )
    rows = groups.withColumn("_t", text)
    return rows.groupBy("change_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group_ord", "_t"))), lambda x: x["_t"]), "\n").alias("text"))


def text_table(rows: DataFrame, order: str, columns: dict[str, Column], title: str = "") -> DataFrame:
    """change_id, text: a table for a console, columns as wide as their widest cell, rows in order."""
    names = [f"c{k}" for k in range(len(columns))]
    cells = rows.select("change_id", F.col(order).alias("o"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, columns.values(), strict=True)])
    packed = cells.groupBy("change_id").agg(F.sort_array(F.collect_list(F.struct("o", *names))).alias("rows"), *[F.greatest(F.max(F.length(n)), F.lit(len(label))).alias(f"w{n}") for n, label in zip(names, columns, strict=True)])

    def line(cell) -> Column:
        return F.rtrim(F.concat_ws("  ", *[F.rpad(cell(k, n), F.col(f"w{n}"), F.lit(" ")) for k, n in enumerate(names)]))

    head = line(lambda k, n: F.lit(list(columns)[k]))
    rule = F.repeat(F.lit("-"), sum((F.col(f"w{n}") for n in names), F.lit(2 * (len(names) - 1))))
    body = F.array_join(F.transform("rows", lambda r: line(lambda k, n: r[n])), "\n")
    return packed.select("change_id", F.concat_ws("\n", *[F.lit(title)] * bool(title), head, rule, body).alias("text"))


def plan_table(groups: DataFrame) -> DataFrame:
    files = F.array_join(F.transform("assignments", lambda a: a["file_path"]), ", ")
    lines = F.concat(F.lit("+"), F.col("estimated_added").cast("string"), F.lit("/-"), F.col("estimated_removed").cast("string"))
    return text_table(groups, "group_ord", {"ID": F.col("group_id"), "Title": F.col("title"), "Diff": lines, "Depends On": F.array_join("depends_on", ", "), "Files": files}, "Split Plan")


def status_table(rows: DataFrame) -> DataFrame:
    """rows: what status.plan_status gives, and group_ord."""
    return text_table(rows, "group_ord", {"ID": F.col("group_id"), "Title": F.col("title"), "Branch": F.col("branch_name"), "PR": F.col("pr_number"), "State": F.col("state"), "Review": F.col("review")}, "Status")
