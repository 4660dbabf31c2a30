"""Rules of a plan as tables of what breaks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import MESSAGES, bound_message
from ..options import PlanError, PlanOptions
from ..tables import stored
from . import graph
from .partition import expand_whole, union_all


def coverage_gap(assigned: DataFrame, hunks: DataFrame) -> DataFrame:
    return hunks.select("change_id", "file_path", "hunk_index").join(assigned, ["change_id", "file_path", "hunk_index"], "left_anti")


def coverage_overlap(assigned: DataFrame) -> DataFrame:
    """Hunks that are assigned more than once, to one group or several."""
    rows = assigned.groupBy("change_id", "file_path", "hunk_index").agg(F.sort_array(F.collect_list("group_id")).alias("group_ids"))
    return rows.filter(F.size("group_ids") > 1)


def loc_mismatch(groups: DataFrame, hunks: DataFrame) -> DataFrame:
    """Changes whose groups don't have as many lines together as the diff; no groups count 0."""
    own = groups.groupBy("change_id").agg(F.sum("estimated_loc").alias("group_loc"))
    whole = hunks.groupBy("change_id").agg(F.sum(F.col("added") + F.col("removed")).alias("diff_loc"))
    both = own.join(whole, "change_id", "full").select("change_id", F.coalesce("group_loc", F.lit(0)).alias("group_loc"), F.coalesce("diff_loc", F.lit(0)).alias("diff_loc"))
    return both.filter("group_loc <> diff_loc")


def conflicts(assigned: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of groups that share a hunk and of which neither depends on the other, by however many steps."""
    keys = ["change_id", "file_path", "hunk_index"]
    rows = assigned.select(*keys, "group_id").dropna().repartition("change_id")
    shared = rows.withColumn("n", F.count("*").over(W.Window.partitionBy(*keys))).filter("n > 1").groupBy(*keys).agg(F.array_sort(F.collect_set("group_id")).alias("g"))
    pairs = F.flatten(F.transform("g", lambda a, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = stored(shared.select(*keys, F.inline(pairs)), "pairs")  # few, read twice
    return pairs.join(graph.unrelated(groups, pairs), ["change_id", "a", "b"]).select("change_id", "file_path", "hunk_index", "a", "b")


def loc_bounds(groups: DataFrame, max_loc: int, min_loc: int | None = None) -> DataFrame:
    """Groups below the minimum or above the maximum, with the message."""
    loc = F.col("estimated_loc")
    low = F.when(loc < min_loc, F.struct(F.lit("below_min").alias("violation_type"), F.lit(min_loc).alias("limit"))) if min_loc is not None else F.lit(None).cast("struct<violation_type: string, limit: int>")
    high = F.when(loc > max_loc, F.struct(F.lit("above_max").alias("violation_type"), F.lit(max_loc).alias("limit")))
    rows = groups.select("change_id", "group_id", "estimated_loc", "estimated_added", "estimated_removed", F.explode(F.array_compact(F.array(low, high))).alias("v")).select("*", "v.*").drop("v")
    message = bound_message(F.col("violation_type"), F.col("group_id").cast("string"), F.col("estimated_loc"), F.col("estimated_added"), F.col("estimated_removed"), F.col("limit"))
    return rows.withColumn("message", message)


def violations(groups: DataFrame, hunks: DataFrame, files: DataFrame, options: PlanOptions) -> DataFrame:
    """All broken rules: change_id, priority, severity, rule, group_id, detail. Lower priorities come
    first in a check that stops at the first; bounds are warnings unless they are strict.

    groups: change_id, group_id, depends_on, assignments, estimated_*. Coverage takes whole files as all
    their hunks; conflicts take listed hunks only."""
    # Every rule reads these; they are made once.
    groups = stored(groups.select("change_id", "group_id", "depends_on", "assignments", "estimated_added", "estimated_removed", "estimated_loc"), "groups")
    hunks = stored(hunks.select("change_id", "file_path", "hunk_index", "added", "removed"), "hunks")
    rows = groups.select("change_id", "group_id", F.explode("assignments").alias("a")).select("change_id", "group_id", "a.*")
    cover, listed = stored(expand_whole(rows, files), "cover"), graph.assigned(groups)
    none = F.lit(None).cast("string")

    def made(df: DataFrame, priority: int, rule: str, group, detail, severity: str = "error") -> DataFrame:
        return df.select("change_id", F.lit(priority).alias("priority"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule") if rule else F.col("violation_type").alias("rule"), group.alias("group_id"), detail.alias("detail"))

    group = F.col("group_id").cast("string")
    file = F.col("file_path").cast("string")
    return union_all(
        made(graph.unknown_dependencies(groups), 0, "unknown_dependency", group, F.lit(MESSAGES["unknown_dependency"])),
        made(graph.cycles(groups), 1, "cycle", group, F.lit(MESSAGES["cycle"])),
        made(coverage_gap(cover, hunks), 2, "coverage_gap", none, F.format_string(MESSAGES["coverage_gap"], F.col("hunk_index"), file)),
        made(coverage_overlap(cover), 2, "coverage_overlap", none, F.format_string(MESSAGES["coverage_overlap"], F.col("hunk_index"), file, F.array_join(F.col("group_ids").cast("array<string>"), ", "))),
        made(loc_mismatch(groups, hunks), 3, "loc_mismatch", none, F.format_string(MESSAGES["loc_mismatch"], F.col("group_loc"), F.col("diff_loc"))),
        made(conflicts(listed, groups), 4, "conflict", none, F.format_string(MESSAGES["conflict"], F.col("a").cast("string"), F.col("b").cast("string"), F.col("hunk_index"), file)),
        made(loc_bounds(groups, options.max_loc, options.min_loc), 5, "", group, F.col("message"), "error" if options.strict_loc_bounds else "warning"),
    )


def raise_on_errors(found: DataFrame) -> None:
    first = found.filter("severity = 'error'").orderBy("priority", "change_id", "detail").first()
    if first is not None:
        raise PlanError(f"change {first['change_id']}: {first['rule']}: {first['detail']}")


def empty_groups(groups: DataFrame) -> DataFrame:
    return groups.filter(F.size("assignments") == 0)
