"""State of a plan's pull requests, and what merging in order would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import review_label
from . import graph


def plan_status(groups: DataFrame, branches: DataFrame, prs: DataFrame, live: DataFrame) -> DataFrame:
    """A row for each group with branch, pull request, live state (else the stored one) and review."""
    keys = ["change_id", "group_id"]
    rows = groups.select(*keys, "title").join(branches.select(*keys, "branch_name"), keys, "left").join(prs.select(*keys, "pr_number", F.col("state").alias("stored")), keys, "left").join(live.withColumnRenamed("state", "live_state"), "pr_number", "left")
    draft = F.when(F.coalesce("is_draft", F.lit(False)), F.lit(" (draft)")).otherwise("")
    return rows.select(*keys, "title", F.coalesce("branch_name", F.lit("")).alias("branch_name"), "pr_number", F.concat(F.upper(F.coalesce("live_state", "stored", F.lit(""))), draft).alias("state"), F.coalesce(review_label(F.col("review_decision")), F.lit("")).alias("review"))


def merge_outcome() -> Column:
    """For rows of groups left-joined to prs (pr_number) and live (state, review_decision, is_draft):
    merge, merged, or why it is skipped. The first reason that holds counts."""
    return (
        F.when(F.col("pr_number").isNull(), "skip: no pull request")
        .when(F.col("state").isNull(), "skip: state unknown")
        .when(F.col("state") == "MERGED", "merged")
        .when(F.col("state") != "OPEN", F.concat(F.lit("skip: "), F.lower("state")))
        .when(F.coalesce("is_draft", F.lit(False)), "skip: draft")
        .when(F.col("review_decision").isin("CHANGES_REQUESTED", "REVIEW_REQUIRED"), F.concat(F.lit("skip: "), F.lower(review_label(F.col("review_decision")))))
        .otherwise("merge")
    )


def merge_walk(groups: DataFrame, prs: DataFrame, live: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """level and outcome of each group when batches are merged in order. `failed` lists groups
    (change_id, group_id) whose merge failed: the walk ends after the batch of the first, and later groups
    are not reached. Skipped groups stop nothing."""
    keys = ["change_id", "group_id"]
    rows = graph.levels(groups).join(prs.select(*keys, "pr_number"), keys, "left").join(live, "pr_number", "left").select(*keys, "level", merge_outcome().alias("outcome"))
    if failed is None:
        return rows
    rows = rows.join(failed.select(*keys, F.lit(True).alias("_failed")), keys, "left").withColumn("outcome", F.when(F.col("_failed") & (F.col("outcome") == "merge"), "failed").otherwise(F.col("outcome"))).drop("_failed")
    stop = rows.filter("outcome = 'failed'").groupBy("change_id").agg(F.min("level").alias("stop"))
    return rows.join(stop, "change_id", "left").select(*keys, "level", F.when(F.col("level") > F.col("stop"), "not reached").otherwise(F.col("outcome")).alias("outcome"))


def merge_summary(walk: DataFrame) -> DataFrame:
    """Groups by outcome, whether the whole walk succeeded, and why it ended."""
    def ids(when: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(when, F.col("group_id"))))

    o = F.col("outcome")
    out = walk.groupBy("change_id").agg(ids(o.isin("merge", "merged")).alias("merged"), ids(o.startswith("skip")).alias("skipped"), ids(o == "failed").alias("failed"), ids(o == "not reached").alias("not_reached"))
    reason = F.when(F.size("failed") > 0, "failed").when(F.size("skipped") > 0, "incomplete").otherwise("completed")
    return out.withColumns({"success": F.size("failed") == 0, "exit_reason": reason})


def first_terminal(events: DataFrame, key: str, state: str, time: str, tie: str, terminal: list[str], deadline) -> DataFrame:
    """The first terminal state of each key before the deadline: what polling would have seen."""
    rows = events.filter(F.col(state).isin(terminal) & (F.col(time) < F.lit(deadline)))
    best = F.min(F.struct(time, tie, state))
    return rows.groupBy(key).agg(best.alias("b")).select(key, F.col(f"b.{state}").alias(state), F.col(f"b.{time}").alias(time))
