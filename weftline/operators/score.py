"""Measures of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def file_scatter(assigned: DataFrame) -> DataFrame:
    """Over all files of a change, by how many groups beyond the first they are shared."""
    by_file = assigned.groupBy("change_id", "file_path").agg((F.countDistinct("group_id") - 1).alias("n"))
    return by_file.groupBy("change_id").agg(F.sum("n").alias("file_scatter"))


def plan_metrics(groups: DataFrame, assigned: DataFrame, max_loc: int, min_loc: int | None = None) -> DataFrame:
    """The eleven measures and the objective that weighs them. Scatter counts files of assignments, so a
    whole file without listed hunks must be in `assigned`, too."""
    loc, low = F.col("estimated_loc"), min_loc or 0
    tiny = max(1, max_loc // 4)
    sums = groups.groupBy("change_id").agg(
        F.count("*").alias("group_count"), F.max(loc).alias("max_group_loc"), F.sum(F.greatest(F.lit(0), low - loc)).alias("underflow"), F.sum(F.greatest(F.lit(0), loc - max_loc)).alias("overflow"),
        F.sum(F.size("depends_on")).alias("dependency_edges"), F.count_if((loc > 0) & (loc < tiny)).alias("tiny_groups"), (F.count_if(loc < low)).alias("undersized_groups"),
    )
    out = sums.join(file_scatter(assigned), "change_id", "left").join(graph.depth_and_width(groups), "change_id", "left").na.fill(0, ["file_scatter", "dag_depth", "dag_width"])
    objective = 1000 * F.col("underflow") + 100 * F.col("undersized_groups") + 1000 * F.col("overflow") + 20 * F.col("dependency_edges") + 50 * F.col("file_scatter") + 10 * F.col("tiny_groups") + 5 * F.col("dag_depth") + F.col("group_count") - 2 * F.col("dag_width")
    return out.withColumn("objective", objective)


def action_score(numstat: DataFrame, groups: DataFrame, assigned: DataFrame, max_loc: int, threshold: int) -> DataFrame:
    """What a check of a pull request reports. A change within max_loc isn't planned: one group, objective 0."""
    size = numstat.groupBy("change_id").agg(F.count("*").alias("total_files"), F.sum(F.col("added") + F.col("removed")).alias("total_loc"))
    sums = groups.groupBy("change_id").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), F.col("estimated_loc") - max_loc)).alias("overflow"))
    rows = size.join(sums, "change_id", "left").join(file_scatter(assigned), "change_id", "left").na.fill(0, ["n", "overflow", "file_scatter"])
    small = F.col("total_loc") <= max_loc
    return rows.select("change_id", "total_files", "total_loc", F.when(small, 1).otherwise(F.col("n")).alias("total_groups"), F.when(small, 0).otherwise(1000 * F.col("overflow") + 50 * F.col("file_scatter") + F.col("n")).alias("objective"), (~small & (F.col("n") >= threshold)).alias("should_split"))


def score_report(lines: DataFrame, groups: DataFrame, assigned: DataFrame, existing: DataFrame, marker: str, max_loc: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """A whole check of pull requests: (output lines, comments). lines: change_id, value: numstat; groups: change_id, group_ord, group_id,
    title, estimated_loc; existing: change_id, comment_id, body. Outputs: change_id, place, value: name=value; comments: change_id,
    body, action, comment_id. A change within max_loc is reported without its groups."""
    from ..sources import documents, sinks

    scores = action_score(documents.numstat_lines(lines), groups, assigned, max_loc, threshold).withColumn("should_split", F.coalesce("should_split", F.lit(False)))
    names = ("total_files", "total_loc", "total_groups", "objective", "should_split")
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])
    outputs = sinks.action_outputs(scores.select("change_id", F.posexplode(pairs).alias("place", "p")).select("change_id", "place", "p.name", "p.value"))
    large = scores.filter(F.col("total_loc") > max_loc).select("change_id")
    told = sinks.score_comment(groups.join(large, "change_id", "left_semi").withColumnRenamed("group_id", "id"), scores)
    told = told.withColumn("body", F.concat(F.lit(marker + "\n"), F.col("body")))
    return outputs, sinks.upsert_comments(told, existing, marker)
